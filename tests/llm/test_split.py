import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textquarry.llm.split import pieces, split_oversized

TEXT = st.text(st.sampled_from("ab \n\n😀"), max_size=200)


def naive(text, limit, least, overlap):
    out, s = [], 0
    while len(text) - s > limit:
        ends = range(s + least + 1, s + limit + 1)
        for mark in ("\n\n", "\n", " ", ""):
            fit = [e for e in ends if text[:e].endswith(mark)]
            if fit:
                break
        out.append((s, max(fit)))
        s = max(fit) - overlap
    return [*out, (s, len(text))]


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(0, 3), st.integers(1, 5), st.integers(0, 20))
def test_pieces(text, overlap, more, room):
    least, limit = overlap + more, overlap + more + room
    if room == 0:
        return
    got = pieces(text, limit, least, overlap)
    assert got == naive(text, limit, least, overlap)
    assert all(e - s <= limit for s, e in got) and got[0][0] == 0 and got[-1][1] == len(text)
    assert text == "".join(text[s + (overlap if i else 0) : e] for i, (s, e) in enumerate(got))


def test_sizes_in_another_unit():
    text = "aa bb cc dd ee"
    offsets = [0]
    for c in text:
        offsets.append(offsets[-1] + (3 if c == "c" else 1))
    got = pieces(text, 6, 2, 0, offsets)
    assert all(offsets[e] - offsets[s] <= 6 for s, e in got) and "".join(text[s:e] for s, e in got) == text
    assert [e - s for s, e in pieces("xy", 1, 1, 0, [0, 9, 18])] == [1, 1]  # a character above the limit still moves on
    for bad in ((5, 6, 0), (5, 3, 3), (5, 3, -1)):
        with pytest.raises(ValueError):
            pieces("x", *bad)


def test_table(spark):
    long = ("word " * 300 + "\n\n") * 3 + "x" * 5000
    rows = [(1, "f", 100, 0, long, 1), (1, "f", 100, 0, long, 1), (2, "f", 0, 0, "short", 1), (3, "f", 0, 0, None, 1), (4, "f", None, 0, long, 1), (5, None, 7, None, "y" * 2001, None), (None, "f", 0, 0, "z" * 2000, 1)]
    df = spark.createDataFrame(rows, "chunk_ord long, file_path string, first_character_index long, last_character_index long, text string, piece int")
    got = {tuple(r) for r in split_oversized(df).collect()}
    assert got == {(1, 100 + s, 100 + e) for s, e in naive(long, 2000, 1000, 150)} | {(5, 7 + s, 7 + e) for s, e in naive("y" * 2001, 2000, 1000, 150)}
    assert split_oversized(df.limit(0)).count() == 0
