import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textquarry.functions import spans
from textquarry.functions.tokens import has_text, tokenize
from textquarry.operators import chunking

TOKENS = {
    "add_request": ["add_request", "add", "request"],
    "camelCase": ["camelcase", "camel", "case"],
    "HTTPServer": ["httpserver"],
    "getURLFor2X": ["geturlfor2x", "get", "urlfor2", "x"],
    "__init__ _x x_ ___": ["__init__", "_x", "x_", "___"],
    "a__b": ["a__b", "a", "b"],
    "3DModel 9A": ["3dmodel", "3", "dmodel", "9a", "9", "a"],
    "été": ["t"],
    "": [],
    None: [],
}


def test_tokens(spark):
    rows = spark.createDataFrame([(k,) for k in TOKENS], "t string").select("t", tokenize(F.col("t")).alias("x")).collect()
    assert {r.t: list(r.x) for r in rows} == TOKENS


def _spans(spark, texts, make):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", make(F.col("t")).alias("x")).orderBy("i").collect()
    return [[(p.s, p.e) for p in r.x] for r in rows]


def test_golden_spans(spark):
    assert _spans(spark, ["x" * 4500], lambda t: spans.hard_split(t, 2000)) == [[(0, 2000), (2000, 4000), (4000, 4500)]]
    assert _spans(spark, ["a\n\nb\n\n\n c\n"], spans.paragraph_spans) == [[(0, 1), (3, 4), (7, 10)]]
    assert _spans(spark, ["# H\n\nlong para\n\nx"], lambda t: spans.markdown_spans(t, 10)) == [[(0, 3), (5, 14), (16, 17)]]
    assert _spans(spark, ["a\n \nb"], lambda t: spans.markdown_spans(t, 2)) == [[(0, 2), (2, 4), (4, 5)]]
    assert _spans(spark, ["ab\ncd\nefghijklm\nno"], lambda t: spans.line_spans(t, 6)) == [[(0, 6), (6, 12), (12, 16), (16, 18)]]
    assert _spans(spark, ["", " \n\n\t", None], lambda t: spans.markdown_spans(t, 9)) == [[], [], []]


@pytest.mark.parametrize("size", [0, -1, None])
def test_size_must_be_positive(size):
    for cut in (chunking.cut_markdown, chunking.cut_python):
        with pytest.raises(ValueError):
            cut("x", size)
    with pytest.raises(ValueError):
        spans.markdown_spans(F.lit("x"), size)


TEXT = st.text(st.sampled_from("ab \n\n\n😀é"), max_size=120)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TEXT, min_size=20, max_size=40), st.integers(1, 30))
def test_columns_equal_python(spark, texts, size):
    assert _spans(spark, texts, lambda t: spans.markdown_spans(t, size)) == [chunking.cut_markdown(t, size) for t in texts]
    assert _spans(spark, texts, lambda t: spans.line_spans(t, size)) == [chunking.cut_lines(t, 0, len(t), size) for t in texts]


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 30))
def test_span_properties(text, size):
    out = chunking.cut_markdown(text, size)
    assert all(0 < e - s <= size for s, e in out)
    assert all(a[1] <= b[0] for a, b in zip(out, out[1:]))
    lost = re.sub(r"\s", "", text)
    assert re.sub(r"\s", "", "".join(text[s:e] for s, e in out)) == lost
    lines = chunking.cut_lines(text, 0, len(text), size)
    assert "".join(text[s:e] for s, e in lines) == text


PYTHON = [
    ("# lic\nx=1\n# mid\ny=2\n", 20, [(6, 20)]),
    ("# lic\nx=1\n# mid\ny=2\n", 4, [(6, 10), (16, 20)]),
    ("class A:\n  x=1\n\n  def f(self):\n    pass\n", 25, [(9, 15), (16, 40)]),
    ("a=1;b=2\n", 8, [(0, 8)]),
    ("a=1;b=2\n", 7, [(0, 7), (7, 8), (0, 7), (7, 8)]),
    ("@d\ndef f():\n  pass\n", 100, [(0, 19)]),
    ("# only\n", 100, []),
    ("def (\n x\n", 6, [(0, 6), (6, 9)]),
    ("x=\x00", 6, [(0, 3)]),
    (" \n", 6, []),
]


@pytest.mark.parametrize("text,size,want", PYTHON)
def test_python(text, size, want):
    assert chunking.cut_python(text, size) == want


def test_form_feed():
    text = "x=1\n\x0cdef f():\n  pass\ny=2\n"
    assert chunking.cut_python(text, 8, compat_splitlines=True) == [(0, 4), (4, 12), (12, 14), (14, 21)]
    assert chunking.cut_python(text, 8)[-1] == (21, 25)


def test_chunk_files(spark, monkeypatch):
    files = [("p.py", "python", "x=1\n", 5), ("a.md", "markdown", "a\n\nb", 5), ("n.md", "markdown", None, 5), ("o.bin", "other", "x", 5), (None, "markdown", "x", 5), ("k", None, "x", 1)]
    df = spark.createDataFrame(files, "file_path string, kind string, text string, spans int")
    for long in (100_000, 1):
        monkeypatch.setattr(chunking, "LONG_TEXT", long)
        got = {tuple(r) for r in chunking.chunk_files(df, 2).collect()}
        assert got == {("a.md", 0, 0, 1, "a"), ("a.md", 1, 3, 4, "b"), ("p.py", 0, 0, 2, "x="), ("p.py", 1, 2, 4, "1\n")}


def test_numbered(spark, ws):
    rows = [(f"d{i % 7}/f{i}.md", j) for i in range(60) for j in range(i % 4)]
    df = spark.createDataFrame(rows, "file_path string, chunk_in_file int").repartition(5)
    got = {(r.file_path, r.chunk_in_file): r.chunk_ord for r in chunking.numbered(df, ws).collect()}
    assert got == {x: i for i, x in enumerate(sorted(rows, key=lambda x: (x[0].split("/"), x[1])))}
    assert chunking.numbered(df.limit(0), ws).count() == 0


def test_has_text(spark):
    texts = ["", " ", "\t\n\u00a0\u2003\x1c", "x", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(has_text(F.col("t")).alias("h")).collect()
    assert [r.h for r in got] == [bool((t or "").strip()) for t in texts]
