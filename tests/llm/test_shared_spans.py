import random

import numpy as np
import pytest

import textquarry.llm.shared_spans as module
from textquarry.llm import winnow
from textquarry.llm.shared_spans import shared_spans
from textquarry.plans.workspace import Workspace


def brute(docs, m):
    owners = {}
    for d, t in docs:
        for i in range(len(t) - m + 1):
            owners.setdefault(t[i : i + m], set()).add(d)
    out = set()
    for d, t in docs:
        runs = []
        for i in range(len(t) - m + 1):
            if len(owners[t[i : i + m]]) > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + m
                else:
                    runs.append([i, i + m])
        out |= {(d, s, e) for s, e in runs}
    return out


def _docs(seed):
    r = random.Random(seed)
    letters = "abcdefgh \n😀é"
    noise = lambda n: "".join(r.choice(letters) for _ in range(n))
    passages = [noise(r.randrange(20, 150)) for _ in range(12)] + ["=" * 130, "ab" * 60]
    docs = []
    for d in range(90):
        parts = []
        for _ in range(r.randrange(0, 5)):
            p = r.choice(passages)
            s = r.randrange(len(p) // 2)
            parts += [noise(r.randrange(0, 60)), r.choice([p, p[s:], p[: len(p) - s], p[:30] + "!" + p[30:]])]
        docs.append((d * 3, "".join(parts)))
    boiler = noise(90)
    docs += [(1000 + i, noise(20) + boiler + noise(25)) for i in range(40)] + [(2000 + i, boiler + "tail") for i in range(40)]
    docs += [(3000, "=" * 300), (3001, ""), (3002, boiler[:39]), (3003, (boiler + "-") * 3)]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed,m,gram", [(1, 40, 10), (2, 40, 40), (3, 25, 6)])
def test_against_brute_force(spark, ws, monkeypatch, seed, m, gram):
    monkeypatch.setattr(winnow, "SEGMENT", 64)
    monkeypatch.setattr(module, "BROADCAST_CLASSES", 100_000 if seed == 1 else 0)
    docs = _docs(seed)
    df = spark.createDataFrame([(*x, 1) for x in docs] + [(None, docs[0][1], 1), (9999, None, 1)], "doc_id long, text string, pos int").repartition(3)
    rows = shared_spans(df, ws, m, gram).collect()
    assert {tuple(r) for r in rows} == brute(docs, m) and len(rows) == len(set(rows))


def test_edges(spark):
    df = spark.createDataFrame([(1, "x" * 30), (2, "y" * 30)], "doc_id long, text string")
    assert shared_spans(df, Workspace(spark, "a"), 10, 4).count() == 0
    assert shared_spans(df.limit(0), Workspace(spark, "b"), 10, 4).count() == 0
    with pytest.raises(ValueError):
        shared_spans(df, Workspace(spark, "c"), 10, 11)


def test_windows_pick_by_content():
    r = random.Random(9)
    text = "".join(r.choice("abcd") for _ in range(3000))
    hashes = winnow.Hashes(winnow.code_points(text))
    grams = [int(x) for x in hashes.grams(20)]
    for pos, first, last, h, *_ in winnow.anchors(text, 20, 31):
        assert first[0] == 0 and last[-1] == len(text) - 50 and (first[1:] == last[:-1] + 1).all()
        assert all(0 <= p - l <= p - f <= 30 for p, f, l in zip(pos, first, last))
        assert [grams[p] for p in pos] == [int(x) for x in h]
    moved = "".join(r.choice("abcd") for _ in range(77)) + text
    a = {int(p) for p in next(winnow.anchors(text, 20, 31))[0]}
    b = {int(p) - 77 for p in next(winnow.anchors(moved, 20, 31))[0]}
    assert {p for p in a if p > 31} <= b  # the first window may pick otherwise
    x = np.asarray([r.randrange(100) for _ in range(500)], np.uint64)
    for w in (1, 2, 7, 64, 500):
        assert winnow.sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(len(x) - w + 1)]
    assert list(winnow.anchors("short", 20, 31)) == []
