import math
import random
from collections import Counter, defaultdict

import pytest

from textquarry.llm import terms
from textquarry.plans.versions import AlreadyPublished
from textquarry.plans.workspace import Workspace

KIND = "chunk_ord long, shard_no long, build_no long, term_frequencies map<string,long>, term string, tf long"


def _rows(seed, n=60):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(40)] + ["İx", "ß", "ü"]
    rows = []
    for i in range(n):
        for b in range(1, r.randrange(1, 4) + 1):
            for s in range(r.choice([1, 1, 2])):
                m = {}
                for _ in range(r.randrange(0, 9)):
                    w = r.choice(words)
                    m[r.choice([w, w.upper(), f" {w}", f"{w}  "])] = r.choice([None, 0, -3, 1, 2, 5])
                rows.append((i, s, b, r.choice([m, m, m, None]), "clash", 7))
    rows += [(0, 0, None, {"low": 3}, None, None), (None, 0, 9, {"nobody": 2}, None, None), (99, 0, 1, {" ": 4, "": 2}, None, None)]
    rows += [(5, 0, 9, {"hot": 2, "x": 1}, None, None)] * 200
    r.shuffle(rows)
    return rows


def _bags(rows):
    top = {}
    for c, _, b, *_ in rows:
        if c is not None:
            top[c] = max(top.get(c, -1), -1 if b is None else b)
    seen = {(c, s, b, tuple(sorted((m or {}).items()))) for c, s, b, m, *_ in rows if c is not None and (-1 if b is None else b) == top[c]}
    bags = defaultdict(Counter)
    for c, _, _, m in seen:
        for k, v in m:
            if v is not None and v >= 1 and k.strip(" "):
                bags[c][k.strip(" ").lower()] += v
    return bags


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, ws, seed):
    rows = _rows(seed)
    df = spark.createDataFrame(rows, KIND)
    bags = _bags(rows)
    n, dfs = len(bags), Counter(t for b in bags.values() for t in b)
    want = {}
    for c, b in bags.items():
        w = sorted((-round(tf * math.log((n - dfs[t] + 0.5) / (dfs[t] + 0.5) + 1), 6), t) for t, tf in b.items() if dfs[t] >= 2)
        want[c] = [t for _, t in w[:3]]
    got = defaultdict(list)
    for r in terms.distinctive_terms(terms.latest_bags(df), ws, 3, "weight").orderBy("rank").collect():
        got[r.chunk_ord].append(r.term)
    assert dict(got) == {c: t for c, t in want.items() if t}
    state = terms.counts_by_builds(df, Workspace(spark, "counts"))
    counts = {r.term: (r.tf, r.df) for r in state.read().collect()}
    total = Counter()
    for b in bags.values():
        total.update(b)
    assert counts == {t: (total[t], dfs[t]) for t in dfs} and state.records() == n
    marks = {r.term: r.mark for r in terms.marked_terms(state.read(), n).collect()}
    assert marks == {t: "rare" if d <= 2 else "common" if d > 0.4 * n else None for t, d in dfs.items()}


def test_residuals(spark, ws):
    bags = {1: {"a": 4, "b": 1}, 2: {"a": 1, "b": 4}, 3: {"b": 2}}
    df = spark.createDataFrame([(c, t, n) for c, b in bags.items() for t, n in b.items()], "chunk_ord long, term string, tf long")
    total, cols = 12, {"a": 5, "b": 7}
    for r in terms.distinctive_terms(df, ws, None).collect():
        row, col = sum(bags[r.chunk_ord].values()), cols[r.term]
        e = row * col / total
        assert math.isclose(r.residual, (r.tf - e) / math.sqrt(e * (1 - row / total) * (1 - col / total)), abs_tol=1e-6)
    one = terms.distinctive_terms(df.where("chunk_ord = 3"), Workspace(spark, "one"), 3, least_df=1).collect()
    assert [(r.term, r.residual) for r in one] == [("b", None)]


def test_empty_and_deltas(spark, ws):
    empty = spark.createDataFrame([], KIND)
    assert terms.distinctive_terms(terms.latest_bags(empty), ws).count() == 0
    assert terms.counts_by_builds(empty, Workspace(spark, "e")).read().count() == 0
    signed = "chunk_ord long, term string, tf long, sign int"
    delta = lambda *rows: terms.term_delta(spark.createDataFrame(list(rows), signed))
    path = ws.at("counts")
    terms.TermCounts(spark, path).apply(delta((1, "a", 2, 1), (1, "b", 1, 1), (2, "a", 3, 1)), "one")
    # 1 changes, 2 is deleted, 3 comes new
    second = delta((1, "a", 2, -1), (1, "b", 1, -1), (1, "b", 5, 1), (2, "a", 3, -1), (3, "c", 1, 1))
    state = terms.TermCounts(spark, path).apply(second, "two")
    want = [("b", 5, 1), ("c", 1, 1)]
    assert sorted(tuple(r) for r in state.read().select("term", "tf", "df").collect()) == want and state.records() == 2
    state.apply(second, "two")  # sent again
    again = terms.TermCounts(spark, path)
    assert sorted(tuple(r) for r in again.read().select("term", "tf", "df").collect()) == want and again.records() == 2 and again.versions.numbers() == [1, 2]


def test_counts_survive_a_crash_and_write_touched_buckets_only(spark, ws, monkeypatch):
    monkeypatch.setattr(terms.TermCounts, "BUCKET_TERMS", 5)
    kind = "term string, tf long, df long"
    made = lambda names, records: spark.createDataFrame([(t, 2, 1) for t in names] + [(terms.RECORD, 0, records)], kind)
    path = ws.at("counts")
    first = [f"w{i}" for i in range(60)]
    state = terms.TermCounts(spark, path).apply(made(first, 60), "a")
    before = state._meta()
    assert before["buckets"] == 13 and before["terms"] == 60
    with monkeypatch.context() as m:
        m.setattr("textquarry.plans.versions.Versions.publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            terms.TermCounts(spark, path).apply(made(["w3"], 1), "b")
    again = terms.TermCounts(spark, path)
    assert again._meta() == before and again.records() == 60
    after = again.apply(made(["w3"], 1), "b")._meta()
    assert sum(x != y for x, y in zip(before["places"], after["places"])) == 1 and (after["terms"], after["records"]) == (60, 61)
    # two runs from one version: the second is refused, and may be sent again
    one, two = terms.TermCounts(spark, path), terms.TermCounts(spark, path)
    real = two._buckets
    monkeypatch.setattr(two, "_buckets", lambda *a: one.apply(made(["x1"], 1), "c") and real(*a))
    with pytest.raises(AlreadyPublished):
        two.apply(made(["x2"], 1), "d")
    monkeypatch.undo()
    monkeypatch.setattr(terms.TermCounts, "BUCKET_TERMS", 5)
    terms.TermCounts(spark, path).apply(made(["x2"], 1), "d")
    terms.TermCounts(spark, path).apply(made([f"v{i}" for i in range(600)], 600), "e")  # buckets are laid out anew
    state = terms.TermCounts(spark, path)
    counts = {r.term: (r.tf, r.df) for r in state.read().collect()}
    assert counts == {t: (4, 2) if t == "w3" else (2, 1) for t in [*first, "x1", "x2", *(f"v{i}" for i in range(600))]}
    assert state.records() == 663 and state._meta()["buckets"] == 133 and state._meta()["terms"] == len(counts)


def test_a_record_with_very_many_rows(spark, ws, monkeypatch):
    rows = _rows(3)
    df = spark.createDataFrame(rows, KIND)
    key = lambda d: sorted((r.chunk_ord, r.term, r.tf, r.row_sum) for r in d.collect())
    want = key(terms.latest_bags(df))
    monkeypatch.setattr(terms, "HOT_ROWS", 20)
    monkeypatch.setattr(terms, "HOT_SHARE", 0.0)
    assert key(terms.latest_bags(df)) == want
    assert {(c, t): n for c, t, n, _ in want if t != terms.RECORD} == {(c, t): n for c, b in _bags(rows).items() for t, n in b.items()}


def test_ranking_by_weight_gives_residuals_too(spark):
    df = spark.createDataFrame([(1, "a", 4), (1, "b", 1), (2, "a", 1), (2, "b", 4), (3, "b", 2)], "chunk_ord long, term string, tf long")
    own = {s: terms.distinctive_terms(df, Workspace(spark, s), None, s).collect() for s in ("weight", "residual")}
    key = {s: {(r.chunk_ord, r.term): (r.tf, r.df, r.residual, r.weight) for r in rows} for s, rows in own.items()}
    assert len(own["weight"]) == 5 and key["weight"] == key["residual"] and all(r.residual is not None for r in own["weight"])
    first = terms.distinctive_terms(df, Workspace(spark, "first"), 1, "weight").collect()
    assert {tuple(r) for r in first} == {tuple(r) for r in own["weight"] if r.rank == 1}
