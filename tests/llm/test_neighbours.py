import numpy as np
import pytest

from textquarry.llm import int8, neighbours
from textquarry.plans.workspace import Workspace

KIND = "chunk_ord long, embedding array<float>, code int, rep long"


def brute(rows, k, threshold, dim):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, v)
    ids = np.asarray(sorted(good))
    if not len(ids):
        return set()
    m = np.asarray([good[i] for i in ids], np.float32).astype(float)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    out = set()
    for a in range(len(ids)):
        near = [b for b in np.lexsort((ids, -s[a])) if b != a and s[a, b] >= threshold][:k]
        out |= {(int(min(ids[a], ids[b])), int(max(ids[a], ids[b]))) for b in near}
    return out


def _rows(seed, dim=16):
    r = np.random.default_rng(seed)
    rows, n = [], 0
    for _ in range(25):
        centre = r.normal(size=dim)
        for _ in range(int(r.integers(1, 25))):
            rows.append((n, (centre + r.normal(size=dim) * r.choice([0.05, 0.3])).tolist()))
            n += 1
    rows += [(n + i, rows[3][1]) for i in range(120)]  # many copies
    rows += [(n + 200 + i, [4 * x for x in rows[3][1]]) for i in range(9)]  # the same direction
    rows += [(n + 300 + i, rows[40 + i % 3][1]) for i in range(9)]
    bad = [None, [], [1.0] * 5, [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1)]
    rows += [(n + 400 + i, v) for i, v in enumerate(bad)] + [(None, rows[0][1]), rows[5], rows[5]]
    return rows


@pytest.mark.parametrize("seed,block,k", [(1, 8192, 5), (2, 16, 5), (3, 8192, 9)])
def test_recall_and_exact_order(spark, ws, monkeypatch, seed, block, k):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rows = _rows(seed)
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], KIND).repartition(3)
    got = {tuple(x) for x in neighbours.similar_pairs(df, ws, k, 0.75, 16, probes=8).collect()}
    want = brute(rows, k, 0.75, 16)
    assert len(got & want) >= 0.98 * len(want) and len(got & want) >= 0.98 * len(got)


@pytest.mark.parametrize("block,hot", [(8192, 64), (32, 64), (8192, 8)])
def test_all_against_all_is_exact(spark, ws, monkeypatch, block, hot):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "HOT_LEAST", hot)
    rows = _rows(4)
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], KIND)
    got = {tuple(x) for x in neighbours.similar_pairs(df, ws, 5, 0.75, 16, cell_rows=None).collect()}
    assert got == brute(rows, 5, 0.75, 16)


@pytest.mark.parametrize("n", [500, 1000, 2000])
def test_near_copies_give_k_rows_each(spark, n):
    """Copies of one direction with noise so small that they can't be told apart by their codes."""
    r = np.random.default_rng(n)
    base = r.normal(size=32)
    rows = [(i, (base + 1e-3 * r.normal(size=32)).tolist()) for i in range(n)] + [(n + i, r.normal(size=32).tolist()) for i in range(300)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], KIND)
    ws = Workspace(spark, "copies")
    near, _, _ = neighbours.nearest_lists(df, ws, 5, 0.75, 32)
    assert near.count() <= 5 * (n + 300)
    got = {tuple(x) for x in neighbours.similar_pairs(df, Workspace(spark, "pairs"), 5, 0.75, 32).collect()}
    want = brute(rows, 5, 0.75, 32)
    assert len(got & want) >= 0.99 * len(want) and len(got & want) >= 0.99 * len(got)


def test_two_levels_of_centres(spark, ws, monkeypatch):
    monkeypatch.setattr(neighbours, "FIRST_CENTRES", 8)
    rows = _rows(6)
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], KIND)
    cells = neighbours.make_cells(neighbours._hashed(df, 16), len(rows), 16, 40)
    assert len(cells.first) <= 6 and cells.count > len(cells.first)
    x = np.random.default_rng(1).normal(size=(50, 16)).astype(np.float32)
    near, likes = cells.nearest(x, 3)
    assert near.shape == (50, 3) and near.max() < cells.count and all(len(set(v)) == 3 for v in near.tolist()) and (np.diff(likes) <= 0).all()
    row, cell = cells.of(x, 3)
    assert set(row) == set(range(50)) and {(r, near[r, 0]) for r in range(50)} <= set(zip(row, cell))
    got = {tuple(v) for v in neighbours.similar_pairs(df, ws, 5, 0.75, 16, probes=8, cell_rows=60).collect()}
    want = brute(rows, 5, 0.75, 16)
    assert len(got & want) >= 0.95 * len(want)


def test_several_vectors_of_a_chunk(spark, ws):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [-1.0, 0.0])]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], KIND)
    assert {tuple(x) for x in neighbours.similar_pairs(df, ws, 1, dim=2, cell_rows=None).collect()} == {(1, 2), (1, 3)}


def test_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, 1), (2, [1.0, 0.0], 1, 1), (3, [0.0, 1.0], 1, 1)], KIND)
    assert [tuple(x) for x in neighbours.similar_pairs(df, Workspace(spark, "a"), dim=2).collect()] == [(1, 2)]
    assert neighbours.similar_pairs(df, Workspace(spark, "b")).count() == 0  # no vector has 128 numbers
    assert neighbours.similar_pairs(df.limit(0), Workspace(spark, "c")).count() == 0
    with pytest.raises(ValueError):
        neighbours.similar_pairs(df, Workspace(spark, "d"), k=0)


def test_bounds_hold():
    r = np.random.default_rng(0)
    x = neighbours.unit(r.normal(size=(300, 64)))
    code, scale, err = neighbours.quantise(x)
    rough = int8.int8_product(code, code) * scale[:, None] * scale
    assert (np.abs(x @ x.T - rough) <= 1.02 * (err[:, None] + err)).all()


def test_int8_product(monkeypatch):
    r = np.random.default_rng(1)
    a, b = (r.integers(-128, 128, (n, 40)).astype(np.int8) for n in (7, 9))
    want = a.astype(int) @ b.T.astype(int)
    for session in (None, False):  # by the library, if it is there, and without
        monkeypatch.setattr(int8, "_session", session)
        assert (int8.int8_product(a, b) == want).all()
    assert int8.int8_product(a[:0], b).shape == (0, 9)
