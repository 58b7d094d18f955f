"""Most similar vectors for every vector: a block matrix join on int8 tiles with error bounds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.dense import matrix
from ..plans.skew import keyed_lookup
from ..plans.workspace import Workspace
from .int8 import int8_product

DIM, K, THRESHOLD = 128, 5, 0.75
#: Cells that a vector goes to, on average and at most; vectors of a cell that the number of cells aims at; bounds on the number of cells.
PROBES, MOST_PROBES, CELL_ROWS, LEAST_CELLS, MOST_CELLS = 3.75, 8, 1500, 16, 131_072
#: Centres made on the driver; more are made in tasks, so many at most in each of these.
FIRST_CENTRES, NEXT_CENTRES = 1024, 1024
#: Vectors from which centres are made, for each of them, and at most on the driver; rounds of moving them.
SAMPLE_PER_CELL, SAMPLE, ROUNDS = 64, 65536, 5
#: Vectors of a cell in one block: a larger cell is cut into blocks, and every two blocks make a tile of their own.
BLOCK = 8192
#: A group of equal vectors that holds more than this share of all (and ``HOT_LEAST``) is searched for its first members alone.
HOT_SHARE, HOT_LEAST = 1 / 4096, 64
_ROUND = 5e-7  # half a unit of the sixth place


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(code, scale, err)`` of unit vectors: x is about ``scale * code``; err is the length of the difference, a little rounded up."""
    scale = np.abs(x).max(axis=1) / 127.0
    code = np.rint(x / scale[:, None])
    err = np.linalg.norm(x - code * scale[:, None], axis=1)
    return code.astype(np.int8), scale, err * 1.001 + 1e-7


def _binary(m: np.ndarray) -> pa.Array:
    n, size = len(m), m.shape[1] * m.itemsize
    flat = np.ascontiguousarray(m).view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * size, size, dtype=np.int32)), pa.py_buffer(flat)])


def _floats(column, dim: int) -> np.ndarray:
    """Rows of a column of ``_binary``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, dim), np.float32)
    start = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
    return np.frombuffer(column.buffers()[2], np.float32, len(column) * dim, start).reshape(-1, dim)


def _col(batch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch[name].to_numpy()


def _hashed(vectors: DataFrame, dim: int) -> DataFrame:
    rows = vectors.where(F.col("chunk_ord").isNotNull() & (F.size("embedding") == dim))
    return rows.select("chunk_ord", F.col("embedding").cast("array<float>").alias("embedding")).select(
        F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(11), "embedding").alias("h2"), "*"
    )


def _usable(batch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """``(vectors, ids)`` of the different rows of a batch that are usable; ids are ``h1, h2, chunk_ord``."""
    m, at = matrix(batch.column("embedding"), dim)
    ids = np.stack([_col(batch, c)[at] for c in ("h1", "h2", "chunk_ord")], axis=1) if len(at) else np.zeros((0, 3), np.int64)
    _, first = np.unique(ids, axis=0, return_index=True)
    return m[first], ids[first]


# cells


def k_means(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of about ``cells`` cells. They start from rows not close to one taken before, so that vectors of nearly one direction, however many, get one."""
    kept = np.zeros((cells, x.shape[1]), np.float32)
    n = 0
    # a fixed order that has nothing to do with the rows' own
    for v in x[np.random.default_rng(5).permutation(len(x))]:
        if n == 0 or (kept[:n] @ v).max() < 0.6:
            kept[n] = v
            n += 1
            if n == cells:
                break
    kept = kept[: max(1, n)]
    for _ in range(rounds):
        moved = np.zeros_like(kept)
        for i in range(0, len(x), 2048):
            part = x[i : i + 2048]
            np.add.at(moved, (part @ kept.T).argmax(axis=1), part)
        length = np.linalg.norm(moved, axis=1, keepdims=True)
        kept = np.where(length > 1e-6, moved / np.maximum(length, 1e-6), kept)
    return kept.astype(np.float32)


class Cells:
    """Centres in one or two levels: those of the first, and below each of them its own, if there are any.

    A vector goes to the cell whose centre is nearest, and to others whose
    centres are farther by no more than ``reach``: one that lies between cells
    goes to several, one well inside a cell to that alone.
    """

    def __init__(self, first: np.ndarray, below: dict[int, np.ndarray] | None = None):
        self.first, self.below, self.reach = first, below or {}, 0.0
        sizes = [len(self.below.get(i, ())) or 1 for i in range(len(first))]
        self.base = np.cumsum([0, *sizes])
        self.count = int(self.base[-1])

    def nearest(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the ``most`` nearest cells of each row, and how near they are, in order; below the ``most`` nearest first centres only."""
        near = x @ self.first.T
        first = _greatest(near, most)
        if not self.below:
            return first, np.take_along_axis(near, first, axis=1)
        names, likes = np.zeros((len(x), 0), np.int64), np.zeros((len(x), 0), np.float32)
        for j in range(first.shape[1]):
            own_names = np.zeros((len(x), most), np.int64)
            own_likes = np.full((len(x), most), -9.0, np.float32)
            for g in np.unique(first[:, j]):
                rows = np.flatnonzero(first[:, j] == g)
                near = x[rows] @ self.below.get(int(g), self.first[g : g + 1]).T
                best = _greatest(near, most)
                own_names[rows[:, None], np.arange(best.shape[1])] = best + self.base[g]
                own_likes[rows[:, None], np.arange(best.shape[1])] = np.take_along_axis(near, best, axis=1)
            names, likes = np.concatenate([names, own_names], axis=1), np.concatenate([likes, own_likes], axis=1)
        best = _greatest(likes, min(most, self.count))
        return np.take_along_axis(names, best, axis=1), np.take_along_axis(likes, best, axis=1)

    def fit_reach(self, x: np.ndarray, probes: float, most: int) -> "Cells":
        """Sets ``reach`` so that rows like ``x`` go to ``probes`` cells on average."""
        _, likes = self.nearest(x, most)
        gaps = (likes[:, :1] - likes[:, 1:]).ravel()
        if len(gaps):
            self.reach = float(np.quantile(gaps, min(1.0, max(0.0, (probes - 1) / (likes.shape[1] - 1)))))
        return self

    def of(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """``(row, cell)`` of all cells that the rows go to."""
        names, likes = self.nearest(x, most)
        return (at := np.nonzero(likes[:, :1] - likes <= self.reach))[0], names[at]


def _greatest(near: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest of each row, in falling order."""
    k = min(k, near.shape[1])
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(near, best, axis=1), axis=1, kind="stable"), axis=1)


def make_cells(rows: DataFrame, n: int, dim: int, wanted: int, probes: float = PROBES) -> Cells:
    """About ``wanted`` cells for ``rows`` of ``_hashed``, of which ``n`` are usable and different.

    Centres come from rows whose hash lies in a range. Up to ``FIRST_CENTRES`` are
    made on the driver, from at most ``SAMPLE`` rows or so; for more cells, each of
    the first ones is divided by centres of its own, made in tasks from its part
    of a sample that grows with their number. What comes to the driver is a
    centre for each cell, ``MOST_CELLS * dim`` floats at most.
    """

    def sampled(share: float) -> DataFrame:
        place = F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 40))
        return rows.where(place < int(min(1.0, share) * (1 << 40)))

    def units(batches):
        for b in batches:
            m, ids = _usable(b, dim)
            yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), _binary(unit(m).astype(np.float32) if len(m) else m.astype(np.float32))], names=["h", "x"])

    count = min(wanted, FIRST_CENTRES if wanted <= FIRST_CENTRES else max(1, math.isqrt(wanted)))
    share = min(SAMPLE, 2 * SAMPLE_PER_CELL * count) / n
    got = sorted((r[0], bytes(r[1])) for r in sampled(share).mapInArrow(units, "h long, x binary").distinct().collect())
    x = np.frombuffer(b"".join(v for _, v in got), np.float32).reshape(-1, dim) if got else np.eye(1, dim, dtype=np.float32)
    # centres lie nearer to the rows they are made from than to others, so the reach is measured on others
    first = k_means(x[::2], count)
    most = max(MOST_PROBES, math.ceil(probes))
    if wanted <= FIRST_CENTRES:
        return Cells(first).fit_reach(x[1::2] if len(x) > 1 else x, probes, most)
    top = rows.sparkSession.sparkContext.broadcast(first)
    share = min(1.0, SAMPLE_PER_CELL * wanted / n)

    def assigned(batches):
        for b in batches:
            x = _floats(b.column("x"), dim)
            yield pa.RecordBatch.from_arrays([pa.array((x @ top.value.T).argmax(axis=1)), b.column("x")], names=["cell", "x"])

    def divide(table: pa.Table) -> pa.Table:
        x = _floats(table["x"], dim)
        cells = int(min(NEXT_CENTRES, max(1, round(len(x) * wanted / (n * share)))))
        x = x[: SAMPLE_PER_CELL * cells]  # rows of a cell are in order of their hashes
        made = k_means(x, cells)
        return pa.table({"cell": pa.array(np.full(len(made), table["cell"][0].as_py())), "x": _binary(made)})

    held = sampled(share).mapInArrow(units, "h long, x binary").distinct().mapInArrow(assigned, "cell long, x binary")
    found: dict[int, list[bytes]] = {}
    for r in held.groupBy("cell").applyInArrow(divide, "cell long, x binary").collect():
        found.setdefault(r[0], []).append(bytes(r[1]))
    below = {g: np.frombuffer(b"".join(sorted(v)), np.float32).reshape(-1, dim) for g, v in found.items()}
    return Cells(first, below).fit_reach(x[1::2] if len(x) > 1 else x, probes, most)


# tiles


def best_of(rows: np.ndarray, row_chunks: np.ndarray, cols: np.ndarray, col_chunks: np.ndarray, k: int, threshold: float):
    """``(row, other, sim)``: for each row of ``rows`` the ``k`` best chunks of ``cols`` that reach ``threshold``.

    Unit vectors; a row's own chunk doesn't count, and of several vectors of a
    chunk the likest does. Ties, at 6 places, go to the smaller chunk. The int8
    product bounds each similarity from both sides by the rows' own errors.
    What may be among a row's best is computed in double precision.
    """
    order = np.argsort(col_chunks, kind="stable")
    cols, col_chunks = cols[order], col_chunks[order]
    starts = np.flatnonzero(np.r_[True, col_chunks[1:] != col_chunks[:-1]]) if len(cols) else np.zeros(0, np.int64)
    names, many = col_chunks[starts], len(starts) < len(col_chunks)
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(cols)]))
    code_r, scale_r, err_r = quantise(rows)
    code_c, scale_c, err_c = quantise(cols)
    out_row, out_name, out_sim = [], [], []
    width = 4096
    for i in range(0, len(rows), 1024):
        a = slice(i, i + 1024)
        heaps_key = np.zeros((len(rows[a]), 0), np.int64)
        for j in range(0, len(cols), width):
            b = slice(j, j + width)
            near = int8_product(code_r[a], code_c[b]).astype(np.float32)
            near *= scale_r[a].astype(np.float32)[:, None]
            near *= scale_c[b].astype(np.float32)[None, :]
            # |x.y - near| <= err_x |near y| + err_y |x|
            slack = (1.02 * err_r[a].astype(np.float32)[:, None] + 1.02 * err_c[b].astype(np.float32)[None, :]) + np.float32(1e-5)
            mine = row_chunks[a][:, None] == col_chunks[b][None, :]
            high = near + slack
            high[mine] = -3.0
            low = near - slack
            low[mine] = -3.0
            floor = np.full(len(near), threshold - _ROUND, np.float32)
            if not many and near.shape[1] > k:  # with several vectors of a chunk, k vectors may be fewer chunks
                floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k] - np.float32(2e-6))
            mask = high >= floor[:, None]
            if mask.sum() * 8 > mask.size:
                r, c = np.nonzero(mask)
                sims = (rows[a] @ cols[b].T)[r, c]
            else:
                r, c = np.nonzero(mask)
                sims = np.empty(len(r))
                for h in range(0, len(r), 65536):
                    p, q = r[h : h + 65536] + i, c[h : h + 65536] + j
                    sims[h : h + 65536] = np.einsum("ij,ij->i", rows[p], cols[q])
            # one whole number orders by similarity at 6 places, then by chunk: its place in ``names`` counts down
            key = (np.rint(sims * 1e6).astype(np.int64) << 32) + (len(names) - group[c + j])
            ok = key >= np.int64(round(threshold * 1e6)) << 32
            r, key = r[ok], key[ok]
            top = _k_greatest(r, key, len(near), k, many)
            heaps_key = np.concatenate([heaps_key, top], axis=1)
        if heaps_key.shape[1]:
            merged = -np.sort(-heaps_key, axis=1)
            if many:
                merged = _first_of_each(merged)
            merged = merged[:, :k]
            r, c = np.nonzero(merged > 0)
            key = merged[r, c]
            out_row.append(r + i)
            out_name.append(names[len(names) - (key & 0xFFFFFFFF)])
            out_sim.append((key >> 32) / 1e6)
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_row), np.concatenate(out_name), np.concatenate(out_sim)


def _k_greatest(row: np.ndarray, key: np.ndarray, rows: int, k: int, many: bool) -> np.ndarray:
    """The ``k`` greatest keys of each row, in a matrix filled up with 0; with ``many``, of different chunks."""
    order = np.lexsort((-key, row))
    row, key = row[order], key[order]
    if many and len(row):  # of one chunk the greatest; equal chunks have equal low halves
        low = key & 0xFFFFFFFF
        by = np.lexsort((-key, low, row))
        first = np.r_[True, (row[by][1:] != row[by][:-1]) | (low[by][1:] != low[by][:-1])]
        keep = np.sort(by[first])
        row, key = row[keep], key[keep]
    start = np.searchsorted(row, np.arange(rows))
    place = np.arange(len(row)) - start[row] if len(row) else np.zeros(0, np.int64)
    out = np.zeros((rows, k), np.int64)
    ok = place < k
    out[row[ok], place[ok]] = key[ok]
    return out


def _first_of_each(keys: np.ndarray) -> np.ndarray:
    """Keys of each row in falling order, each chunk once."""
    out = np.zeros_like(keys)
    for i, line in enumerate(keys):
        _, first = np.unique(line & 0xFFFFFFFF, return_index=True)
        kept = line[np.sort(first)]
        out[i, : len(kept)] = kept
    return -np.sort(-out, axis=1)


_NEAR = "a long, va long, b long, sim double"


def tile(table: pa.Table, dim: int, k: int, threshold: float) -> pa.Table:
    """Best chunks ``(a, va, b, sim)`` of the vectors of one tile, from both sides; ``va`` tells vectors of one chunk apart."""
    ids = np.stack([_col(table, "chunk_ord"), _col(table, "h1"), _col(table, "side")], axis=1)
    _, first = np.unique(ids, axis=0, return_index=True)
    ids, x = ids[first], unit(_floats(table["x"], dim)[first].astype(np.float64))
    parts = []
    if ids[0, 2] == 2:
        parts.append((np.arange(len(ids)), np.arange(len(ids))))
    else:
        one, two = np.flatnonzero(ids[:, 2] == 0), np.flatnonzero(ids[:, 2] == 1)
        parts += [(one, two), (two, one)]
    cols = [[], [], [], []]
    for p, q in parts:
        r, name, sim = best_of(x[p], ids[p, 0], x[q], ids[q, 0], k, threshold) if len(p) and len(q) else (p[:0], p[:0], np.zeros(0))
        for c, v in zip(cols, (ids[p[r], 0], ids[p[r], 1], name, sim)):
            c.append(v)
    a, va, b, sim = (np.concatenate(c) for c in cols)
    return pa.table({"a": pa.array(a, pa.int64()), "va": pa.array(va, pa.int64()), "b": pa.array(b, pa.int64()), "sim": pa.array(sim, pa.float64())})


def nearest_lists(
    vectors: DataFrame, ws: Workspace, k: int = K, threshold: float = THRESHOLD, dim: int = DIM, probes: float = PROBES, cell_rows: int | None = CELL_ROWS
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``(a, va, b, sim)``: the ``k`` chunks most similar to each vector, as ``similar_pairs`` finds them, before they become pairs.

    Also all different vectors by hash and chunk, and the hot groups of equal
    ones, of which only the first ``k + 1`` members are listed.
    """
    spark = vectors.sparkSession
    rows = _hashed(vectors, dim)

    def names(batches):
        for b in batches:
            _, ids = _usable(b, dim)
            yield pa.RecordBatch.from_arrays([pa.array(ids[:, i]) for i in range(3)], names=["h1", "h2", "chunk_ord"])

    ids = ws.cut(rows.mapInArrow(names, "h1 long, h2 long, chunk_ord long").distinct(), "ids")
    n = ids.count()
    if not n:
        return spark.createDataFrame([], _NEAR), ids, None
    groups = ids.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("w")).where(F.col("w") > max(HOT_LEAST, k + 1, n * HOT_SHARE))
    groups = ws.cut(groups, "hot")
    members = Window.partitionBy("h1", "h2").orderBy("chunk_ord")
    # the first members of fewer than 1 / HOT_SHARE groups
    first = ids.join(F.broadcast(groups.select("h1", "h2")), ["h1", "h2"], "left_semi").withColumn("place", F.row_number().over(members)).where(F.col("place") <= k + 1)
    kept: dict[tuple[int, int], list[int]] = {}
    for h1, h2, c, _ in first.collect():
        kept.setdefault((h1, h2), []).append(c)
    hot = np.asarray(sorted(h1 for h1, _ in kept), np.int64)
    wanted = 1 if cell_rows is None else int(min(MOST_CELLS, max(LEAST_CELLS, n * probes / cell_rows)))
    cells = spark.sparkContext.broadcast(make_cells(rows, n, dim, wanted, probes))
    most = max(MOST_PROBES, math.ceil(probes))

    def placed(batch):
        """Vectors and ids of what is searched in a batch, and in pairs the row of each and a cell it goes to."""
        m, ids = _usable(batch, dim)
        if len(hot) and len(ids):
            ok = ~np.isin(ids[:, 0], hot)
            for i in np.flatnonzero(~ok):
                ok[i] = ids[i, 2] in kept.get((ids[i, 0], ids[i, 1]), (ids[i, 2],))
            m, ids = m[ok], ids[ok]
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        return m, ids, *(cells.value.of(unit(m).astype(np.float32), most) if len(m) else none)

    def sizes(batches):
        total = np.zeros(cells.value.count, np.int64)
        for b in batches:
            total += np.bincount(placed(b)[3], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    held = rows.mapInArrow(sizes, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    blocks = np.ones(cells.value.count, np.int64)
    for cell, size in held.where(F.col("n") > BLOCK).collect():  # a row for each large cell
        blocks[cell] = -(-size // BLOCK)

    def spread(batches):
        for b in batches:
            m, ids, row, cell = placed(b)
            nb = blocks[cell]
            block = (ids[row, 0].astype(np.uint64) % nb.astype(np.uint64)).astype(np.int64)
            at = np.repeat(np.arange(len(row)), nb)  # once for each block of the cell
            other = np.arange(len(at)) - np.repeat(np.cumsum(nb) - nb, nb)
            mine = block[at]
            side = np.where(mine == other, 2, np.where(mine < other, 0, 1))  # a block meets itself in a tile of its own
            cols = [cell[at], np.minimum(mine, other), np.maximum(mine, other), side, ids[row[at], 2], ids[row[at], 0]]
            x = _binary(m.astype(np.float32)[row[at]])
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), x], names=["cell", "bi", "bj", "side", "chunk_ord", "h1", "x"])

    sent = rows.mapInArrow(spread, "cell long, bi long, bj long, side long, chunk_ord long, h1 long, x binary")
    near = sent.groupBy("cell", "bi", "bj").applyInArrow(lambda t: tile(t, dim, k, threshold), _NEAR)
    # a pair that several tiles found has one similarity
    near = near.repartition("a", "va").groupBy("a", "va", "b").agg(F.max("sim").alias("sim"))
    best = Window.partitionBy("a", "va").orderBy(F.col("sim").desc(), "b")
    near = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")
    return ws.cut(near, "near"), ids, groups


def similar_pairs(
    vectors: DataFrame, ws: Workspace, k: int = K, threshold: float = THRESHOLD, dim: int = DIM, probes: float = PROBES, cell_rows: int | None = CELL_ROWS
) -> DataFrame:
    """``(chunk_ord_a, chunk_ord_b)`` with a < b, of which one is among the ``k`` most similar of the other.

    Usable vectors have ``dim`` finite numbers, not all 0; others, and rows with
    a null ``chunk_ord``, are passed over. Similarity is the cosine rounded to 6
    places, at least ``threshold``; ties go to the smaller ``chunk_ord``.
    Different vectors of one ``chunk_ord`` are searched each on its own; a chunk
    is never paired with itself.

    Each vector goes to the cells near it, ``probes`` on average, more if it lies
    between cells; vectors that share a cell are compared, and pairs that share none are missed (see the README for how
    many). The number of cells grows with that of the vectors, so cells keep
    their size. A cell is one tile, or if it is larger than ``BLOCK`` a tile for
    every two of its blocks. In a tile, an int8 product bounds all similarities;
    survivors are computed in double precision, and each vector keeps its ``k``
    best, so a tile gives out no more than ``k`` rows for each of its vectors
    and side, however alike they are. Lists of all tiles are merged.
    ``cell_rows`` None compares all vectors with all, in blocks, and misses none.

    Of a large group of equal vectors only the first ``k + 1`` members are
    searched. Every other one has the same ``k`` best: the first of all chunks at
    similarity 1, which one list of a searched member, and that member, hold.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    near, ids, groups = nearest_lists(vectors, ws, k, threshold, dim, probes, cell_rows)
    pairs = near.select("a", "b")
    if groups is not None and groups.count():
        inside = ids.join(F.broadcast(groups), ["h1", "h2"])
        members = Window.partitionBy("h1", "h2").orderBy("chunk_ord")
        first = inside.groupBy("h1", "h2").agg(F.min("chunk_ord").alias("a"))
        ones = first.join(near.where(F.col("sim") == 1.0), (first["a"] == near["a"]) & (first["h1"] == near["va"])).select("h1", "h2", "b")
        ones = ones.unionByName(first.select("h1", "h2", F.col("a").alias("b")))
        top = ones.withColumn("p", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("b"))).where(F.col("p") <= k)
        top = top.groupBy("h1", "h2").agg(F.collect_list("b").alias("best")).join(groups, ["h1", "h2"])
        searched = inside.withColumn("p", F.row_number().over(members)).where(F.col("p") <= k + 1).select("h1", "h2", "chunk_ord")
        others = inside.select("h1", "h2", "chunk_ord").join(F.broadcast(searched), ["h1", "h2", "chunk_ord"], "left_anti")
        spread = keyed_lookup(others, top, ["h1", "h2"], "w", ids.count())
        pairs = pairs.unionByName(spread.select(F.col("chunk_ord").alias("a"), F.explode("best").alias("b")))
    pairs = pairs.where("a <> b")  # chunks with several vectors may meet themselves
    return pairs.select(F.least("a", "b").alias("chunk_ord_a"), F.greatest("a", "b").alias("chunk_ord_b")).distinct()
