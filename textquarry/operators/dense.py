"""Vectors of chunks: normalisation, cosine ranking and encoders."""

from __future__ import annotations

import re
import zlib
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import has_text

#: Question vectors of one scoring block; their bytes are what a task holds besides its batch.
QUESTION_BLOCK = 4096
#: Questions of a block that a batch is multiplied with at once.
QUESTION_TILE = 256


def l2_normalise(v: Column) -> Column:
    """Unit vector in double precision; a zero vector stays zero, null stays null."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm)).otherwise(d)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that are usable vectors (``dim`` finite numbers, not all 0), as a matrix, and their places."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    places = np.flatnonzero(lengths == dim)
    starts = column.offsets.to_numpy()[places]
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    m = values[starts[:, None] + np.arange(dim)] if len(places) else np.zeros((0, dim))
    good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
    return m[good], places[good]


def cosine_top(
    questions: DataFrame, vectors: DataFrame, k: int, key: str = "chunk_ord", exclude_self: bool = False
) -> DataFrame:
    """``(question_id, key, score, rank)``: the ``k`` vectors of greatest cosine above 0 for each question vector.

    ``questions``: ``(question_id, embedding)``, ``vectors``: ``(key,
    embedding)``. Scores are rounded to 6 places, ties go to the smaller key.
    Null vectors, and those of another length than the questions', are passed
    over. Questions are taken in blocks of bounded size that are sent to all
    tasks; a task scores a batch of vectors against a block in one matrix
    product and keeps each question's ``k`` best, so little is shuffled.
    """
    questions = questions.where(F.col("embedding").isNotNull() & F.col("question_id").isNotNull())
    n = questions.count()
    blocks = -(-n // QUESTION_BLOCK) or 1
    kind = dict(vectors.dtypes)[key]
    qkind = dict(questions.dtypes)["question_id"]
    rows = vectors.where(F.col("embedding").isNotNull() & F.col(key).isNotNull()).select(key, "embedding")
    out: DataFrame | None = None
    for i in range(blocks):
        own = questions if blocks == 1 else questions.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == i)
        block = own.select("question_id", "embedding").toArrow().combine_chunks()
        ids, asked = (block.column(c).combine_chunks() for c in range(2))
        by_size = {}
        for d in {n.as_py() for n in asked.value_lengths().unique()}:
            m, at = matrix(asked, d)
            by_size[d] = ids.take(pa.array(at)).to_pylist(), _units(m)
        held = rows.sparkSession.sparkContext.broadcast(by_size)

        def score(batches, held=held):
            for b in batches:
                got: list[tuple[list, list, np.ndarray]] = []
                for d, (ids, q) in held.value.items():
                    m, at = matrix(b.column(1), d)
                    if not len(at) or not d:
                        continue
                    own_keys = b.column(0).take(pa.array(at))
                    order = np.asarray(pc.sort_indices(own_keys))
                    own_keys = own_keys.take(pa.array(order))
                    units = _units(m[order])
                    for j in range(0, len(q), QUESTION_TILE):
                        s = np.round(units @ q[j : j + QUESTION_TILE].T, 6)
                        r, c = _best(s, k + 1)
                        got.append(([ids[j + x] for x in c], own_keys.take(pa.array(r)).to_pylist(), s[r, c]))
                cols = [pa.array([x for g in got for x in g[i]], kind) for i, kind in enumerate((_arrow(qkind), _arrow(kind), pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["question_id", key, "score"])

        part = rows.mapInArrow(score, f"question_id {qkind}, `{key}` {kind}, score double")
        out = part if out is None else out.unionByName(part)
    if exclude_self:
        out = out.where(F.col("question_id") != F.col(key))
    order = Window.partitionBy("question_id").orderBy(F.col("score").desc(), key)
    out = out.repartition("question_id").distinct()  # one shuffle for both
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``m`` greatest values above 0 of each column; at ties the upper rows."""
    n = len(s)
    edge = np.partition(s, n - m, axis=0)[n - m] if n > m else np.full(s.shape[1], -2.0)
    mask = (s >= edge) & (s > 0)
    for c in np.flatnonzero(mask.sum(axis=0) > m):
        ties = np.flatnonzero(mask[:, c] & (s[:, c] == edge[c]))
        mask[ties[m - int((mask[:, c] & (s[:, c] > edge[c])).sum()) :], c] = False
    return np.nonzero(mask)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def _units(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True, initial=1e-300)  # so that squares neither overflow nor vanish
    return m / np.linalg.norm(m, axis=1, keepdims=True)


class Encoder(Protocol):
    """Maps texts to vectors; must be picklable. Loaded models belong into a module global of the worker."""

    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEncoder:
    """Stand-in that needs no model: signed counts of token hashes, normalised. It knows no meaning."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"[A-Za-z0-9_]+", t or ""):
                h = zlib.crc32(w.lower().encode())
                out[i, h % self.dim] += 1.0 if h & 0x80000000 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1.0)


def embed(rows: DataFrame, encoder: Encoder, key: str, text: str, batch: int = 64) -> DataFrame:
    """``(key, embedding)``; null texts are encoded as empty ones."""
    kind = dict(rows.dtypes)[key]

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            made = [encoder.encode(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            vectors = np.concatenate(made).astype(np.float32).tolist() if made else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=[key, "embedding"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, embedding array<float>")


def embed_questions(questions: DataFrame, encoder: Encoder) -> DataFrame:
    """``(question_id, embedding)`` of the questions that have any text."""
    return embed(questions.where(has_text(F.col("question"))), encoder, "question_id", "question")
