"""Weighted reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
LEXICAL_WEIGHT, DENSE_WEIGHT = 10.0, 1.0
CANDIDATE_POOL = 30


def pool_size(k: int) -> int:
    """How many of each ranking enter the fusion for ``k`` results."""
    return max(k, CANDIDATE_POOL)


def fuse(
    *lists: DataFrame, weights: list[float] | None = None, k: int = RRF_K, key: str = "chunk_ord", limit: int | None = None
) -> DataFrame:
    """``(question_id, key, score, rank)``: sum over the lists of ``weight / (k + rank)``, rounded to 6 places.

    Each list has ``question_id``, ``key`` and ``rank`` (from 1); a key that
    stands in one list more than once adds up. Weights default to 1; lists
    beyond the weights given are ignored. Ties keep the order of first
    appearance: the earliest list, there the least rank.
    """
    weights = [1.0] * len(lists) if weights is None else list(weights)
    rows: DataFrame | None = None
    for i, (ranked, w) in enumerate(zip(lists, weights)):
        part = ranked.select("question_id", key, "rank", F.lit(i).alias("list"), F.lit(float(w)).alias("weight"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("nothing to fuse")
    share = F.col("weight") / (F.lit(float(k)) + F.col("rank"))
    fused = rows.groupBy("question_id", key).agg(F.round(F.sum(share), 6).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    order = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "seen", key)
    fused = fused.withColumn("rank", F.row_number().over(order)).drop("seen")
    return fused if limit is None else fused.where(F.col("rank") <= limit)


def hybrid(lexical: DataFrame, dense: DataFrame, k: int, key: str = "chunk_ord") -> DataFrame:
    """Fusion of the two candidate pools with the default weights, cut to ``k``."""
    return fuse(lexical, dense, weights=[LEXICAL_WEIGHT, DENSE_WEIGHT], key=key, limit=k)
