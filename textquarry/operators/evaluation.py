"""Recall of retrieved sources against known ones, by overlap of spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import iou

IOU_THRESHOLD = 0.05
RECALL_KS = (1, 3, 5, 10)


def overlaps(truth: DataFrame, results: DataFrame) -> DataFrame:
    """``(question_id, gt_no, rank, iou)`` of true and retrieved spans of a question that meet at all.

    Both have ``question_id`` and an array of sources, ``sources`` and
    ``retrieved_sources``. Spans are joined on question and file, so only spans
    of one file meet.
    """
    a = truth.select("question_id", F.posexplode("sources").alias("gt_no", "gt")).withColumn("file_path", F.col("gt.file_path"))
    b = results.select("question_id", F.posexplode("retrieved_sources").alias("rank", "hit")).withColumn("file_path", F.col("hit.file_path"))
    pairs = a.join(b.withColumn("rank", F.col("rank") + 1), ["question_id", "file_path"])
    return pairs.select("question_id", "gt_no", "rank", F.round(iou(F.col("gt"), F.col("hit")), 6).alias("iou")).where("iou > 0")


def recall(truth: DataFrame, results: DataFrame, ks: tuple[int, ...] = RECALL_KS) -> DataFrame:
    """``(question_id, k, recall)`` for each row of ``results`` and each k.

    The share of a question's true sources that one of the first k retrieved
    ones overlaps with at least ``IOU_THRESHOLD``; null without true sources.
    Result rows without known truth are skipped; several result rows of a
    question count each. Truth rows without ``sources`` or ``answer`` are
    unanswered and ignored; of several rows with one id the last counts (by
    ``q_ord``, where there is one).
    """

    def hits(k: int):
        found = F.slice(F.col("retrieved_sources"), 1, k)
        return F.size(F.filter("sources", lambda g: F.exists(found, lambda h: iou(g, h) >= IOU_THRESHOLD)))

    answered = truth.where(F.col("sources").isNotNull() & F.col("answer").isNotNull())
    if "q_ord" in truth.columns:
        last = Window.partitionBy("question_id").orderBy(F.col("q_ord").desc())
        answered = answered.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    pairs = results.select("question_id", "retrieved_sources").join(answered.select("question_id", "sources"), "question_id")
    by_k = F.array(*(F.struct(F.lit(k).alias("k"), hits(k).alias("hits")) for k in ks))
    rows = pairs.select("question_id", F.size("sources").alias("n"), F.explode(by_k).alias("r"))
    share = F.when(F.col("n") > 0, F.round(F.col("r.hits") / F.col("n"), 6))
    return rows.select("question_id", F.col("r.k").cast("int").alias("k"), share.alias("recall"))


def mean_recall(truth: DataFrame, results: DataFrame, ks: tuple[int, ...] = RECALL_KS) -> DataFrame:
    """``(k, recall)``: mean over result rows with a defined recall, 0.0 if there are none; k ascending."""
    spark = truth.sparkSession
    means = recall(truth, results, ks).groupBy("k").agg(F.avg("recall").alias("r"))
    every = spark.createDataFrame([(k,) for k in sorted(ks)], "k int")
    return every.join(means, "k", "left").select("k", F.round(F.coalesce("r", F.lit(0.0)), 6).alias("recall")).orderBy("k")
