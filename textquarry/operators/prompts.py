"""Prompts from retrieved sources, within a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 3000
#: Different sources (about 100 bytes each) that are sent to the files; for more, cited files are shuffled.
BROADCAST_SOURCES = 200_000
INSTRUCTION = (
    "Answer the question from the context below and from nothing else. If the context does not hold the answer, "
    "say that it does not. Be brief and keep to what was asked."
)


def text_slice(text: Column, first: Column, last: Column) -> Column:
    """``text[first:last]``: offsets out of range are clamped."""
    return F.substring(text, (F.greatest(first, F.lit(0)) + 1).cast("int"), F.greatest(last - F.greatest(first, F.lit(0)), F.lit(0)).cast("int"))


def source_texts(results: DataFrame, files: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """``(question_id, rank, file_path, slice)`` of every retrieved source; unreadable files give an empty slice.

    ``files``: ``(file_path, text)``, each path once. The different sources are
    counted: up to ``BROADCAST_SOURCES`` they are sent to the files, which are
    cut where they are, so that only slices are shuffled. More of them are
    joined by path, each once however often it is cited, with the cited files
    alone.
    """
    extra = extra or []
    src = results.select("question_id", *extra, F.posexplode("retrieved_sources").alias("rank", "src"))
    src = src.select("question_id", *extra, (F.col("rank") + 1).alias("rank"), "src.*")
    place = ["file_path", "first_character_index", "last_character_index"]
    cited = src.select(*place).where(F.col("file_path").isNotNull()).distinct()
    few = cited.count() <= BROADCAST_SOURCES
    if not few:
        files = files.join(cited.select("file_path").distinct(), "file_path", "left_semi")
    # names of their own: both sides come from the same rows, so the columns' origins don't tell them apart
    own = [f"_{c}" for c in place]
    wanted = cited.select(*(F.col(c).alias(o) for c, o in zip(place, own)))
    cut = text_slice(F.col("text"), F.col(own[1]), F.col(own[2]))
    slices = files.select(F.col("file_path").alias(own[0]), "text").join(F.broadcast(wanted) if few else wanted, own[0]).select(*own, cut.alias("slice"))
    same = [F.col(c).eqNullSafe(F.col(o)) for c, o in zip(place, own)]
    rows = src.join(slices, same[0] & same[1] & same[2], "left")
    return rows.select("question_id", *extra, "rank", "file_path", F.coalesce("slice", F.lit("")).alias("slice"))


def prompt_blocks(results: DataFrame, files: DataFrame, budget: int = BUDGET, key: str = "question_id") -> DataFrame:
    """``(question_id, block_no, block)``: the blocks that fit, in rank order.

    Empty slices are skipped. The first block is always kept; the others as
    long as all blocks so far, headers included, stay within ``budget``.
    """
    rows = source_texts(results, files).where(F.col("slice") != "")
    rows = rows.withColumn("block", F.concat(F.lit("[Source: "), "file_path", F.lit("]\n"), "slice"))
    order = Window.partitionBy(key).orderBy("rank")
    total = F.sum(F.length("block")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("block_no", F.row_number().over(order)).withColumn("total", total)
    return rows.where((F.col("total") <= budget) | (F.col("block_no") == 1)).select(key, "block_no", "block")


def prompts(results: DataFrame, files: DataFrame, budget: int = BUDGET, instruction: str = INSTRUCTION) -> DataFrame:
    """``(question_id, prompt)`` for every row of ``results (question_id, question, retrieved_sources)``."""
    blocks = prompt_blocks(results, files, budget).groupBy("question_id")
    blocks = blocks.agg(F.array_sort(F.collect_list(F.struct("block_no", "block"))).alias("b"))
    context = F.coalesce(F.array_join(F.transform("b", lambda x: x["block"]), "\n\n"), F.lit(""))
    text = F.concat(F.lit(instruction + "\n\nContext:\n"), context, F.lit("\n\nQuestion: "), F.coalesce("question", F.lit("")), F.lit("\nAnswer:"))
    return results.select("question_id", "question").join(blocks, "question_id", "left").select("question_id", text.alias("prompt"))
