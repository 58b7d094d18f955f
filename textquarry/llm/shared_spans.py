"""Long exact spans shared between records: seed and extend on winnowed anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.skew import keyed_lookup
from ..plans.workspace import Workspace
from .winnow import anchors

MIN_LENGTH, GRAM = 400, 100
#: Open classes up to this number are broadcast to the texts (a row has 60 bytes); for more, the texts are shuffled.
BROADCAST_CLASSES = 100_000
CLASS = ["h", "rl", "rh", "ctx"]


def anchor_table(documents: DataFrame, min_length: int, gram: int) -> DataFrame:
    """``(h, rl, rh, ctx, doc_id, pos)`` of every anchor of every text.

    ``h`` is the hash of the anchor's gram. The windows of ``min_length``
    characters that pick the anchor start ``rl`` to ``rh`` characters before
    it; ``ctx`` is the hash of all they cover.
    """
    w = min_length - gram + 1
    names = [*CLASS, "doc_id", "pos"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for pos, first, last, h, hashes, shift in anchors(text.as_py(), gram, w):
                    ctx = hashes.of(first, last + min_length)
                    parts.append([h.view(np.int64), pos - first, pos - last, ctx.view(np.int64), np.full(len(pos), doc_id), pos + shift])
            cols = [np.concatenate(c) for c in zip(*parts)] if parts else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    texts = documents.where(F.col("doc_id").isNotNull() & (F.length("text") >= min_length)).select("doc_id", "text")
    return texts.mapInArrow(run, "h long, rl int, rh int, ctx long, doc_id long, pos long")


def _slice(start: Column, length: Column) -> Column:
    return F.xxhash64(F.substring(F.col("text"), start + 1, length))


def _extend(open_rows: DataFrame, ws: Workspace, min_length: int) -> DataFrame:
    """``(CLASS, a, b)``: ranges of shared windows of the classes that one document alone holds.

    ``open_rows``: ``(CLASS, dmin, dmax, text)``, a class of equal anchor
    surroundings each, with the least and greatest document that hold it.
    A window is named by how far before the anchor it starts. Ranges of windows
    on a fixed grid are tested, finer from round to round: if what all windows of
    a range cover together is found in two documents, all are shared; if what
    they have in common is found in one only, none is; else the range is cut
    further. So each match is followed outwards from its anchor to its exact
    ends without any pair of documents being formed.
    """
    spark = open_rows.sparkSession
    size = 1
    sizes = [1]
    while size * 4 < min_length // 2:
        size *= 2 if size == 1 else 4
        sizes.insert(0, size)
    rows = open_rows.select(
        *CLASS, "dmin", "dmax", "text", F.col("rh").alias("a"), F.col("rl").alias("b"), (F.col("dmin") == F.col("dmax")).alias("target")
    )
    done: DataFrame | None = None
    for size in sizes:
        grid = F.explode(F.sequence(F.floor(F.col("a") / size), F.floor(F.col("b") / size))).alias("j")
        rows = rows.select(*CLASS, "dmin", "dmax", "text", "target", "a", "b", grid).withColumns(
            {"a": F.greatest("a", F.col("j") * size).cast("int"), "b": F.least("b", F.col("j") * size + size - 1).cast("int")}
        )
        rows = rows.withColumn("outer", _slice(F.col("rl") - F.col("b"), F.col("b") - F.col("a") + min_length)).withColumn(
            "core", _slice(F.col("rl") - F.col("j") * size, F.lit(min_length - size + 1))
        )
        rows = ws.cut(rows, f"ranges-{size}")
        count = rows.count()
        if not count:
            break
        both = [F.min("dmin").alias("lo"), F.max("dmax").alias("hi"), F.count(F.lit(1)).alias("w")]
        whole = rows.groupBy("h", "j", "a", "b", "outer").agg(*both)
        seen = keyed_lookup(rows, whole, ["h", "j", "a", "b", "outer"], "w", count)
        found = (F.col("lo") < F.col("hi")).alias("found")
        seen = ws.cut(seen.select(*rows.columns, found), f"tested-{size}")
        hits = seen.where("target and found").select(*CLASS, "a", "b")
        done = hits if done is None else done.unionByName(hits)
        if size == 1:
            break
        left = F.max(F.col("target") & ~F.col("found")).alias("left")
        common = seen.groupBy("h", "j", "core").agg(*both, left).where("lo < hi and left").drop("lo", "hi", "left")
        kept = keyed_lookup(seen, common, ["h", "j", "core"], "w", count)
        rows = kept.withColumn("target", F.col("target") & ~F.col("found")).drop("w", "found", "outer", "core", "j")
    if done is None:
        done = spark.createDataFrame([], "h long, rl int, rh int, ctx long, a int, b int")
    return done


def merged(intervals: DataFrame) -> DataFrame:
    """``(doc_id, span_start, span_end)``: runs of touching or overlapping intervals ``(doc_id, s, e)``."""
    ordered = Window.partitionBy("doc_id").orderBy("s", "e")
    before = F.max("e").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(before >= F.col("s"), 0).otherwise(1)
    run = F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return (
        intervals.distinct().withColumn("new", starts).withColumn("run", run).groupBy("doc_id", "run")
        .agg(F.min("s").alias("span_start"), F.max("e").alias("span_end")).drop("run")
    )


def shared_spans(documents: DataFrame, ws: Workspace, min_length: int = MIN_LENGTH, gram: int = GRAM) -> DataFrame:
    """``(doc_id, span_start, span_end)``: maximal runs of characters that lie in shared stretches.

    A stretch is shared if it has ``min_length`` or more code points and occurs
    verbatim in another document. ``doc_id`` must be unique. Null ``doc_id`` or
    ``text`` and texts below ``min_length`` give no rows; texts are taken whole.

    Documents are joined on winnowed anchors. Anchors with equal surroundings
    form one class, so copies of a passage, however many, are one row from then
    on; a class held by two documents is settled at once. Other classes of an
    anchor that several documents have are extended (``_extend``). Texts are
    read twice: for the anchors, and for the surroundings of the classes still
    open. No step forms pairs of documents or gathers a group in one task.
    """
    if not 0 < gram <= min_length:
        raise ValueError("gram must be positive and not above min_length")
    table = ws.cut(anchor_table(documents, min_length, gram), "anchors")
    count = table.count()
    by_hash = table.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("w"))
    by_hash = ws.cut(by_hash.where("lo < hi").select("h", "w"), "seeds")
    shared = ws.cut(keyed_lookup(table, by_hash, ["h"], "w", count).drop("w"), "shared")
    ws.drop("anchors")
    members = shared.count()
    rep = F.min(F.struct("doc_id", "pos")).alias("rep")
    doc = [F.min("doc_id").alias("dmin"), F.max("doc_id").alias("dmax")]
    classes = ws.cut(shared.groupBy(*CLASS).agg(*doc, F.count(F.lit(1)).alias("w"), rep), "classes")
    settled = classes.where("dmin < dmax").select(*CLASS, "w", F.array(F.struct(F.col("rh").alias("a"), F.col("rl").alias("b"))).alias("r"))

    opened = classes.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("dmin") == F.col("dmax")).alias("open"))
    opened = opened.where("open and n > 1").select("h", "n")
    todo = keyed_lookup(classes.drop("w"), opened, ["h"], "n", classes.count())
    todo = todo.select(*CLASS, "dmin", "dmax", F.col("rep.doc_id").alias("doc_id"), F.col("rep.pos").alias("pos"))
    todo = ws.cut(todo, "unsettled")
    if todo.count() <= BROADCAST_CLASSES:
        todo = F.broadcast(todo)
    texts = documents.where(F.length("text") >= min_length).select("doc_id", "text")
    around = F.substring(F.col("text"), F.col("pos") - F.col("rl") + 1, F.col("rl") - F.col("rh") + min_length)
    todo = ws.cut(todo.join(texts, "doc_id").select(*CLASS, "dmin", "dmax", around.alias("text")), "open")
    ranges = _extend(todo, ws, min_length)
    ranges = ranges.groupBy(*CLASS).agg(F.collect_set(F.struct("a", "b")).alias("r"))
    extended = ranges.join(classes.select(*CLASS, "w"), CLASS).select(*CLASS, "w", "r")

    found = ws.cut(settled.unionByName(extended), "found")
    hits = keyed_lookup(shared, found, CLASS, "w", members)
    hits = hits.select("doc_id", "pos", F.explode("r").alias("r"))
    return merged(hits.select("doc_id", (F.col("pos") - F.col("r.b")).alias("s"), (F.col("pos") - F.col("r.a") + min_length).alias("e")))
