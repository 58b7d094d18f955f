"""Manifests of files and indexing of what changed between two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunking, lexical


def manifest(files: DataFrame) -> DataFrame:
    """``(file_path, mtime, size)``: what a listing says of each file; texts are not read."""
    return files.select("file_path", "mtime", "size").where(F.col("file_path").isNotNull())


def diff_manifests(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """``(file_path, status)``: changed (new, or another mtime or size, compared exactly), unchanged or removed.

    ``old`` None is a first run: all files are changed. Each manifest has a path once.
    """
    state = F.struct("mtime", "size")
    if old is None:
        return new.select("file_path", F.lit("changed").alias("status"))
    a = old.select("file_path", state.alias("was"), F.lit(True).alias("there"))
    b = new.select("file_path", state.alias("now"), F.lit(True).alias("here"))
    both = a.join(b, "file_path", "full_outer")
    status = (
        F.when(F.col("here").isNull(), "removed")
        .when(F.col("there").isNull() | ~F.col("was").eqNullSafe(F.col("now")), "changed")
        .otherwise("unchanged")
    )
    return both.select("file_path", status.alias("status"))


def stable_chunks(files: DataFrame, size: int) -> DataFrame:
    """Chunks of ``files (file_path, file_no, kind, text)`` with ``chunk_ord``, made of the file's number and the place in the file.

    So a chunk's number stays what it is when other files come, change or go.
    """
    number = F.shiftleft(F.col("file_no").cast("long"), lexical.FILE_SHIFT) + F.col("chunk_in_file")
    return chunking.chunk_files(files, size, ("file_no",)).withColumn("chunk_ord", number)


def signed_frequencies(added: DataFrame, removed: DataFrame) -> DataFrame:
    """``(term, df)``: changes of document frequencies, from those of chunks that come and of chunks that go."""
    parts = [p.select("term", (sign * F.col("df")).alias("df")) for p, sign in ((added, 1), (removed, -1))]
    return parts[0].unionByName(parts[1]).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
