"""Files to chunks: markdown by paragraphs, Python by syntax."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import check_size, markdown_spans
from ..plans.workspace import Workspace

MAX_CHUNK_SIZE = 2000
#: Folds in the JVM take time in the square of the number of chunks; longer texts are cut by the equivalent functions here.
LONG_TEXT = 100_000

_BREAK = re.compile(r"\n{2,}")


def cut_hard(start: int, end: int, size: int) -> list[tuple[int, int]]:
    return [(k, min(k + size, end)) for k in range(start, end, size)]


def cut_lines(text: str, start: int, end: int, size: int) -> list[tuple[int, int]]:
    """Whole lines of ``text[start:end]`` packed into spans of at most ``size``."""
    out: list[tuple[int, int]] = []
    first = at = start
    while at < end:
        stop = text.find("\n", at, end) + 1 or end
        if stop - at > size or stop - first > size:
            if at > first:
                out.append((first, at))
            first = at
        if stop - at > size:
            out.extend(cut_hard(at, stop, size))
            first = stop
        at = stop
    if end > first:
        out.append((first, end))
    return out


@dataclass
class Block:
    """A stretch of a text and the blocks it may be cut into if it is too long."""

    start: int
    end: int
    parts: tuple["Block", ...] = ()


def fitted(text: str, blocks: Sequence[Block], size: int) -> Iterator[tuple[int, int]]:
    """Spans of runs of neighbouring blocks, as many in each as ``size`` holds, gaps included.

    A block that is longer by itself is cut into its parts, one without parts at lines.
    """
    at = 0
    while at < len(blocks):
        one = blocks[at]
        most = one.start + size
        stop = at + 1
        while stop < len(blocks) and blocks[stop].end <= most:
            stop += 1
        if blocks[stop - 1].end <= most:
            yield one.start, blocks[stop - 1].end
        elif one.parts:
            yield from fitted(text, one.parts, size)
        else:
            yield from cut_lines(text, one.start, one.end, size)
        at = stop


def cut_markdown(text: str, size: int = MAX_CHUNK_SIZE) -> list[tuple[int, int]]:
    check_size(size)
    paragraphs, at = [], 0
    for m in [*_BREAK.finditer(text), None]:
        end = m.start() if m else len(text)
        if text[at:end].strip():
            paragraphs.append(Block(at, end))
        at = m.end() if m else end
    return list(fitted(text, paragraphs, size))


def statement_blocks(text: str, compat_splitlines: bool = False) -> list[Block]:
    """The top-level statements of Python source as whole lines, decorators included; a class has its members as parts."""
    lines = text.splitlines(keepends=True) if compat_splitlines else text.split("\n")
    ends = list(accumulate((len(x) for x in lines) if compat_splitlines else (len(x) + 1 for x in lines), initial=0))
    ends = [min(x, len(text)) for x in ends]

    def block(statement: ast.stmt, inside: bool) -> Block:
        head = min(x.lineno for x in (statement, *getattr(statement, "decorator_list", ())))
        parts = tuple(block(x, True) for x in statement.body) if isinstance(statement, ast.ClassDef) and not inside else ()
        return Block(ends[head - 1], ends[min(statement.end_lineno, len(ends) - 1)], parts)

    return [block(x, False) for x in ast.parse(text).body]


def cut_python(text: str, size: int = MAX_CHUNK_SIZE, compat_splitlines: bool = False) -> list[tuple[int, int]]:
    """Spans of top-level statements, whole lines, packed up to ``size``.

    A class above the limit is cut into its members; anything else above it at
    lines. Source that doesn't parse is cut at lines. Lines end at line feeds;
    ``compat_splitlines`` counts form feeds and the like as line ends too, which
    shifts spans in files that have them.
    """
    check_size(size)
    if not text.strip():
        return []
    try:
        return list(fitted(text, statement_blocks(text, compat_splitlines), size))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return cut_lines(text, 0, len(text), size)


def _cut_in_python(files: DataFrame, cut, size: int) -> DataFrame:
    def run(batches):
        for b in batches:
            spans = [[{"s": s, "e": e} for s, e in cut(t.as_py(), size)] if t.is_valid else [] for t in b.column("text")]
            kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, kind)], names=[*b.schema.names, "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{schema}, spans array<struct<s:int,e:int>>")


def chunk_files(files: DataFrame, size: int = MAX_CHUNK_SIZE, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(file_path, chunk_in_file, first_character_index, last_character_index, text)`` and the columns ``keep`` of the file.

    ``files``: ``(file_path, kind, text)``, each path once; other columns are
    ignored. Kinds other than python and markdown, null kinds, paths and texts,
    and blank texts give no chunks. Markdown is cut in the JVM, Python source
    (and texts above ``LONG_TEXT``) in Arrow batches; nothing is shuffled.
    """
    check_size(size)
    files = files.select("file_path", "kind", "text", *keep).where(F.col("text").isNotNull() & F.col("file_path").isNotNull())
    long = F.length("text") > LONG_TEXT
    native = files.where((F.col("kind") == "markdown") & ~long).withColumn("spans", markdown_spans(F.col("text"), size))
    parts = native.unionByName(_cut_in_python(files.where((F.col("kind") == "markdown") & long), cut_markdown, size))
    parts = parts.unionByName(_cut_in_python(files.where(F.col("kind") == "python"), cut_python, size))
    flat = parts.select("file_path", "text", *keep, F.posexplode("spans").alias("chunk_in_file", "x"))
    return flat.select(
        "file_path", "chunk_in_file", F.col("x.s").cast("long").alias("first_character_index"),
        F.col("x.e").cast("long").alias("last_character_index"), F.substring(F.col("text"), F.col("x.s") + 1, F.col("x.e") - F.col("x.s")).alias("text"), *keep,
    )


def path_order(path: str = "file_path"):
    """Sort key of paths: by their components."""
    return F.split(F.col(path), "/")


def number_files(counts: DataFrame, ws: Workspace, weight: str | None = None) -> DataFrame:
    """``counts (file_path, ...)`` with ``start``: how many files, or how much ``weight``, come before each in order of the paths.

    Files are ranged by path and written with their range, which fixes it;
    ranges are then numbered side by side, from the sum over those before
    them. Only one row for each range meets in one task.
    """
    n = F.lit(1) if weight is None else F.col(weight)
    ranged = counts.repartitionByRange(path_order()).withColumn("part", F.spark_partition_id())
    ranged = ws.cut(ranged, "files-by-path")
    until = Window.unboundedPreceding, -1
    parts = ranged.groupBy("part").agg(F.sum(n).alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*until)), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum(n).over(Window.partitionBy("part").orderBy(path_order()).rowsBetween(*until)), F.lit(0))
    placed = ranged.withColumn("own", own).join(F.broadcast(parts), "part")  # a row for each range
    return placed.select(*counts.columns, (F.col("own") + F.col("base")).alias("start"))


def numbered(chunks: DataFrame, ws: Workspace) -> DataFrame:
    """Adds ``chunk_ord``: 0, 1, ... over files in order of their paths and chunks in order within a file."""
    per_file = chunks.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    starts = number_files(per_file, ws, "n").select("file_path", "start")
    return chunks.join(starts, "file_path").withColumn("chunk_ord", F.col("start") + F.col("chunk_in_file")).drop("start")
