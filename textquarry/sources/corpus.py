"""A directory tree of source and text files as a table (Python data source ``corpus``).

Spark's own file sources skip names that begin with ``_`` or ``.``, keep
``\\r\\n`` and fail on, or keep, invalid bytes; here such files are listed,
line ends become ``\\n``, and invalid bytes are dropped. Trees may lie on any
file system that Arrow knows (``hdfs://``, ``s3://``, ``gs://``, ``file:``, or
a plain path that all executors can read). Subtrees are listed in tasks, and
bodies are read in tasks, from a listing and only where they are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Directories (and files) of these names are left out, with all below them. Fixed values.
EXCLUDED_DIRS = (".git", ".github", ".buildkite", "__pycache__", "csrc", "cmake", "docker", "tests")
# Which chunker a suffix goes to. Fixed values.
KINDS = {".py": "python", ".md": "markdown", ".txt": "markdown"}

LISTING = "file_path string, kind string, mtime double, size long"
#: The driver lists level by level until it has so many directories for each task; what lies below is walked in tasks.
SUBTREES = 16
#: Bytes of files that one task reads.
READ_BYTES = 64 << 20


def suffix_of(name: str) -> str:
    """Suffix of a file name as ``pathlib`` has it: none for ``.py`` or ``a.``."""
    dot = name.rfind(".")
    return name[dot:] if 0 < dot < len(name) - 1 else ""


class Tree:
    """Files below a path, which are named as the path is spelled."""

    def __init__(self, root: str):
        self.root = root.rstrip("/") or "/"
        if "://" in root or root.startswith("file:"):
            uri = root if "://" in root else "file://" + root[5:]
            self.fs, self.base = pafs.FileSystem.from_uri(uri.rstrip("/"))
        else:
            self.fs, self.base = pafs.LocalFileSystem(), self.root

    def inner(self, path: str) -> str:
        """A path as the file system has it."""
        return self.base + path[len(self.root) :]

    def list(self, directory: str) -> tuple[list[str], list[tuple]]:
        """Directories to go into, and rows of the files to index, right below ``directory``."""
        dirs, rows = [], []
        for info in self.fs.get_file_info(pafs.FileSelector(self.inner(directory), allow_not_found=True)):
            if info.base_name in EXCLUDED_DIRS:
                continue
            path = f"{directory.rstrip('/')}/{info.base_name}"
            if info.type == pafs.FileType.Directory:
                dirs.append(path)
            elif info.type == pafs.FileType.File and (kind := KINDS.get(suffix_of(info.base_name))):
                rows.append((path, kind, (info.mtime_ns or 0) / 1e9, int(info.size)))
        return dirs, rows

    def walk(self, directory: str):
        todo = [directory]
        while todo:
            dirs, rows = self.list(todo.pop())
            todo += dirs
            yield from rows

    def read(self, path: str) -> str | None:
        """Text of a file; None if it is gone or can't be read."""
        try:
            with self.fs.open_input_stream(self.inner(path)) as f:
                data = f.read()
        except OSError:
            return None
        return data.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")


@dataclass
class _Part(InputPartition):
    directories: list[tuple[str, bool]]  # path, and whether all below it belongs to it


class _Reader(DataSourceReader):
    def __init__(self, root: str, tasks: int):
        self.root, self.tasks = root, tasks

    def partitions(self):
        tree = Tree(self.root)
        seen, level = [], [tree.root]
        while level and len(level) < SUBTREES * self.tasks:
            seen += level
            level = [d for x in level for d in tree.list(x)[0]]
        places = [(d, False) for d in seen] + [(d, True) for d in level]
        return [_Part(p) for i in range(self.tasks) if (p := places[i :: self.tasks])]

    def read(self, partition):
        tree = Tree(self.root)
        for directory, below in partition.directories:
            yield from tree.walk(directory) if below else tree.list(directory)[1]


class CorpusSource(DataSource):
    """``spark.read.format("corpus").load(root)``: the listing; ``with_texts`` adds the bodies."""

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("tasks", "8")))


def list_corpus(spark: SparkSession, root: str) -> DataFrame:
    """``(file_path, kind, mtime, size)`` of the files to index below ``root``; no body is read."""
    spark.dataSource.register(CorpusSource)
    return spark.read.format("corpus").option("tasks", spark.sparkContext.defaultParallelism).load(root)


def with_texts(listing: DataFrame, root: str, total_bytes: int | None = None) -> DataFrame:
    """Adds ``text``; files that can't be read have no row. Only the files of ``listing`` are opened.

    ``total_bytes``, where it is known, spreads the files over as many tasks as
    their bodies need, whatever tasks the listing lies in.
    """
    if total_bytes is not None:
        least = listing.sparkSession.sparkContext.defaultParallelism
        listing = listing.repartition(max(least, -(-total_bytes // READ_BYTES)), "file_path")

    def run(batches):
        tree = Tree(root)
        for b in batches:
            texts = pa.array([tree.read(p) for p in b.column("file_path").to_pylist()], pa.string())
            keep = texts.is_valid()
            full = pa.RecordBatch.from_arrays([*b.columns, texts], names=[*b.schema.names, "text"])
            yield full.filter(keep)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listing.schema)
    return listing.mapInArrow(run, f"{schema}, text string")


def write_tree(files: DataFrame, root: str) -> None:
    """Writes ``files (file_path, text)`` as a tree below ``root``, in tasks; null texts as empty files."""

    def run(batches):
        tree = Tree(root)
        n = 0
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = tree.inner(f"{tree.root}/{path}")
                tree.fs.create_dir(at.rpartition("/")[0], recursive=True)
                with tree.fs.open_output_stream(at) as f:
                    f.write((text or "").encode("utf-8", "surrogatepass"))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    files.select("file_path", "text").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """The listing with ``text``."""
    return with_texts(list_corpus(spark, root), root)


def chunkable(path: Column) -> Column:
    """The same choice for a column of paths relative to the root."""
    excluded = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, EXCLUDED_DIRS)))
    return F.coalesce(~excluded & kind_of_path(path).isNotNull(), F.lit(False))


def kind_of_path(path: Column) -> Column:
    suffix = F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)
    out = F.lit(None).cast("string")
    for s, kind in KINDS.items():
        out = F.when(suffix == s, kind).otherwise(out)
    return out
