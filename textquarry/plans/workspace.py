"""Lineage cuts: intermediate tables written to the folder all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
``local`` master without that setting gets a temporary folder, since there all
executors are this one process.
"""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """Folder for tables that must outlive an executor."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="textquarry-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return "file://" + made


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _drop(spark: SparkSession, path: str) -> None:
    try:
        delete_path(spark, path)
    except Exception:  # the JVM has gone before this process
        pass


_open: dict[str, SparkSession] = {}


def _sweep(ended_only: bool = True) -> None:
    """Removes the folders of sessions that have ended, or all."""
    for path, spark in list(_open.items()):
        if not ended_only or spark.sparkContext._jsc is None:
            _open.pop(path, None)
            _drop(spark, path)


atexit.register(_sweep, False)


_PATHLESS = {"LocalRelation", "LogicalRDD", "OneRowRelation", "Range"}


def _tables_of(df: DataFrame, root: str) -> set[str] | None:
    """Names below ``root`` that the plan of ``df`` reads; None if the plan doesn't say."""
    own = f"/{root.rpartition('/')[2]}/"
    try:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        found = set()
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            kind = leaf.nodeName()
            if kind == "LogicalRelation":
                for path in leaf.relation().location().rootPaths().mkString("\n").split("\n"):
                    if own in path:
                        found.add(path.split(own, 1)[1].split("/")[0])
            elif kind not in _PATHLESS:
                return None
        return found
    except Exception:
        return None


class Workspace:
    """A query's own subfolder of the shared folder.

    ``cut`` writes a table and gives it back as read from there, so that a lost
    executor never recomputes what lies before it. The folder lives until
    ``close``, or until its session or this process ends: a result, and
    whatever is derived from it, can be read at any time before. ``keep_for``
    removes at once what a result doesn't read.
    """

    def __init__(self, spark: SparkSession, name: str):
        _sweep()
        self.spark = spark
        self.path = f"{shared_root(spark)}/textquarry/{name}-{uuid.uuid4().hex[:12]}"
        _open[self.path] = spark

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def cut(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def drop(self, name: str) -> None:
        _drop(self.spark, self.at(name))

    def keep_for(self, df: DataFrame) -> DataFrame:
        """``df``, after removing the tables of this workspace that its plan doesn't read."""
        needed = _tables_of(df, self.path)
        if needed is not None:
            for name in list_names(self.spark, self.path):
                if name not in needed:
                    self.drop(name)
        return df

    def close(self) -> None:
        _open.pop(self.path, None)
        _drop(self.spark, self.path)


def scoped(query):
    """Turns ``query(spark, sf, ws)`` into ``query(spark, sf)`` whose workspace lives as long as the session."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ws = Workspace(spark, query.__name__)
        try:
            return ws.keep_for(query(spark, sf, ws))
        except BaseException:
            ws.close()
            raise

    return run
