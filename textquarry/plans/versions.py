"""Versions of a folder: each is published whole, by one step that only one of several runs can win."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlsplit

from pyspark.sql import SparkSession

from .workspace import _fs, delete_path, list_names


class AlreadyPublished(RuntimeError):
    """Another run has published the version that this run was to publish."""


def _publish(spark: SparkSession, path: str, text: str) -> bool:
    """Creates the file ``path`` with ``text`` in one step; False if it exists.

    The text is written to a file of another name, which then gets the name
    ``path``: on local file systems by a hard link, elsewhere by a rename that
    doesn't overwrite. Both fail, and change nothing, if the name is taken.
    """
    fs, target = _fs(spark, path)
    target = fs.makeQualified(target)
    other = f"{path.rpartition('/')[0]}/_marker-{uuid.uuid4().hex[:12]}"
    if str(target.toUri().getScheme()) == "file":
        there, here = (unquote(urlsplit(str(fs.makeQualified(_fs(spark, p)[1]).toUri())).path) for p in (path, other))
        os.makedirs(os.path.dirname(here), exist_ok=True)
        with open(here, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(here, there)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(here)
    source = _fs(spark, other)[1]
    out = fs.create(source, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    how = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(source, target, how)
        return True
    except Exception:
        if fs.exists(source):
            fs.delete(source, False)
        if fs.exists(target):
            return False
        raise


class Versions:
    """``v1``, ``v2``, ... below ``path``: small files, each naming the folder with that version's data.

    A run stages its data in a folder of its own and then publishes it as the
    version after the one it started from. Until then readers see nothing of
    it. If two runs start from one version, the second to publish gets
    ``AlreadyPublished`` and its data is removed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def numbers(self) -> list[int]:
        return sorted(int(n[1:]) for n in list_names(self.spark, self.path) if n.startswith("v") and n[1:].isdigit())

    def current(self) -> int:
        """The last version; 0 before the first."""
        return max(self.numbers(), default=0)

    def folder(self, version: int) -> str:
        fs, p = _fs(self.spark, f"{self.path}/v{version}")
        stream = fs.open(p)
        try:
            name = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return f"{self.path}/{name.strip()}"

    def stage(self) -> str:
        return f"{self.path}/data-{uuid.uuid4().hex}"

    def publish(self, stage: str, base: int) -> int:
        """Makes ``stage`` the version after ``base``."""
        version = base + 1
        if not _publish(self.spark, f"{self.path}/v{version}", stage.rpartition("/")[2]):
            delete_path(self.spark, stage)
            raise AlreadyPublished(f"version {version} was published by another run")
        return version
