"""Processing only new or changed records: Merkle trees over key ranges.

A snapshot is a set of records ``(key, state columns)``. The keys' 64-bit hash
space is cut into ``16 ** depth`` equal ranges, the leaves; a leaf's digest
combines the digests of its records without regard to order, an inner node's
those of its 16 children. Two snapshots are compared from the root: only
children of differing nodes are looked at, and only records of differing leaves
are compared one by one. ``SnapshotStore`` keeps the last published snapshot
and publishes output, tree and records in one step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.versions import Versions
from ..plans.workspace import Workspace, delete_path

FANOUT_BITS = 4
VERSION = "_version"


def depth_for(records: int, per_leaf: int = 32, most: int = 6) -> int:
    """Levels below the root so that a leaf has about ``per_leaf`` records (16**6 leaves at most)."""
    depth = 1
    while depth < most and records > per_leaf << (FANOUT_BITS * depth):
        depth += 1
    return depth


def leaf_of(keys: list[str], depth: int) -> Column:
    """The key range (of the hash space) that a record belongs to."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - FANOUT_BITS * depth)


def build_tree(records: DataFrame, keys: list[str], state: list[str], depth: int) -> DataFrame:
    """``(_version, level, node, h1, h2, n)`` of every node of every version in ``records``.

    ``records`` must have ``_version`` and ``_leaf``. Nulls and NaN in ``state`` are values like any other.
    """
    marked = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in state]
    exact = [F.col(c) for c in state]
    level = records.groupBy(VERSION, F.col("_leaf").alias("node")).agg(
        F.bit_xor(F.xxhash64(*keys, *exact, *marked)).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit(7), *keys, *exact)).alias("h2"),
        F.count(F.lit(1)).alias("n"),
    )
    levels = [level.select(VERSION, F.lit(depth).alias("level"), "node", "h1", "h2", "n")]
    grown = level
    for d in range(depth - 1, -1, -1):
        grown = grown.groupBy(VERSION, F.shiftrightunsigned("node", FANOUT_BITS).alias("node")).agg(
            F.bit_xor(F.xxhash64("node", "h1", "n")).alias("h1"),
            F.bit_xor(F.xxhash64(F.lit(7), "node", "h2", "n")).alias("h2"),
            F.sum("n").alias("n"),
        )
        levels.append(grown.select(VERSION, F.lit(d).alias("level"), "node", "h1", "h2", "n"))
    tree = levels[0]
    for x in levels[1:]:
        tree = tree.unionByName(x)
    return tree


def changed_leaves(tree: DataFrame, depth: int, ws: Workspace) -> DataFrame:
    """``(_version, node)``: leaves of a version that differ from the version before it.

    The tree is descended level by level: a node is compared only if its parent
    differs. What differs on a level is written before the next one, so the
    plan doesn't grow with the depth. Versions must be consecutive whole
    numbers; a version without a predecessor differs everywhere.
    """
    before = tree.withColumn(VERSION, F.col(VERSION) + 1)
    changed: DataFrame | None = None
    for d in range(depth + 1):
        now, old = (x.where(F.col("level") == d).drop("level") for x in (tree, before))
        if changed is not None:
            parent = changed.withColumnRenamed("node", "_parent")
            now, old = (
                x.withColumn("_parent", F.shiftrightunsigned("node", FANOUT_BITS))
                .join(parent, [VERSION, "_parent"], "left_semi")
                .drop("_parent")
                for x in (now, old)
            )
        pairs = now.alias("now").join(
            old.select(VERSION, "node", F.struct("h1", "h2", "n").alias("was")).alias("old"), [VERSION, "node"], "left"
        )
        # nodes that only the old version has hold removed records, no new or changed ones
        changed = pairs.where(~F.col("was").eqNullSafe(F.struct("h1", "h2", "n"))).select(VERSION, "node")
        changed = ws.cut(changed, f"changed-{d}")
    return changed


def changed_records(
    records: DataFrame, keys: list[str], state: list[str], depth: int, tree: DataFrame, ws: Workspace, carry: tuple = ()
) -> DataFrame:
    """``(_version, keys, state, carry)``: records that are new, or have another state, against the version before.

    ``records``: unique per ``_version`` and ``keys``, with ``_leaf``. States are
    compared exactly and null-safely. An empty table gives an empty result.
    """
    leaves = changed_leaves(tree, depth, ws).withColumnRenamed("node", "_leaf")
    now = records.join(leaves, [VERSION, "_leaf"], "left_semi")
    old = records.withColumn(VERSION, F.col(VERSION) + 1).join(leaves, [VERSION, "_leaf"], "left_semi")
    old = old.select(VERSION, *keys, F.struct(*state).alias("_was"))
    both = now.join(old, [VERSION, *keys], "left")
    return both.where(~F.col("_was").eqNullSafe(F.struct(*state))).select(VERSION, *keys, *state, *carry)


class SnapshotStore:
    """Last published snapshot of a table in a folder of its own.

    ``process`` hands the records that are new or changed since the last
    published version to ``work`` and publishes the output, the tree, its depth
    and the records together (see ``plans.versions``). A run that fails anywhere
    before that leaves the last version current, so the next run sees the same
    changes again, and none twice after success. If two runs race, the second
    to publish gets ``AlreadyPublished`` and its output is dropped.

    The depth of the tree is the last version's as long as its leaves stay
    small, unless ``depth`` is given. If it changes, the old tree is built again
    at the new depth from the old records, so the same records come out.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], state: list[str], depth: int | None = None):
        self.spark, self.path, self.keys, self.state, self.depth = spark, path.rstrip("/"), keys, state, depth
        self._versions = Versions(spark, self.path)

    def versions(self) -> list[int]:
        return self._versions.numbers()

    def read(self, what: str, version: int | None = None) -> DataFrame | None:
        """``what``: output, tree, settings or records of a version, the last by default; None before the first."""
        version = self._versions.current() if version is None else version
        return self.spark.read.parquet(f"{self._versions.folder(version)}/{what}") if version else None

    def process(self, current: DataFrame, work=None) -> DataFrame:
        """Publishes the next version and returns its output.

        ``current``: the whole table now; rows with a null key are ignored; of
        several rows with one key the greatest state counts. ``work`` maps the
        changed records (keys and state columns) to the output, which by default
        is those records.
        """
        best = current.where(F.expr(" and ".join(f"`{k}` is not null" for k in self.keys)))
        best = best.groupBy(*self.keys).agg(F.max(F.struct(*self.state)).alias("_s")).select(*self.keys, "_s.*")
        last = self._versions.current()
        stage = self._versions.stage()
        ws = Workspace(self.spark, "descent")
        try:
            best.write.parquet(f"{stage}/records")
            records = self.spark.read.parquet(f"{stage}/records")
            n, was = records.count(), self.read("settings", last).first()[0] if last else 0
            depth = self.depth or max(was, depth_for(n))
            marked = lambda df, v: df.withColumn("_leaf", leaf_of(self.keys, depth)).withColumn(VERSION, F.lit(v))
            records = marked(records, 1)
            build_tree(records, self.keys, self.state, depth).write.parquet(f"{stage}/tree")
            tree = self.spark.read.parquet(f"{stage}/tree")
            self.spark.createDataFrame([(depth,)], "depth int").coalesce(1).write.parquet(f"{stage}/settings")
            if last:
                before = marked(self.read("records", last), 0)
                records = records.unionByName(before)
                old = self.read("tree", last).withColumn(VERSION, F.lit(0)) if was == depth else build_tree(before, self.keys, self.state, depth)
                tree = tree.unionByName(old)
            found = changed_records(records, self.keys, self.state, depth, tree, ws)
            found = found.where(F.col(VERSION) == 1).drop(VERSION)
            (work(found) if work else found).write.parquet(f"{stage}/output")
            self._versions.publish(stage, last)
        except BaseException:
            delete_path(self.spark, stage)
            raise
        finally:
            ws.close()
        return self.read("output", last + 1)


def file_states(scans: DataFrame, runs: DataFrame) -> DataFrame:
    """``(run_id, _version, file_path, mtime, size)``: the files present in each succeeded run.

    Runs count from 1 in order of ``started_at`` (nulls first, then ``run_id``);
    duplicate rows of a run count once. A file's state is its latest look by
    ``seen_at`` with ``mtime`` and ``size`` not null; looks at the same moment
    go by ``loaded_at``, then ``scan_id``. Null paths are no files.
    """
    ok = runs.where(F.col("status") == "succeeded").groupBy("run_id").agg(F.min("started_at").alias("started_at"))
    ok = ok.where(F.col("run_id").isNotNull())
    order = Window.orderBy(F.col("started_at").asc_nulls_first(), "run_id")  # the run list, not the scans
    ok = ok.select("run_id", F.row_number().over(order).alias(VERSION))
    looks = scans.where(
        F.col("mtime").isNotNull() & F.col("size").isNotNull() & F.col("file_path").isNotNull()
    ).select("run_id", "file_path", "mtime", "size", "seen_at", "loaded_at", "scan_id")
    last = F.max(F.struct("seen_at", "loaded_at", "scan_id", "mtime", "size")).alias("s")
    return looks.join(ok, "run_id").groupBy("run_id", VERSION, "file_path").agg(last).select(
        "run_id", VERSION, "file_path", "s.mtime", "s.size"
    )


def changed_files(scans: DataFrame, runs: DataFrame, ws: Workspace) -> DataFrame:
    """``(run_id, file_path)``: for each succeeded run, files new or changed against the last that succeeded.

    All runs are compared in one pass: their trees are built side by side. For
    one run after the other, each published before the next, see ``SnapshotStore``.
    """
    states = ws.cut(file_states(scans, runs), "states")
    per_version = states.groupBy(VERSION).count().agg(F.max("count")).first()[0] or 0
    depth = depth_for(per_version)
    records = states.withColumn("_leaf", leaf_of(["file_path"], depth))
    state = ["mtime", "size"]
    tree = ws.cut(build_tree(records, ["file_path"], state, depth), "tree")
    found = changed_records(records, ["file_path"], state, depth, tree, ws, carry=("run_id",))
    return ws.cut(found.select("run_id", "file_path"), "output")


def processed_files(scans: DataFrame, runs: DataFrame, ws: Workspace) -> DataFrame:
    """``(file_path, mtime, size)`` that a store hands out after the last succeeded run, having published the one before it.

    A first attempt at the last run fails in the middle of its work; the store must then give out the same changes again.
    """
    states = ws.cut(file_states(scans, runs), "states")
    last = states.agg(F.max(VERSION)).first()[0] or 0
    store = SnapshotStore(scans.sparkSession, ws.at("store"), ["file_path"], ["mtime", "size"])
    own = lambda v: states.where(F.col(VERSION) == v).select("file_path", "mtime", "size")
    if last > 1:
        store.process(own(last - 1))

    def fails(changed: DataFrame) -> DataFrame:
        changed.count()
        raise ConnectionError

    try:
        store.process(own(last), fails)
    except ConnectionError:
        pass
    return store.process(own(last))
