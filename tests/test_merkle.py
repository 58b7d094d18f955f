import random

import pytest

from textquarry.operators import merkle

KIND = "path string, mtime double, size long"


def _df(spark, state):
    return spark.createDataFrame([(k, *v) for k, v in state.items()] or [("x", 0.0, 0)], KIND).where("true" if state else "false")


def test_store_gives_each_change_once_and_survives_failures(spark, tmp_path):
    r = random.Random(1)
    store = merkle.SnapshotStore(spark, "file://" + str(tmp_path / "s"), ["path"], ["mtime", "size"], depth=2)
    state, published = {}, {}
    for run in range(4):
        for _ in range(30):
            k = f"p{r.randrange(60)}"
            if r.random() < 0.2:
                state.pop(k, None)
            else:
                state[k] = (r.choice([1.5, None, float("nan")]), r.randrange(3))
        if run in (1, 2):  # dies while it works: nothing is published
            with pytest.raises(RuntimeError):
                store.process(_df(spark, state), lambda df: (_ for _ in ()).throw(RuntimeError("lost")))
            assert len(store.versions()) == (1 if run == 1 else 2)
        got = {tuple(map(str, x)) for x in store.process(_df(spark, state)).collect()}
        want = {(k, str(m), str(s)) for k, (m, s) in state.items() if str(published.get(k)) != str((m, s))}
        assert got == want
        published = dict(state)
    assert store.process(_df(spark, state)).count() == 0
    assert store.process(_df(spark, {})).count() == 0
    assert store.process(_df(spark, {"a": (1.0, 1)})).count() == 1


def test_the_depth_is_kept_or_the_old_tree_built_anew(spark, tmp_path):
    path = "file://" + str(tmp_path / "s")
    open_at = lambda depth: merkle.SnapshotStore(spark, path, ["path"], ["mtime", "size"], depth)
    state = {f"p{i}": (1.0, i) for i in range(200)}
    assert open_at(4).process(_df(spark, state)).count() == 200
    state["p7"] = (2.0, 7)
    assert [r.path for r in open_at(5).process(_df(spark, state)).collect()] == ["p7"] and open_at(5).read("settings").first()[0] == 5
    state["p8"] = (2.0, 8)
    assert [r.path for r in open_at(None).process(_df(spark, state)).collect()] == ["p8"] and open_at(None).read("settings").first()[0] == 5


def test_a_lost_race_is_not_published(spark, tmp_path):
    path = "file://" + str(tmp_path / "s")
    store = merkle.SnapshotStore(spark, path, ["path"], ["mtime", "size"])

    def other(df):
        merkle.SnapshotStore(spark, path, ["path"], ["mtime", "size"]).process(_df(spark, {"a": (2.0, 2)}))
        return df

    with pytest.raises(RuntimeError):
        store.process(_df(spark, {"a": (1.0, 1)}), other)
    assert store.versions() == [1] and store.read("output").first().size == 2


def test_only_differing_leaves_are_found(spark, ws):
    rows = [(v, f"p{i}", 1.0, 1 if (v, i) != (2, 7) else 2) for v in (1, 2) for i in range(500)]
    df = spark.createDataFrame(rows, f"{merkle.VERSION} int, {KIND}").withColumn("_leaf", merkle.leaf_of(["path"], 3))
    tree = merkle.build_tree(df, ["path"], ["mtime", "size"], 3)
    leaves = merkle.changed_leaves(tree, 3, ws).where(f"{merkle.VERSION} = 2").collect()
    assert len(leaves) == 1
    found = merkle.changed_records(df, ["path"], ["mtime", "size"], 3, tree, ws).where(f"{merkle.VERSION} = 2").collect()
    assert [(r.path, r.size) for r in found] == [("p7", 2)]


def test_changed_files(spark, ws):
    ts = "2026-01-0{} 00:00:00"
    runs = [(9, ts.format(1), "succeeded"), (9, ts.format(1), "succeeded"), (2, ts.format(2), "failed"), (5, ts.format(3), "succeeded"), (7, ts.format(4), None), (None, ts.format(5), "succeeded")]
    scans = [
        (1, 9, "a", 1.0, 1, 1, 1), (1, 9, "a", 1.0, 1, 1, 1), (2, 9, "b", 1.0, 1, 1, 1), (3, 9, "b", None, 7, 2, 1), (4, 2, "a", 5.0, 5, 1, 1),
        (5, 5, "a", 1.0, 1, 1, 1), (6, 5, "b", 1.0, 1, 1, 1), (7, 5, "b", 1.0, 2, 2, 9), (8, 5, "c", 1.0, 1, 1, 1), (9, 5, None, 1.0, 1, 1, 1), (10, 7, "a", 8.0, 8, 1, 1),
    ]
    s = spark.createDataFrame(scans, "scan_id long, run_id long, file_path string, mtime double, size long, a int, b int").selectExpr(
        "scan_id", "run_id", "file_path", "mtime", "size", "timestamp_seconds(a) as seen_at", "timestamp_seconds(b) as loaded_at", "1 as _version"
    )
    r = spark.createDataFrame(runs, "run_id long, t string, status string").selectExpr("run_id", "cast(t as timestamp) as started_at", "status", "1 as node")
    got = {tuple(x) for x in merkle.changed_files(s, r, ws).collect()}
    assert got == {(9, "a"), (9, "b"), (5, "b"), (5, "c")}
    from textquarry.plans.workspace import Workspace

    assert merkle.changed_files(s.limit(0), r, Workspace(spark, "empty")).count() == 0
