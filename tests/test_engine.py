import io
import json
import os
import threading
import urllib.request
from pathlib import Path

import pytest

from textquarry.cli import main
from textquarry.plans.engine import Engine, QueryCache, Source
from textquarry.plans.versions import AlreadyPublished, Versions
from textquarry.plans.workspace import Workspace, list_names, path_exists, scoped, shared_root
from textquarry.server import make_server, respond
from textquarry.sources import corpus, jsonio
from textquarry.sources.corpus import list_corpus, read_corpus, suffix_of

FILES = {
    "pkg/__init__.py": "",
    "pkg/cache.py": '"""Cache."""\n\n\ndef block_cache(size):\n    return size\n',
    "pkg/_hidden.md": "hidden words\n",
    ".dot/x.txt": "dotted words\n",
    "docs/guide.md": "# Guide\r\n\r\nThe block cache keeps blocks.\r\n",
    "docs/bad.md": b"ok \xff\xfe bytes",
    "tests/skip.md": "never indexed",
    "csrc/skip.py": "x = 1",
    "a.PY": "x = 1",
    ".py": "x = 1",
    "b.rst": "no",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (r / name).parent.mkdir(parents=True, exist_ok=True)
        (r / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    return r


@pytest.fixture(scope="module")
def engine(spark, root, tmp_path_factory):
    e = Engine(spark, "file://" + str(tmp_path_factory.mktemp("index")))
    made = e.index(str(root), build_embeddings=True)
    assert made["reprocessed"] == 6 and made["version"] == 1
    return e


@pytest.mark.parametrize("spelled,subtrees", [("{}", 16), ("file://{}", 1), ("file:{}/", 3)])
def test_corpus(spark, root, monkeypatch, spelled, subtrees):
    monkeypatch.setattr(corpus, "SUBTREES", subtrees)
    at = spelled.format(root)
    rows = read_corpus(spark, at).orderBy("file_path").collect()
    assert all(r.file_path.startswith(at.rstrip("/") + "/") for r in rows)
    by = {r.file_path[len(at.rstrip("/")) + 1 :]: r for r in rows}
    assert sorted(by) == [".dot/x.txt", "docs/bad.md", "docs/guide.md", "pkg/__init__.py", "pkg/_hidden.md", "pkg/cache.py"]
    assert by["docs/guide.md"].text == "# Guide\n\nThe block cache keeps blocks.\n" and by["docs/guide.md"].size == 42
    assert by["docs/bad.md"].text == "ok  bytes" and by["pkg/cache.py"].kind == "python"
    assert abs(by["docs/bad.md"].mtime - os.stat(root / "docs/bad.md").st_mtime) < 1e-5
    listing = list_corpus(spark, at)
    assert "text" not in listing.columns and listing.count() == 6
    assert suffix_of(".py") == "" and suffix_of("a.b.md") == ".md" and suffix_of("a.") == "" and list_corpus(spark, f"{at}/none").count() == 0


def test_search_and_caches(engine):
    found = engine.search("block cache")
    assert {Path(s.file_path).name for s in found} == {"cache.py", "guide.md"}
    hits = engine.cache.hits
    assert engine.search("block cache") == found and engine.cache.hits == hits + 1
    assert engine.search("  ") == engine.search("x", 0) == [] and engine.search("zzzz") == []
    assert {Path(s.file_path).name for s in engine.search("block cache", 5, use_semantic=True)} >= {"cache.py", "guide.md"}
    text, sources = engine.answer("block cache", 1)
    assert text and len(sources) == 1
    assert engine.answer("zzzz") == ("No relevant sources found -- cannot answer.", [])
    assert engine.prompt("block cache", found).count("[Source: ") == 2


def test_lru():
    c = QueryCache(2)
    c.put([], "a")
    c.put([Source("f", 0, 1)], "b")
    assert c.get("a") == [] and c.get("z") is None
    c.put([], "c")
    assert c.get("b") is None and (c.hits, c.misses) == (1, 2)


def _tables(e):
    """What an index holds, by file and place in the file instead of chunk numbers."""
    chunks = {r.chunk_ord: (r.file_path, r.chunk_in_file, r.first_character_index, r.last_character_index) for r in e.chunks().collect()}
    index = e.lexical_index()
    postings = {(r.term, chunks[r.chunk_ord], r.tf, r.dl) for r in index.postings.collect()}
    texts = {(r.file_path, r.text) for r in e.files().collect()}
    vectors = {(chunks[r.chunk_ord], tuple(r.embedding)) for r in e.vectors().collect()} if e.settings()["semantic"] else None
    manifest = {(r.file_path, r.mtime, r["size"]) for r in e.load_manifest().collect()}
    return set(chunks.values()), postings, {tuple(r) for r in index.df.select("term", "df").collect()}, index.n_chunks, index.avg_chunk_length, texts, vectors, manifest


def _write(tree, n):
    tree.mkdir()
    for i in range(n):
        (tree / f"f{i}.md").write_text(f"word{i} shared\n\nsecond part {i}")
    (tree / "p.py").write_text("def shared():\n    return 1\n")


def test_incremental_equals_full(spark, tmp_path):
    tree = tmp_path / "t"
    _write(tree, 11)
    a, b = (Engine(spark, f"file://{tmp_path}/{x}") for x in "ab")
    a.index(str(tree), build_embeddings=True)
    numbers = {r.file_path: r.file_no for r in a.load_manifest().collect()}
    assert a.index(str(tree), incremental_run=True)["reprocessed"] == 0
    (tree / "f3.md").write_text("entirely new words")
    (tree / "f5.md").unlink()
    (tree / "a0.md").write_text("added in front")
    assert a.index(str(tree), incremental_run=True)["reprocessed"] == 2
    b.index(str(tree), build_embeddings=True)
    assert _tables(a) == _tables(b) and len(a.settings()["segments"]) == 3
    assert {r.file_path for r in a.load_manifest().collect() if numbers.get(r.file_path, r.file_no) != r.file_no} == set()
    for query in ("shared", "entirely", "word5", "word6 second"):
        assert a.search(query, 20) and a.search(query, 20) == b.search(query, 20) or query == "word5" and a.search(query) == b.search(query) == []
    asked = spark.createDataFrame([("1", "shared part"), ("2", "entirely new")], "question_id string, question string")
    assert a.rank(asked, 20).count() == b.rank(asked, 20).count() > 0
    (tree / "p.py").write_text("def other():\n    return 2\n")
    (tree / "f1.md").write_text("one more")
    (tree / "f2.md").unlink()
    assert a.index(str(tree), incremental_run=True)["reprocessed"] == 2  # too much is dead now: one segment again
    b.index(str(tree), build_embeddings=True)
    assert _tables(a) == _tables(b) and len(a.settings()["segments"]) == 1 and a.dead().count() == 0
    assert a.vacuum() and _tables(a) == _tables(b) and a.version() == 4
    assert a.index(str(tree), 5, incremental_run=True)["reprocessed"] == 11  # another size: a full run
    with pytest.raises(ValueError):
        a.index(str(tree), 0)
    with pytest.raises(FileNotFoundError):
        a.vectors()


def test_one_changed_file_reads_one_body(spark, tmp_path, monkeypatch):
    tree = tmp_path / "t"
    _write(tree, 40)
    e = Engine(spark, f"file://{tmp_path}/i")
    assert e.index(str(tree))["reprocessed"] == 41
    (tree / "f7.md").write_text("zebra words")
    for p in tree.iterdir():  # no other body can be read any more
        if p.name != "f7.md":
            at = p.stat()
            p.chmod(0)
            os.utime(p, ns=(at.st_atime_ns, at.st_mtime_ns))
    read = []
    real = corpus.with_texts
    monkeypatch.setattr("textquarry.plans.engine.with_texts", lambda df, *a: read.append(df.count()) or real(df, *a))
    assert e.index(str(tree), incremental_run=True)["reprocessed"] == 1 and read == [1]
    assert [Path(s.file_path).name for s in e.search("zebra")] == ["f7.md"] and not e.search("word7") and len(e.search("shared", 99)) == 40


def test_a_search_reads_only_the_parts_of_its_terms(spark, tmp_path, monkeypatch):
    from textquarry.operators import lexical

    monkeypatch.setattr(lexical, "PART_ROWS", 10)
    tree = tmp_path / "t"
    _write(tree, 12)
    e = Engine(spark, f"file://{tmp_path}/i")
    e.index(str(tree))
    plan = lexical.top_of(["word3"], e.lexical_index(), 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan.replace("isnotnull(part#", "part#").replace("[(part", "[part") and "PartitionFilters: []" not in plan
    asked = spark.createDataFrame([("1", "word3 shared")], "question_id string, question string")
    assert e.settings()["segments"][0]["parts"] > 3
    ranked = e.rank(asked, 5)
    assert "PartitionFilters: []" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert [r.chunk_ord for r in ranked.orderBy("rank").collect()] == [r.chunk_ord for r in lexical.top_of(["word3", "shared"], e.lexical_index(), 5).collect()]


def test_failed_run_changes_nothing(spark, tmp_path, monkeypatch):
    tree = tmp_path / "t"
    tree.mkdir()
    (tree / "a.md").write_text("one two")
    e = Engine(spark, f"file://{tmp_path}/i")
    e.index(str(tree))
    before = sorted(os.listdir(tmp_path / "i"))
    (tree / "a.md").write_text("three")
    monkeypatch.setattr("textquarry.operators.lexical.save_parts", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        e.index(str(tree), incremental_run=True)
    monkeypatch.undo()
    assert e.version() == 1 and e.search("two") and sorted(os.listdir(tmp_path / "i")) == before
    assert e.index(str(tree), incremental_run=True)["reprocessed"] == 1 and e.search("three") and not e.search("two")


def test_of_two_runs_one_publishes(spark, tmp_path, monkeypatch):
    tree = tmp_path / "t"
    _write(tree, 2)
    e = Engine(spark, f"file://{tmp_path}/i")
    e.index(str(tree))
    real = corpus.with_texts

    def late(df, *a):  # another run starts from the same version and publishes first
        monkeypatch.setattr("textquarry.plans.engine.with_texts", real)
        Engine(spark, e.path).index(str(tree))
        return real(df, *a)

    monkeypatch.setattr("textquarry.plans.engine.with_texts", late)
    with pytest.raises(AlreadyPublished):
        e.index(str(tree))
    assert e.version() == 2 and len([n for n in os.listdir(tmp_path / "i") if n.startswith("data-")]) == 2 and e.search("shared")
    v = Versions(spark, e.path)
    with pytest.raises(AlreadyPublished):
        v.publish(v.stage(), 1)
    assert v.folder(2) != v.folder(1) and v.publish(v.stage(), 2) == 3


QUESTIONS = [{"question_id": "1", "question": "block cache?"}, {"question": "zzzz"}]


def test_documents_and_cli(spark, engine, root, tmp_path):
    path, out = tmp_path / "q.json", str(tmp_path / "out")
    path.write_text(json.dumps({"rag_questions": QUESTIONS, "extra": 1}))

    def run(*argv):
        text = io.StringIO()
        return main(["--index_dir", engine.path, *map(str, argv)], spark, text), text.getvalue()

    assert run("search_dataset", "--dataset_path", path, "-k", 3, "--save_directory", out)[0] == 0
    found = json.loads((tmp_path / "out/q.json").read_text())
    assert found["k"] == 3 and [len(r["retrieved_sources"]) for r in found["search_results"]] == [2, 0]
    ids = [r["question_id"] for r in found["search_results"]]
    assert run("answer_dataset", "--student_search_results_path", tmp_path / "out/q.json", "--save_directory", tmp_path / "ans")[0] == 0
    answers = json.loads((tmp_path / "ans/q.json").read_text())
    assert answers["k"] == 3 and answers["search_results"][1]["answer"].startswith("No relevant sources")
    assert jsonio.read_answers(spark, str(tmp_path / "ans/q.json"))[0].count() == 2
    truth = [{"question_id": ids[0], "question": "q", "answer": "a", "sources": found["search_results"][0]["retrieved_sources"][:1]}]
    (tmp_path / "t.json").write_text(json.dumps({"rag_questions": truth}))
    code, text = run("evaluate", "--student_search_results_path", tmp_path / "out/q.json", "--dataset_path", tmp_path / "t.json")
    assert text == "Recall@1: 1.000  Recall@3: 1.000  Recall@5: 1.000  Recall@10: 1.000\n"
    code, text = run("evaluate", "--student_search_results_path", tmp_path / "out/q.json", "--dataset_path", path)
    assert "Recall@1: 0.000" in text and "every recall is 0" in text
    assert "[" in run("search", "block cache")[1] and run("search", "zzzz")[1] == "No results.\n"
    assert run("answer", "block cache", "-k", 1)[0] == 0
    assert run("search_dataset", "--dataset_path", tmp_path / "none.json", "--save_directory", out)[0] == 1
    for bad in ("{", '{"rag_questions": [{"question_id": "1"}]}', '{"x": 1}', '{"rag_questions": [{"question": 1, "sources": 3}]}'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            jsonio.read_questions(spark, str(tmp_path / "bad.json"))
    with pytest.raises(ValueError):
        jsonio.read_results(spark, str(path))
    text = io.StringIO()
    fresh = ["--index_dir", f"file://{tmp_path}/new"]
    assert main([*fresh, "search", "x"], spark, text) == 1 and "Run the index command" in text.getvalue()
    assert main([*fresh, "index", "--root", str(root), "--max_chunk_size", "0"], spark, io.StringIO()) == 1
    text = io.StringIO()
    assert main([*fresh, "index", "--root", str(root), "--incremental"], spark, text) == 0 and "6 files processed" in text.getvalue()


def test_server(spark, engine, tmp_path):
    server = make_server(engine, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    get = lambda p: json.load(urllib.request.urlopen(base + p))
    assert get("/health") == {"status": "ok"}
    first, second = get("/search?query=block%20cache&k=4"), get("/search?query=block%20cache&k=4")
    assert (first["cache_hit"], second["cache_hit"]) == (False, True) and first["results"] == second["results"] and first["k"] == 4
    assert get("/answer?query=block%20cache")["sources"]
    server.shutdown()
    status = lambda t, e=engine: respond(e, t)[0]
    assert status("/search?query=%20") == 400 and status("/search") == 422 and status("/search?query=a&k=x") == 422
    assert status("/search?query=a&use_semantic=maybe") == 422 and status("/nothing") == 404 and status("/answer?query=zzzz") == 404
    assert status("/search?query=a", Engine(spark, f"file://{tmp_path}/none")) == 503
    server.server_close()


def test_stream(spark, tmp_path):
    from textquarry.streaming.appends import stream_postings

    schema = "file_path string, kind string, text string"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, rows in enumerate([[("a.md", "markdown", "x x y")], [("b.py", "python", "z = 1\n")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream_postings(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "cp")).awaitTermination()
        assert len(os.listdir(out)) == n + 1
    got = {(r.file_path, r.term): r.tf for r in spark.read.parquet(out).collect()}
    assert got[("a.md", "x")] == 2 and got[("b.py", "z")] == 1


def test_what_is_derived_from_a_result_outlives_other_queries(spark):
    made = []

    @scoped
    def query(spark, sf, ws):
        made.append(ws)
        ws.cut(spark.range(9), "aside")
        return ws.cut(spark.range(3), "x").join(ws.cut(spark.range(2), "y"), "id")

    derived = query(spark, "").limit(5)
    import gc

    gc.collect()
    query(spark, "").count()
    assert derived.count() == 2 and list_names(spark, made[0].path) == ["x", "y"]
    assert made[0].path.startswith(shared_root(spark))
    made[0].close()
    assert not path_exists(spark, made[0].path)
