import math

import pytest
from pyspark.sql import functions as F

from textquarry.functions.spans import iou
from textquarry.operators import answering, dense, evaluation, fusion, incremental, lexical, prompts
from textquarry.plans.skew import keyed_lookup

SRC = "struct<file_path:string,first_character_index:bigint,last_character_index:bigint>"


def _index(spark, ws, texts, **kw):
    rows = [(i, "", t) for i, t in enumerate(texts)]
    return lexical.fit(spark.createDataFrame(rows, "chunk_ord long, file_path string, text string"), ws, **kw)


def _ask(spark, **q):
    return spark.createDataFrame(list(q.items()), "question_id string, question string")


def test_bm25_golden(spark, ws):
    index = _index(spark, ws, ["a b a", "b c", "c c c d"])
    assert index.avg_chunk_length == 3.0 and index.summary() == (3, 4)
    got = {(r.question_id, r.chunk_ord): r.score for r in lexical.scores(_ask(spark, x="a c", y="b b", z="z", w=" "), index).collect()}
    assert got == {("x", 0): 1.348640, ("x", 1): 0.517004, ("x", 2): 0.705005, ("y", 0): 0.470004, ("y", 1): 0.517004}
    df = spark.createDataFrame([(i,) for i in range(4)], "df int").select(F.round(lexical.idf(3), 6).alias("v"))
    assert [r.v for r in df.collect()] == [2.079442, 0.980829, 0.470004, 0.133531]


def test_bm25_edges(spark, ws, monkeypatch, tmp_path):
    rows = [(0, "a_b.py", "x"), (0, "a_b.py", "x"), (1, "c.py", None), (None, "d.py", "x"), (2, None, "y x"), (3, "e", "")]
    chunks = spark.createDataFrame(rows, "chunk_ord long, file_path string, text string")
    index = lexical.fit(chunks.distinct(), ws)
    assert index.n_chunks == 4  # a null number is no chunk, an unreadable one is
    tf = {(r.chunk_ord, r.term): r.tf for r in index.postings.collect()}
    assert tf == {(0, "x"): 1, (0, "a_b"): 1, (0, "a"): 1, (0, "b"): 1, (0, "py"): 1, (2, "x"): 1, (2, "y"): 1, (3, "e"): 1}
    q = _ask(spark, x="x", n=None, none="zzz")
    want = sorted(map(tuple, lexical.search(q, index, 2).collect()))
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 1)
    assert sorted(map(tuple, lexical.search(q, index, 2).collect())) == want
    assert lexical.search(q, index, 0).count() == 0
    lexical.save(index, str(tmp_path / "i"))
    again = lexical.load(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, lexical.search(q, again, 2).collect())) == want
    places = chunks.withColumns({"first_character_index": F.lit(0), "last_character_index": F.lit(1)})
    got = {r.question_id: len(r.retrieved_sources) for r in lexical.grouped(q, lexical.search(q, index, 9), places).collect()}
    assert got == {"x": 2, "n": 0, "none": 0}
    assert {(r.chunk_ord, r.dl) for r in index.postings.collect()} == {(0, 5), (2, 2), (3, 1)}
    empty = lexical.fit(chunks.limit(0), ws)
    assert empty.avg_chunk_length == 0.0 and lexical.search(q, empty, 5).count() == 0


def test_ties_go_to_the_smaller_chunk(spark, ws):
    index = _index(spark, ws, ["a"] * 5)
    assert [r.chunk_ord for r in lexical.search(_ask(spark, q="a"), index, 3).orderBy("rank").collect()] == [0, 1, 2]


def _ranked(spark, *rows):
    return spark.createDataFrame(rows, "question_id string, chunk_ord string, rank int")


def test_rrf(spark):
    a, b = _ranked(spark, ("q", "A", 1), ("q", "B", 2)), _ranked(spark, ("q", "B", 1), ("q", "C", 2))
    got = [(r.chunk_ord, r.score) for r in fusion.fuse(a, b, weights=[10, 1]).orderBy("rank").collect()]
    assert got == [("B", 0.177684), ("A", 0.163934), ("C", 0.016129)]
    assert [r.chunk_ord for r in fusion.fuse(_ranked(spark, ("q", "Z", 1)), _ranked(spark, ("q", "A", 1))).orderBy("rank").collect()] == ["Z", "A"]
    assert fusion.fuse(a, b, weights=[1]).count() == 2  # lists beyond the weights are left out
    assert fusion.fuse(a, a).orderBy("rank").first().score == round(2 / 61, 6)
    assert fusion.hybrid(a, b, 2).count() == 2 and fusion.pool_size(5) == 30 and fusion.pool_size(50) == 50
    with pytest.raises(ValueError):
        fusion.fuse()


def test_cosine(spark, monkeypatch):
    v = spark.createDataFrame([(i, x) for i, x in enumerate([[1.0, 0.0], [2.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, 0.0], None, [1.0], [float("nan"), 1.0]])], "chunk_ord long, embedding array<float>")
    q = spark.createDataFrame([("a", [1.0, 0.1]), ("b", None), ("c", [0.0, 0.0])], "question_id string, embedding array<float>")
    for block in (4096, 1):
        monkeypatch.setattr(dense, "QUESTION_BLOCK", block)
        got = [(r.question_id, r.chunk_ord, r.score) for r in dense.cosine_top(q, v, 5).orderBy("rank").collect()]
        assert got == [("a", 0, 0.995037), ("a", 1, 0.995037), ("a", 2, 0.099504)]
    assert dense.cosine_top(q, v.limit(0), 5).count() == 0
    assert [r.chunk_ord for r in dense.cosine_top(q, v, 1).collect()] == [0]
    unit = v.where("chunk_ord in (1, 4)").select(dense.l2_normalise(F.col("embedding")).alias("u")).collect()
    assert [list(r.u) for r in unit] == [[1.0, 0.0], [0.0, 0.0]]
    made = dense.embed(spark.createDataFrame([(1, "a b"), (2, None)], "chunk_ord long, text string"), dense.HashEncoder(16), "chunk_ord", "text").collect()
    assert math.isclose(sum(x * x for x in made[0].embedding), 1, rel_tol=1e-5) and not any(made[1].embedding)


def test_iou(spark):
    pairs = [("f", 0, 100, "f", 50, 150), ("f", 0, 100, "f", 0, 5), ("f", 0, 10, "f", 10, 20), ("f", 0, 9, "g", 0, 9), ("f", 5, 5, "f", 0, 9), ("f", 0, None, "f", 0, 9)]
    kind = "f1 string, s1 long, e1 long, f2 string, s2 long, e2 long"
    cols = ("file_path", "first_character_index", "last_character_index")
    a, b = (F.struct(*(F.col(f"{x}{n}").alias(c) for x, c in zip("fse", cols))) for n in (1, 2))
    got = [r.v for r in spark.createDataFrame([(*p,) for p in pairs], kind).select(iou(a, b).alias("v")).collect()]
    assert got == [1 / 3, 0.05, 0.0, 0.0, 0.0, 0.0]


def test_recall(spark):
    truth = [("q", [("f", 0, 100), ("g", 0, 10)], "x", 0), ("e", [], "x", 1), ("u", None, "x", 2), ("d", [("f", 0, 9)], "x", 3), ("d", [("h", 0, 9)], "x", 4)]
    t = spark.createDataFrame(truth, f"question_id string, sources array<{SRC}>, answer string, q_ord int")
    res = [("q", [("z", 0, 1), ("f", 0, 5)]), ("e", [("f", 0, 5)]), ("u", []), ("no", []), ("d", [("h", 0, 9)]), ("d", [("f", 0, 9)])]
    r = spark.createDataFrame(res, f"question_id string, retrieved_sources array<{SRC}>")
    got = sorted((x.question_id, x.k, x.recall) for x in evaluation.recall(t, r, (1, 3)).where("recall is not null").collect())
    assert got == [("d", 1, 0.0), ("d", 1, 1.0), ("d", 3, 0.0), ("d", 3, 1.0), ("q", 1, 0.0), ("q", 3, 0.5)]
    assert [(x.k, x.recall) for x in evaluation.mean_recall(t, r, (3, 1)).collect()] == [(1, 0.333333), (3, 0.5)]
    assert [x.recall for x in evaluation.mean_recall(t, r.limit(0)).collect()] == [0.0] * 4


@pytest.mark.parametrize("lengths,kept", [([3500, 10], [3500]), ([2000, 1500, 100], [2000]), ([1000, 2000, 1], [1000, 2000]), ([], [])])
def test_prompt_budget(spark, lengths, kept):
    files, sources = [], []
    for i, n in enumerate(lengths):
        path = f"f{i}"
        files.append((path, "x" * (n - len(f"[Source: {path}]\n"))))
        sources += [(path, 0, 10**6), ("gone", 0, 5)]
    f = spark.createDataFrame(files, "file_path string, text string")
    r = spark.createDataFrame([("q", "Why?", sources)], f"question_id string, question string, retrieved_sources array<{SRC}>")
    assert [len(x.block) for x in prompts.prompt_blocks(r, f).orderBy("block_no").collect()] == kept
    text = prompts.prompts(r, f).first().prompt
    assert text.startswith(prompts.INSTRUCTION + "\n\nContext:\n") and text.endswith("\n\nQuestion: Why?\nAnswer:")


class Broken:
    def generate(self, prompt):
        if "bad" in prompt:
            raise RuntimeError("no")
        return " ok "


def test_answers(spark):
    f = spark.createDataFrame([("f", "hello  world")], "file_path string, text string")
    rows = [("1", "q", [("f", 0, 5)], "old"), ("2", "q", [], "old"), ("3", "bad", [("f", 0, 5)], "old"), ("4", "q", None, "old")]
    r = spark.createDataFrame(rows, f"question_id string, question string, retrieved_sources array<{SRC}>, answer string")
    got = {x.question_id: x.answer for x in answering.answer_results(r, f, Broken()).collect()}
    assert got == {"1": "ok", "2": answering.NO_SOURCES, "3": "Generation failed: no", "4": answering.NO_SOURCES}
    assert answering.answer_results(r.where("question_id = '1'"), f).first().answer == "hello"


def test_manifest_diff(spark):
    kind = "file_path string, mtime double, size long"
    old = spark.createDataFrame([("a", 1.0, 5), ("b", 2.0, 6), ("c", 3.0, 7), ("n", None, 1)], kind)
    new = spark.createDataFrame([("a", 1.0, 5), ("b", 9.0, 6), ("d", 4.0, 8), ("n", None, 1)], kind)
    got = dict(map(tuple, incremental.diff_manifests(old, new).collect()))
    assert got == {"a": "unchanged", "b": "changed", "c": "removed", "d": "changed", "n": "unchanged"}
    assert {r.status for r in incremental.diff_manifests(None, new).collect()} == {"changed"}


def test_keyed_lookup_splits_hot_keys(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(100)] + [(None, 1)], "k string, v int")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("w"), F.max("v").alias("m"))
    got = keyed_lookup(rows, table, ["k"], "w", 1001, hot_keys=8)
    assert sorted((r.k, r.v, r.w, r.m) for r in got.collect()) == sorted([("hot", i, 900, 899) for i in range(900)] + [(f"k{i}", i, 1, i) for i in range(100)])


def _cited(spark):
    files = spark.createDataFrame([("f", "hello world"), ("g", "other"), ("unread", None), ("uncited", "x")], "file_path string, text string")
    rows = [("1", "q", [("f", 0, 5), ("gone", 0, 5), ("g", 1, 9)]), ("2", "q", [("f", 0, 5), ("unread", 0, 5), (None, 0, 5), ("f", 6, None)]), ("3", "q", [])]
    return spark.createDataFrame(rows, f"question_id string, question string, retrieved_sources array<{SRC}>"), files


@pytest.mark.parametrize("few", [200_000, 1])
def test_source_texts_of_few_and_of_many_sources(spark, monkeypatch, few):
    monkeypatch.setattr(prompts, "BROADCAST_SOURCES", few)
    got = sorted((r.question_id, r["rank"], r.file_path, r.slice) for r in prompts.source_texts(*_cited(spark)).collect())
    assert got == [("1", 1, "f", "hello"), ("1", 2, "gone", ""), ("1", 3, "g", "ther"), ("2", 1, "f", "hello"), ("2", 2, "unread", ""), ("2", 3, None, ""), ("2", 4, "f", "")]


def test_prompt_blocks_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(prompts, "BROADCAST_SOURCES", 1)
    got = sorted(map(tuple, prompts.prompt_blocks(*_cited(spark)).collect()))
    assert got == [("1", 1, "[Source: f]\nhello"), ("1", 2, "[Source: g]\nther"), ("2", 1, "[Source: f]\nhello")]


def test_prompts_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(prompts, "BROADCAST_SOURCES", 1)
    got = {r.question_id: r.prompt for r in prompts.prompts(*_cited(spark)).collect()}
    contexts = {"1": "[Source: f]\nhello\n\n[Source: g]\nther", "2": "[Source: f]\nhello", "3": ""}
    assert got == {i: f"{prompts.INSTRUCTION}\n\nContext:\n{c}\n\nQuestion: q\nAnswer:" for i, c in contexts.items()}


def test_answers_of_many_sources_keep_wide_spaces(spark, monkeypatch):
    monkeypatch.setattr(prompts, "BROADCAST_SOURCES", 1)
    rows, files = _cited(spark)
    files = files.withColumn("text", F.when(F.col("file_path") == "f", " 16\xa0\n s\xa0").otherwise(F.col("text")))
    got = {r.question_id: r.answer for r in answering.answer_results(rows, files).collect()}
    assert got == {"1": "16\xa0 [Source: g] ther", "2": "16", "3": answering.NO_SOURCES}


def _many_questions(spark, ws):
    """Chunks whose words are common, rare and in between, with ties, and questions of them."""
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[i % m] for m in (1, 2, 3, 7, 40)) for i in range(300)]
    asked = [(i, " ".join(words[(i * s) % 40] for s in range(1 + i % 6))) for i in range(60)] + [(60, None), (61, "unknown")]
    return spark.createDataFrame(asked, "question_id long, question string"), _index(spark, ws, texts)


@pytest.mark.parametrize("terms,chunks", [(500_000, 20_000), (40, 70)])
def test_search_gives_the_best_of_all_scores(spark, ws, monkeypatch, terms, chunks):
    questions, index = _many_questions(spark, ws)
    want = sorted(map(tuple, lexical.top(lexical.scores(questions, index), 10).collect()))
    monkeypatch.setattr(lexical, "SEARCH_TERMS", terms)
    monkeypatch.setattr(lexical, "SEARCH_CHUNKS", chunks)
    found = lexical.search(questions, index, 10)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 500
    # no row for every question and chunk that meet
    assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_cosine_in_tiles_shuffles_once(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)]
    v = spark.createDataFrame(rows, "chunk_ord long, embedding array<float>")
    q = v.where("chunk_ord < 9").withColumnRenamed("chunk_ord", "question_id")
    want = sorted(map(tuple, dense.cosine_top(q, v, 5).collect()))
    monkeypatch.setattr(dense, "QUESTION_TILE", 2)
    found = dense.cosine_top(q, v, 5)
    assert sorted(map(tuple, found.collect())) == want and len(want) == 45
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_best_chunks_leave_out_what_common_terms_cannot_lift():
    import types

    import pyarrow as pa

    # term 0 is in all 40 chunks, term 1 in two, term 2 in none
    no, chunk, part = [0] * 40 + [1, 1], [*range(40), 7, 5], [0.1] * 40 + [2.0, 2.0]
    batch = pa.RecordBatch.from_arrays([pa.array(no, pa.int32()), pa.array(chunk, pa.int64()), pa.array(part)], names=["no", "chunk_ord", "part"])
    held = types.SimpleNamespace(value=(pa.array(["a", "b", "c"]), [0, 2, 3, 4], pa.array([0, 1, 0, 2], pa.int32()).to_numpy(), 3))
    for k, want in ((2, [("a", 5, 2.1), ("a", 7, 2.1), ("b", 0, 0.1), ("b", 1, 0.1)]), (3, [("a", 5, 2.1), ("a", 7, 2.1), ("a", 0, 0.1), ("b", 0, 0.1), ("b", 1, 0.1), ("b", 2, 0.1)])):
        assert [tuple(r.values()) for b in lexical._best_chunks([batch], held, k) for r in b.to_pylist()] == want
