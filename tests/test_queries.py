import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textquarry import queries
from textquarry.functions.tokens import tokenize
from textquarry.operators import chunking, incremental

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_document_frequencies_of_all_kinds(spark):
    """Against chunks cut one by one, over markdown and Python files, changed and unchanged ones."""
    old, new = queries._snapshots(spark, SF)
    diff = incremental.diff_manifests(old, new).where("status <> 'removed'")
    docs = queries.table(spark, SF, "documents").join(diff, "file_path").select("file_path", "kind", "text", "status").collect()
    assert {(d.kind, d.status) for d in docs} == {(k, s) for k in ("markdown", "python") for s in ("changed", "unchanged")}
    cut = {"markdown": chunking.cut_markdown, "python": chunking.cut_python}
    chunks = [(d.kind, d.file_path, d.text[s:e]) for d in docs for s, e in cut[d.kind](d.text)]
    made = spark.createDataFrame(chunks, "kind string, file_path string, text string")
    terms = made.select("kind", F.array_distinct(F.concat(tokenize(F.col("text")), tokenize(F.col("file_path")))).alias("t")).collect()
    want = Counter(t for r in terms for t in r.t)
    markdown = Counter(t for r in terms if r.kind == "markdown" for t in r.t)
    assert len(want) > len(markdown)
    for name, df in (("incremental_df_all", want), ("full_df_all", want), ("incremental_df", markdown), ("full_df", markdown)):
        rows = queries.QUERIES[name](spark, SF).collect()
        assert len(rows) == len(df) and {r.term: r.df for r in rows} == df, name


def _overlap(g, h):
    begin, end = h.first_character_index + 300, h.last_character_index + 500
    both = min(g.last_character_index, end) - max(g.first_character_index, begin)
    return max(0, both) / (max(g.last_character_index, end) - min(g.first_character_index, begin)) if g.file_path == h.file_path else 0.0


def test_every_true_source_counts(spark):
    """Overlaps and recall against all pairs of sources, of questions with up to ten of them."""
    asked = [(r.question_id, r.retrieved_sources or [], r.answer) for r in queries.asked(spark, SF).collect()]
    found = {i: [(n, k, _overlap(g, h)) for n, g in enumerate(l) for k, h in enumerate(reversed(l), 1)] for i, l, _ in asked}
    pairs = {(i, n, k, round(o, 6)) for i, rows in found.items() for n, k, o in rows if round(o, 6) > 0}
    assert max(n for _, n, _, _ in pairs) == 9
    assert {tuple(r) for r in queries.iou_pairs(spark, SF).collect()} == pairs
    recall = {}
    for i, l, answer in asked:
        for k in (1, 3, 5, 10) if l and answer is not None else ():
            recall[i, k] = round(len({n for n, rank, o in found[i] if rank <= k and o >= 0.05}) / len(l), 6)
    got = {(r.question_id, r.k): r.recall for r in queries.recall_at_k(spark, SF).where("recall is not null").collect()}
    assert got == recall
    for r in queries.mean_recall(spark, SF).collect():
        own = [v for (_, k), v in recall.items() if k == r.k]
        assert abs(r.recall - sum(own) / len(own)) < 1e-6


def test_counts_of_chunks_shuffle_texts_once(spark):
    plan = queries.bm25_tf(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
