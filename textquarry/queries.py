"""Queries of the core operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import spans
from .functions.tokens import has_text, tokenize
from .operators import answering, chunking, dense, evaluation, fusion, incremental, lexical, merkle, prompts
from .oracles import SQL  # noqa: F401  (part of this module's interface)
from .plans.engine import Engine
from .plans.workspace import scoped
from .sources import jsonio
from .sources.corpus import chunkable, kind_of_path, write_tree

FLAGSHIP = "bm25_search_batch"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks, each once; by number, so that neither this nor counts within a chunk shuffle again."""
    return table(spark, sf, "chunks").repartition("chunk_ord").distinct()


def item_questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_items").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """Answered questions with the sources that were retrieved for them, each once."""
    rows = table(spark, sf, "answers").where(F.col("question_id").isNotNull())
    first = F.min(F.struct(F.coalesce("answered_at", F.to_timestamp(F.lit("1970-01-01"))).alias("t"), "question", "answer", "retrieved_sources")).alias("s")
    return rows.groupBy("question_id").agg(first).select("question_id", "s.question", "s.answer", "s.retrieved_sources")


@scoped
def p3_found(spark: SparkSession, sf: str, ws) -> DataFrame:
    return merkle.changed_files(table(spark, sf, "file_scans"), table(spark, sf, "index_runs"), ws)


@scoped
def p3_store(spark: SparkSession, sf: str, ws) -> DataFrame:
    """What the persistent store hands out for the last succeeded run, after a failed attempt at it."""
    return merkle.processed_files(table(spark, sf, "file_scans"), table(spark, sf, "index_runs"), ws)


# functions


def tokenize_chunks(spark, sf):
    rows = chunk_rows(spark, sf).where(F.col("text").isNotNull())
    return rows.select("chunk_ord", F.posexplode(tokenize(F.col("text"))).alias("pos", "token"))


def _span_rows(rows: DataFrame, column) -> DataFrame:
    flat = rows.select("doc_id", F.posexplode(column).alias("n", "x"))
    return flat.select("doc_id", "n", F.col("x.s").alias("s"), F.col("x.e").alias("e"))


def hard_split_docs(spark, sf):
    return _span_rows(table(spark, sf, "documents"), spans.hard_split(F.col("text"), 2000))


def line_pack_docs(spark, sf):
    return _span_rows(table(spark, sf, "documents"), spans.line_spans(F.col("text"), 2000))


def paragraph_spans(spark, sf):
    return _span_rows(table(spark, sf, "documents"), spans.paragraph_spans(F.col("text")))


def markdown_chunks(spark, sf):
    return _span_rows(table(spark, sf, "documents").where("kind = 'markdown'"), spans.markdown_spans(F.col("text"), 2000))


def python_chunks(spark, sf):
    rows = chunking.chunk_files(table(spark, sf, "documents").where("kind = 'python'"))
    return rows.select("file_path", "chunk_in_file", "first_character_index", "last_character_index")


#: Sources and the spans they must be cut into, by greatest size. Fixed values.
PYTHON_CASES = (
    ("comments", "# lic\nx=1\n# mid\ny=2\n", 20, ((6, 20),)),
    ("comments, small", "# lic\nx=1\n# mid\ny=2\n", 4, ((6, 10), (16, 20))),
    ("class", "class A:\n  x=1\n\n  def f(self):\n    pass\n", 25, ((9, 15), (16, 40))),
    ("one line", "a=1;b=2\n", 8, ((0, 8),)),
    ("one line, small", "a=1;b=2\n", 7, ((0, 7), (7, 8), (0, 7), (7, 8))),
    ("decorator", "@d\ndef f():\n  pass\n", 100, ((0, 19),)),
    ("comment alone", "# only\n", 100, ()),
    ("no syntax", "def (\n x\n", 6, ((0, 6), (6, 9))),
)


def python_golden(spark, sf):
    """Spans of sources whose right spans are known."""
    out = None
    for size in sorted({c[2] for c in PYTHON_CASES}):
        files = spark.createDataFrame([(n, "python", t) for n, t, s, _ in PYTHON_CASES if s == size], "file_path string, kind string, text string")
        rows = chunking.chunk_files(files, size).select("file_path", "chunk_in_file", "first_character_index", "last_character_index")
        out = rows if out is None else out.unionByName(rows)
    return out


def python_chunk_check(spark, sf):
    """What must hold of every Python file: chunks within the limit, in order, apart, and equal to their slice of the file."""
    files = table(spark, sf, "documents").where("kind = 'python'").select("file_path", "kind", "text")
    order = Window.partitionBy("file_path").orderBy("chunk_in_file")
    rows = chunking.chunk_files(files).withColumn("before", F.lag("last_character_index").over(order))
    rows = rows.join(files.select("file_path", F.col("text").alias("whole")), "file_path")
    s, e = F.col("first_character_index"), F.col("last_character_index")
    bad = {
        "n_over": e - s > chunking.MAX_CHUNK_SIZE, "n_unordered": s < F.col("before"),
        "n_empty": e <= s, "n_other_text": F.col("text") != prompts.text_slice(F.col("whole"), s, e),
    }
    found = rows.groupBy("file_path").agg(*(F.sum(F.coalesce(v, F.lit(False)).cast("long")).alias(k) for k, v in bad.items()))
    return files.select("file_path").join(found, "file_path", "left").select("file_path", *(F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in bad))


@scoped
def corpus_chunk_check(spark, sf, ws):
    """That chunks of all kinds are numbered 0, 1, ... in order of paths and of places in their files."""
    rows = ws.cut(chunking.numbered(ws.cut(chunking.chunk_files(table(spark, sf, "documents")), "chunks"), ws), "numbered")
    ends = rows.groupBy("file_path").agg(F.min("chunk_ord").alias("a"), F.max("chunk_ord").alias("b"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(chunking.path_order())  # a row for each file of the test table
    ends = ends.withColumn("next", F.lead("a").over(order))
    bad = F.col("next").isNotNull() & (F.col("next") != F.col("b") + 1) | (F.col("b") - F.col("a") + 1 != F.col("n"))
    return ends.agg((F.min("a") == 0).alias("from_zero"), F.sum(bad.cast("long")).alias("n_gaps"), (F.sum("n") == F.max("b") + 1).alias("dense"))


@scoped
def corpus_chunks(spark, sf, ws):
    rows = chunking.numbered(ws.cut(chunking.chunk_files(table(spark, sf, "documents")), "chunks"), ws)
    return rows.select("chunk_ord", "file_path", "first_character_index", "last_character_index")


def corpus_filter(spark, sf):
    rows = table(spark, sf, "documents").select("file_path")
    return rows.where(chunkable(F.col("file_path"))).select("file_path", kind_of_path(F.col("file_path")).alias("kind"))


def l2_normalise(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode(dense.l2_normalise(F.col("embedding"))).alias("pos", "x"))
    return rows.select("vec_id", "pos", F.round("x", 6).alias("x"))


def question_guard(spark, sf):
    rows = table(spark, sf, "answers").select("question_id", "question").distinct()
    return rows.where(has_text(F.col("question")))


# lexical index and search


def bm25_tf(spark, sf):
    return lexical.term_counts(chunk_rows(spark, sf)).drop("dl")


def bm25_df(spark, sf):
    return lexical.document_frequencies(lexical.term_counts(chunk_rows(spark, sf)))


def bm25_doc_len(spark, sf):
    return lexical.doc_lengths(lexical.term_counts(chunk_rows(spark, sf)))


def bm25_stats(spark, sf):
    chunks = chunk_rows(spark, sf)
    tf = lexical.term_counts(chunks)
    n, average = lexical.collection_stats(chunks, lexical.doc_lengths(tf))
    return tf.agg(F.countDistinct("term").alias("n_terms")).select(
        F.lit(n).cast("long").alias("n_chunks"), "n_terms", F.round(F.lit(average), 6).alias("avg_chunk_length")
    )


@scoped
def bm25_search_batch(spark, sf, ws):
    return lexical.search(item_questions(spark, sf), lexical.fit(chunk_rows(spark, sf), ws), 10)


@scoped
def stored_search_batch(spark, sf, ws):
    """The same search in an index that was saved and loaded."""
    lexical.save(lexical.fit(chunk_rows(spark, sf), ws), ws.at("index"))
    return lexical.search(item_questions(spark, sf), lexical.load(spark, ws.at("index")), 10)


@scoped
def bm25_no_path_tokens(spark, sf, ws):
    index = lexical.fit(chunk_rows(spark, sf), ws, k1=1.5, b=0.75, path_tokens=False)
    return lexical.search(item_questions(spark, sf), index, 10)


@scoped
def search_results(spark, sf, ws):
    chunks = chunk_rows(spark, sf)
    questions = item_questions(spark, sf)
    ranked = lexical.search(questions, lexical.fit(chunks, ws), 10)
    found = lexical.grouped(questions, ranked, chunks)
    label = F.transform("retrieved_sources", lambda s: F.concat_ws(":", s["file_path"], s["first_character_index"], s["last_character_index"]))
    return found.select("question_id", F.size("retrieved_sources").alias("n"), F.array_join(label, " ").alias("sources"))


# vectors and fusion


def cosine_topk(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    questions = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), "embedding")
    return dense.cosine_top(questions, vectors, 10, key="vec_id", exclude_self=True)


def _rankings(spark, sf, ws):
    """Two rankings of chunks for every usable vector whose chunk is divisible by 20: by its path's words and by its vector."""
    chunks = chunk_rows(spark, sf)
    every = table(spark, sf, "chunk_vectors").where(F.size("embedding") == 128)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = every.where(finite).groupBy("chunk_ord").agg(F.min("embedding").alias("embedding"))
    mine = vectors.where("chunk_ord % 20 = 0")
    paths = chunks.groupBy("chunk_ord").agg(F.min("file_path").alias("question"))
    questions = mine.select("chunk_ord").join(paths, "chunk_ord").select(F.col("chunk_ord").alias("question_id"), "question")
    pool = fusion.pool_size(10)
    by_words = lexical.search(questions, lexical.fit(chunks, ws), pool)
    by_vector = dense.cosine_top(mine.select(F.col("chunk_ord").alias("question_id"), "embedding"), vectors, pool)
    return by_words, by_vector


@scoped
def hybrid_search(spark, sf, ws):
    return fusion.hybrid(*_rankings(spark, sf, ws), 10)


@scoped
def rrf_equal(spark, sf, ws):
    return fusion.fuse(*_rankings(spark, sf, ws), limit=10)


# evaluation


def _ranked_docs(spark, sf):
    """True and retrieved sources: what answers cite, and their list turned round and shifted as another system's result."""
    rows = asked(spark, sf)
    truth = rows.select("question_id", F.col("retrieved_sources").alias("sources"), "answer")
    shifted = F.transform("retrieved_sources", lambda s: F.struct(
        s["file_path"].alias("file_path"), (s["first_character_index"] + 300).alias("first_character_index"), (s["last_character_index"] + 500).alias("last_character_index")))
    return truth, rows.select("question_id", F.reverse(shifted).alias("retrieved_sources"))


def iou_pairs(spark, sf):
    return evaluation.overlaps(*_ranked_docs(spark, sf))


def recall_at_k(spark, sf):
    return evaluation.recall(*_ranked_docs(spark, sf))


def mean_recall(spark, sf):
    return evaluation.mean_recall(*_ranked_docs(spark, sf))


def _searched(spark, sf, ws):
    """What answers cite, and what BM25 finds for their questions among all chunks."""
    rows, chunks = asked(spark, sf), chunk_rows(spark, sf)
    found = lexical.grouped(rows, lexical.search(rows, lexical.fit(chunks, ws), 10), chunks)
    return rows.select("question_id", F.col("retrieved_sources").alias("sources"), "answer"), ws.cut(found.select("question_id", "retrieved_sources"), "found")


@scoped
def search_recall(spark, sf, ws):
    return evaluation.recall(*_searched(spark, sf, ws))


@scoped
def search_mean_recall(spark, sf, ws):
    return evaluation.mean_recall(*_searched(spark, sf, ws))


# documents and index folders, written and read again


@scoped
def questions_roundtrip(spark, sf, ws):
    rows = asked(spark, sf).where("question is not null").select("question_id", "question", F.col("retrieved_sources").alias("sources"), "answer")
    back = jsonio.read_questions(spark, jsonio.write_questions(rows, ws.at("questions.json")))
    return back.select("question_id", "question", F.coalesce(F.size("sources"), F.lit(-1)).alias("n"), "answer")


def _places(rows):
    label = F.transform("retrieved_sources", lambda s: F.concat_ws(":", s["file_path"], s["first_character_index"], s["last_character_index"]))
    return rows.withColumn("sources", F.array_join(label, " "))


@scoped
def results_roundtrip(spark, sf, ws):
    rows = asked(spark, sf).where("question is not null and retrieved_sources is not null")
    back, k = jsonio.read_results(spark, jsonio.write_results(rows, 10, ws.at("out"), "results.json"))
    return _places(back).select("question_id", "question", "sources", F.lit(k).alias("k"))


@scoped
def answers_roundtrip(spark, sf, ws):
    rows = asked(spark, sf).where("question is not null and retrieved_sources is not null and answer is not null")
    back, k = jsonio.read_answers(spark, jsonio.write_answers(rows, 10, ws.at("out"), "answers.json"))
    return _places(back).select("question_id", "question", "sources", "answer", F.lit(k).alias("k"))


def _indexed_tree(spark, sf, ws):
    """An index of all documents, written as files, after an incremental run that found nothing new."""
    root = ws.at("tree")
    write_tree(table(spark, sf, "documents"), root)
    engine = Engine(spark, ws.at("engine"))
    engine.index(root, build_embeddings=True)
    engine.index(root, incremental_run=True)
    return engine, root


@scoped
def engine_files(spark, sf, ws):
    """Files that an index holds: path below the root, kind, bytes as listed, characters as stored."""
    engine, root = _indexed_tree(spark, sf, ws)
    texts = engine.files().select("file_path", F.length("text").cast("long").alias("n_chars"))
    rows = engine.load_manifest().join(texts, "file_path").withColumn("file_path", F.substring(F.col("file_path"), len(root) + 2, 1 << 20))
    return ws.cut(rows.select("file_path", "kind", F.col("size").alias("n_bytes"), "n_chars"), "result")


@scoped
def engine_check(spark, sf, ws):
    """How an index agrees with itself: chunks without a vector or with several, or with another length than their postings add up to; terms of other frequency."""
    engine, _ = _indexed_tree(spark, sf, ws)
    index, chunks = engine.lexical_index(), engine.chunks()
    sums = index.postings.groupBy("chunk_ord").agg(F.sum("tf").alias("t"), F.max("dl").alias("dl"))
    vectors = engine.vectors().groupBy("chunk_ord").agg(F.count(F.lit(1)).alias("v"))
    rows = chunks.join(sums, "chunk_ord", "left").join(vectors, "chunk_ord", "left")
    bad = rows.agg(
        F.sum((F.coalesce("v", F.lit(0)) != 1).cast("long")).alias("n_without_vector"), F.sum((F.coalesce("t", F.lit(0)) != F.coalesce("dl", F.lit(0))).cast("long")).alias("n_other_length"),
        (F.count(F.lit(1)) == index.n_chunks).alias("all_counted"),
    )
    df = index.df.join(lexical.document_frequencies(index.postings).withColumnRenamed("df", "own"), "term", "full").where(~F.col("df").eqNullSafe(F.col("own")))
    return ws.cut(bad.crossJoin(df.agg(F.count(F.lit(1)).alias("n_other_df"))), "result")  # one row each


# prompts and answers


def prompt_blocks(spark, sf):
    return prompts.prompt_blocks(asked(spark, sf), table(spark, sf, "documents"))


def prompt_text(spark, sf):
    return prompts.prompts(asked(spark, sf), table(spark, sf, "documents"))


def source_slices(spark, sf):
    return prompts.source_texts(asked(spark, sf), table(spark, sf, "documents"))


def answer_dataset(spark, sf):
    rows = answering.answer_results(asked(spark, sf), table(spark, sf, "documents"))
    return rows.select("question_id", F.coalesce(F.size("retrieved_sources"), F.lit(-1)).alias("n"), "answer")


# manifests and incremental indexing


def _snapshots(spark, sf):
    """Files of the last two succeeded runs."""
    states = merkle.file_states(table(spark, sf, "file_scans"), table(spark, sf, "index_runs"))
    last = table(spark, sf, "index_runs").where("status = 'succeeded'").select("run_id").distinct().count()
    own = [incremental.manifest(states.where(F.col(merkle.VERSION) == v)) for v in (last - 1, last)]
    return own[0], own[1]


def manifest_diff(spark, sf):
    return incremental.diff_manifests(*_snapshots(spark, sf))


def _frequencies(files, paths):
    """Document frequencies of the files of some paths, cut into chunks."""
    return lexical.chunk_frequencies(chunking.chunk_files(files.join(paths.select("file_path"), "file_path", "left_semi")))


def _incremental_df(spark, sf, ws, documents):
    """The old snapshot's frequencies, and to them what the files that changed, came or went add and take away."""
    old, new = _snapshots(spark, sf)
    files = documents.select("file_path", "kind", "text")
    diff = ws.cut(incremental.diff_manifests(old, new), "diff")
    df0 = ws.cut(_frequencies(files, old), "df")
    went = old.join(diff.where("status <> 'unchanged'"), "file_path", "left_semi")
    delta = incremental.signed_frequencies(_frequencies(files, diff.where("status = 'changed'")), _frequencies(files, went))
    return lexical.summed(df0.unionByName(delta))


def _full_df(spark, sf, ws, documents):
    _, new = _snapshots(spark, sf)
    return _frequencies(documents.select("file_path", "kind", "text"), new)


@scoped
def incremental_df_all(spark, sf, ws):
    """Document frequencies after an incremental build on what the last run changed; no SQL, which cannot cut Python."""
    return _incremental_df(spark, sf, ws, table(spark, sf, "documents"))


@scoped
def full_df_all(spark, sf, ws):
    """The same by a full build; its rows must equal those of ``incremental_df_all``."""
    return _full_df(spark, sf, ws, table(spark, sf, "documents"))


@scoped
def incremental_check(spark, sf, ws):
    """How many terms, over all kinds of files, have another frequency after an incremental build than after a full one."""
    documents = table(spark, sf, "documents")
    a = ws.cut(_incremental_df(spark, sf, ws, documents), "incremental")
    b = ws.cut(_full_df(spark, sf, ws, documents), "full").withColumnRenamed("df", "own")
    differ = a.join(b, "term", "full").where(~F.col("df").eqNullSafe(F.col("own")))
    return differ.agg(F.count(F.lit(1)).alias("n_differing"))


@scoped
def incremental_df(spark, sf, ws):
    """``incremental_df_all`` of the markdown files alone, which is what its SQL can check."""
    return _incremental_df(spark, sf, ws, table(spark, sf, "documents").where("kind = 'markdown'"))


@scoped
def full_df(spark, sf, ws):
    """The same by a full build; its rows must equal those of ``incremental_df``."""
    return _full_df(spark, sf, ws, table(spark, sf, "documents").where("kind = 'markdown'"))


QUERIES = {
    f.__name__: f
    for f in (
        p3_found, p3_store, tokenize_chunks, hard_split_docs, line_pack_docs, paragraph_spans, markdown_chunks, python_chunks, corpus_chunks, corpus_filter,
        l2_normalise, question_guard, bm25_tf, bm25_df, bm25_doc_len, bm25_stats, bm25_search_batch, bm25_no_path_tokens, search_results,
        cosine_topk, hybrid_search, rrf_equal, iou_pairs, recall_at_k, mean_recall, prompt_blocks, prompt_text, source_slices, answer_dataset,
        manifest_diff, incremental_df, full_df, incremental_df_all, full_df_all, incremental_check,
        python_golden, python_chunk_check, corpus_chunk_check, stored_search_batch, search_recall, search_mean_recall,
        questions_roundtrip, results_roundtrip, answers_roundtrip, engine_files, engine_check,
    )
}
