"""BM25: inverted index of chunks, scoring of a batch of questions, ranking."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import has_text, tokenize
from ..plans.workspace import Workspace

K1, B = 1.2, 0.5
#: Question terms that are broadcast to the postings at a time; more are taken in further passes.
BROADCAST_TERMS = 200_000
#: Question terms that a search sends to all tasks at a time, 4 bytes each there; chunks that one task scores together.
SEARCH_TERMS, SEARCH_CHUNKS = 500_000, 20_000
#: Fewer chunks than this aren't worth a task.
LEAST_CHUNKS = 1000
#: Scores that differ by less may be equal when rounded to 6 places.
NEAR = 2e-6
#: For up to so many different terms, the parts of a stored index that hold none of them aren't read.
FEW_TERMS = 200
#: Postings of one part of a stored index, and of one file in it; the greatest number of parts.
PART_ROWS, FILE_ROWS, MOST_PARTS = 250_000, 4_000_000, 4096


def _token_rows(chunks: DataFrame, path_tokens: bool, *keys: str) -> DataFrame:
    """``(keys, tokens)``: tokens of a chunk's text and, folded in, of its file's path; none of a null text (an unreadable file)."""
    tokens = tokenize(F.col("text"))
    if path_tokens:
        tokens = F.concat(tokens, tokenize(F.col("file_path")))
    # one row each; a fence: tokens are made once
    return chunks.where(F.col("text").isNotNull()).select(*keys, F.explode(F.array(tokens)).alias("tokens"))


def term_counts(chunks: DataFrame, path_tokens: bool = True) -> DataFrame:
    """``(chunk_ord, term, tf, dl)``: how often each term occurs in a chunk; ``dl`` counts all its tokens.

    ``chunks``: ``(chunk_ord, file_path, text)``, each number once. A null text
    has no terms at all; null ``chunk_ord`` is dropped. The length comes from
    the row itself, so one shuffle of counts is all.
    """
    rows = _token_rows(chunks.where(F.col("chunk_ord").isNotNull()), path_tokens, "chunk_ord")
    # the length before the explosion, else the array rides along with each of its tokens; outer, else a filter
    # on the array's size is inferred and tokenizes once more
    rows = rows.select("chunk_ord", "tokens", F.size("tokens").cast("long").alias("dl"))
    rows = rows.select("chunk_ord", "dl", F.explode_outer("tokens").alias("term")).where(F.col("term").isNotNull())
    return rows.groupBy("chunk_ord", "dl", "term").agg(F.count(F.lit(1)).alias("tf")).select("chunk_ord", "term", "tf", "dl")


def chunk_frequencies(chunks: DataFrame, path_tokens: bool = True) -> DataFrame:
    """``(term, df)`` straight from chunks, without postings: counts are added up before anything is shuffled."""
    rows = _token_rows(chunks, path_tokens).select(F.explode_outer(F.array_distinct("tokens")).alias("term"))
    return document_frequencies(rows.where(F.col("term").isNotNull()))


def doc_lengths(postings: DataFrame) -> DataFrame:
    """``(chunk_ord, dl)``"""
    return postings.groupBy("chunk_ord").agg(F.max("dl").alias("dl"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """``(term, df)``"""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def part_of(parts: int, term: Column | str = "term") -> Column:
    """The part of a stored index that a term lies in."""
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


@dataclass
class Segment:
    """Stored postings and document frequencies, by parts; ``dead (file_no)``: files whose postings no longer count."""

    postings: DataFrame
    df: DataFrame
    parts: int
    dead: DataFrame | None = None

    def live(self, rows: DataFrame) -> DataFrame:
        if self.dead is None:
            return rows
        return rows.join(self.dead, F.shiftright("chunk_ord", FILE_SHIFT) == F.col("file_no"), "left_anti")

    def holding(self, terms: list[str], numbers: list[int]) -> tuple[DataFrame, DataFrame]:
        """Postings and frequencies of some terms: other parts aren't read, nor row groups that hold none of them."""
        wanted = F.col("part").isin(numbers) & F.col("term").isin(terms)
        return self.live(self.postings.where(wanted)), self.df.where(wanted)


#: Chunk numbers of a stored index are ``file_no << FILE_SHIFT | chunk_in_file``.
FILE_SHIFT = 20


@dataclass
class LexicalIndex:
    """``postings (term, chunk_ord, tf, dl)``, ``df (term, df)`` and the numbers that scoring needs.

    An index that was loaded has ``segments``, which know where a term lies.
    """

    postings: DataFrame
    df: DataFrame
    n_chunks: int
    avg_chunk_length: float
    k1: float = K1
    b: float = B
    segments: list[Segment] = field(default_factory=list)

    def summary(self) -> tuple[int, int]:
        """Number of chunks and of different terms."""
        return self.n_chunks, self.df.count()

    def narrowed(self, terms: list[str]) -> "LexicalIndex":
        """The same index as far as ``terms`` need it."""
        if not self.segments or not terms:
            return self
        spark = self.postings.sparkSession
        numbers = (F.transform("terms", partial(part_of, s.parts)) for s in self.segments)
        found = spark.sql("SELECT :t AS terms", {"t": list(terms)}).select(*numbers).first()
        held = [s.holding(terms, sorted(set(n))) for s, n in zip(self.segments, found)]
        return replace(self, postings=_all(p for p, _ in held), df=summed(_all(d for _, d in held)))


def _all(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def summed(df: DataFrame) -> DataFrame:
    """Document frequencies from signed parts of them."""
    return df.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


def from_segments(segments: list[Segment], n_chunks: int, average: float, k1: float = K1, b: float = B) -> LexicalIndex:
    postings = _all(s.live(s.postings) for s in segments).select("term", "chunk_ord", "tf", "dl")
    df = _all(s.df for s in segments).select("term", "df")
    return LexicalIndex(postings, summed(df) if len(segments) > 1 else df, n_chunks, average, k1, b, segments)


def collection_stats(chunks: DataFrame, dl: DataFrame) -> tuple[int, float]:
    """Number of chunks (unreadable ones too) and their average length, 0.0 without chunks."""
    n = chunks.where(F.col("chunk_ord").isNotNull()).select("chunk_ord").distinct().count()
    total = dl.agg(F.sum("dl")).first()[0] or 0
    return n, total / n if n else 0.0


def fit(chunks: DataFrame, ws: Workspace, k1: float = K1, b: float = B, path_tokens: bool = True) -> LexicalIndex:
    """Index of ``chunks (chunk_ord, file_path, text)``; repeated rows would add up and must be removed before.

    Texts are tokenized once. The chunk lengths ride in the postings, so scoring
    needs no join for them.
    """
    return from_postings(chunks, term_counts(chunks, path_tokens), ws, k1, b)


def from_postings(chunks: DataFrame, postings: DataFrame, ws: Workspace, k1: float = K1, b: float = B) -> LexicalIndex:
    postings = ws.cut(postings, "postings")
    n, average = collection_stats(chunks, doc_lengths(postings))
    return LexicalIndex(postings, ws.cut(document_frequencies(postings), "df"), n, average, k1, b)


def idf(n_chunks: int) -> Column:
    return F.log((F.lit(float(n_chunks)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)


def term_score(index: LexicalIndex) -> Column:
    """Share of one term in a chunk's score; needs ``df``, ``tf`` and ``dl``."""
    k1, b = float(index.k1), float(index.b)
    norm = F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.lit(index.avg_chunk_length or 1.0)
    return idf(index.n_chunks) * F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * norm)


def question_terms(questions: DataFrame) -> DataFrame:
    """``(question_id, term)``: the different tokens of each question that has any text."""
    rows = questions.where(has_text(F.col("question")))
    return rows.select("question_id", F.explode(F.array_distinct(tokenize(F.col("question")))).alias("term"))


def scores(questions: DataFrame, index: LexicalIndex) -> DataFrame:
    """``(question_id, chunk_ord, score)`` above 0, rounded to 6 places.

    All questions are one join of their terms with the postings. The question
    side is broadcast, so postings stay where they are, however unevenly terms
    are spread, and are summed before the shuffle by question and chunk. More
    question terms than ``BROADCAST_TERMS`` are taken in blocks of whole
    questions, each one more pass over the postings. For few terms, only the
    parts of a stored index that hold them are read.
    """
    terms = question_terms(questions)
    few = terms.select("term").distinct().limit(FEW_TERMS + 1).collect() if index.segments else []
    if few and len(few) <= FEW_TERMS:
        index = index.narrowed(sorted(r[0] for r in few))
    terms = terms.join(index.df, "term")
    blocks = -(-terms.count() // BROADCAST_TERMS) or 1
    parts = []
    for i in range(blocks):
        own = terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == i)
        parts.append(index.postings.join(F.broadcast(own), "term").select("question_id", "chunk_ord", term_score(index).alias("part")))
    total = _all(parts).groupBy("question_id", "chunk_ord").agg(F.round(F.sum("part"), 6).alias("score"))
    return total.where(F.col("score") > 0)


def top(scored: DataFrame, k: int) -> DataFrame:
    """Adds ``rank`` from 1 to ``k`` by score; ties go to the smaller ``chunk_ord``. ``k`` below 1 gives nothing."""
    order = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "chunk_ord")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_of(terms: list[str], index: LexicalIndex, k: int) -> DataFrame:
    """``(chunk_ord, score, rank)`` of the ``k`` best chunks for one question's terms: one job over the parts that hold them."""
    own = index.narrowed(terms)
    rows = own.postings.where(F.col("term").isin(terms)).join(F.broadcast(own.df.where(F.col("term").isin(terms))), "term")
    total = rows.groupBy("chunk_ord").agg(F.round(F.sum(term_score(index)), 6).alias("score")).where(F.col("score") > 0)
    best = total.orderBy(F.col("score").desc(), "chunk_ord").limit(max(0, k))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "chunk_ord")))  # k rows


def search(questions: DataFrame, index: LexicalIndex, k: int = 10) -> DataFrame:
    """``(question_id, chunk_ord, score, rank)``: the ``k`` best chunks of each question; the same as ``top`` of ``scores``.

    Postings of question terms are brought together by chunks, ``SEARCH_CHUNKS``
    to a task, and the questions are sent to all tasks, so that a task gives
    out its ``k`` best chunks of each question and no row is made for every
    question and chunk that meet. More question terms than ``SEARCH_TERMS`` are
    taken in blocks of whole questions, each one more pass over the postings.
    """
    if k < 1:
        questions = questions.limit(0)
    spark = index.postings.sparkSession
    terms = question_terms(questions)
    few = terms.select("term").distinct().limit(FEW_TERMS + 1).collect() if index.segments else []
    if few and len(few) <= FEW_TERMS:
        index = index.narrowed(sorted(r[0] for r in few))
    terms = terms.join(index.df, "term").select("question_id", "term", "df")
    blocks = -(-terms.count() // SEARCH_TERMS) or 1
    n = index.n_chunks
    tasks = max(1, -(-n // SEARCH_CHUNKS), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_CHUNKS)))
    kind = dict(terms.dtypes)["question_id"]
    parts = []
    for i in range(blocks):
        own = terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == i)
        block = own.toArrow().combine_chunks()
        asked, words = (block.column(c).combine_chunks().dictionary_encode("encode") for c in range(2))
        if not len(block):
            continue
        at = words.indices.to_numpy()
        df = np.zeros(len(words.dictionary), np.int64)
        df[at] = block.column(2).to_numpy()
        vocabulary = spark.createDataFrame(pa.table({"term": words.dictionary, "no": pa.array(np.arange(len(df), dtype=np.int32)), "df": df}))
        order = np.argsort(asked.indices.to_numpy(), kind="stable")
        starts = np.searchsorted(asked.indices.to_numpy()[order], np.arange(len(asked.dictionary) + 1))
        held = spark.sparkContext.broadcast((asked.dictionary, starts, at[order].astype(np.int32), len(df)))
        rows = index.postings.join(F.broadcast(vocabulary), "term").select("no", "chunk_ord", term_score(index).alias("part"))
        rows = rows.withColumn("task", F.pmod(F.xxhash64("chunk_ord"), F.lit(tasks)).cast("int")).repartitionById(tasks, "task")
        parts.append(rows.select("no", "chunk_ord", "part").mapInArrow(partial(_best_chunks, held=held, k=k), f"question_id {kind}, chunk_ord long, score double"))
    if not parts:
        return top(spark.createDataFrame([], f"question_id {kind}, chunk_ord long, score double"), k)
    return top(_all(parts), k)


def _best_chunks(batches, held, k: int):
    """The ``k`` best chunks of each question among those whose postings ``(no, chunk_ord, part)`` are in ``batches``."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    ids, starts, asked, n_terms = held.value
    table = pa.Table.from_batches(rows)
    no, chunk, part = (table.column(c).to_numpy() for c in range(3))
    chunks, at = np.unique(chunk, return_inverse=True)  # in order, so that ties go to the smaller place
    n = len(chunks)
    cell, place = np.unique(no.astype(np.int64) * n + at, return_inverse=True)
    part = np.bincount(place, part)
    at = cell % n
    ends = np.searchsorted(cell, np.arange(n_terms + 1) * n)
    size = np.diff(ends)
    # the rows of terms that many chunks have are held in full; all of them take a few times the bytes of the postings
    full = {t: np.bincount(at[ends[t] : ends[t + 1]], part[ends[t] : ends[t + 1]], n) for t in np.flatnonzero(size * 8 > n)}
    common = size * 8 > n
    most = np.zeros(n_terms)
    most[size > 0] = np.maximum.reduceat(part, ends[:-1][size > 0])
    bounded = part.min() >= 0
    got: list[tuple[int, np.ndarray, np.ndarray]] = []
    count = 0
    for q in range(len(ids)):
        terms = asked[starts[q] : starts[q + 1]]
        terms = terms[size[terms] > 0]
        if not len(terms):
            continue
        wide = [full[t] for t in terms[common[terms]]]
        slices = [slice(ends[t], ends[t + 1]) for t in terms[~common[terms]]]
        score = np.bincount(np.concatenate([at[x] for x in slices]), np.concatenate([part[x] for x in slices]), n) if slices else np.zeros(n)
        found = np.flatnonzero(score) if slices else np.zeros(0, np.int64)
        rest = most[terms[common[terms]]].sum()
        least = _kth(score[found], k)
        if bounded and least > rest + NEAR:  # common terms alone lift no chunk among the best
            found = found[score[found] + rest >= least - NEAR]
            score = score[found] + sum(w[found] for w in wide)
        else:
            for w in wide:
                score += w
            found = np.flatnonzero(score >= max(_kth(score, k) - NEAR, 0.0))
            score = score[found]
        score = np.round(score, 6)
        best = np.lexsort((found, -score))[:k]
        best = best[score[best] > 0]
        got.append((q, found[best], score[best]))
        count += len(best)
        if count >= 100_000:
            yield _scored(ids, chunks, got)
            got, count = [], 0
    if got:
        yield _scored(ids, chunks, got)


def _kth(values: np.ndarray, k: int) -> float:
    """The ``k``-th greatest value, -1 if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -1.0


def _scored(ids: pa.Array, chunks: np.ndarray, got: list) -> pa.RecordBatch:
    asked = ids.take(pa.array(np.repeat([g[0] for g in got], [len(g[1]) for g in got])))
    cols = [asked, pa.array(chunks[np.concatenate([g[1] for g in got])]), pa.array(np.concatenate([g[2] for g in got]))]
    return pa.RecordBatch.from_arrays(cols, names=["question_id", "chunk_ord", "score"])


def grouped(questions: DataFrame, ranked: DataFrame, chunks: DataFrame, order: str | None = None) -> DataFrame:
    """``(question_id, question, retrieved_sources)``: a row for every question, in rank order, empty without hits."""
    source = F.struct("file_path", "first_character_index", "last_character_index").alias("source")
    places = chunks.select("chunk_ord", source).dropDuplicates(["chunk_ord"])
    lists = ranked.select("question_id", "chunk_ord", "rank").join(places, "chunk_ord").groupBy("question_id")
    lists = lists.agg(F.array_sort(F.collect_list(F.struct("rank", "source"))).alias("r"))
    kind = "array<struct<file_path:string,first_character_index:bigint,last_character_index:bigint>>"
    found = F.coalesce(F.transform("r", lambda x: x["source"]), F.array().cast(kind)).alias("retrieved_sources")
    extra = [order] if order else []
    return questions.join(lists, "question_id", "left").select("question_id", "question", found, *extra)


def save_parts(postings: DataFrame, df: DataFrame, path: str) -> int:
    """Writes postings and (signed) frequencies by parts, terms in order within a file; returns the number of parts.

    There are as many parts as ``PART_ROWS`` asks for. A part of more rows than
    ``FILE_ROWS``, as a hot term makes it, is written as several files.
    """
    rows = postings.count()
    parts = int(min(MOST_PARTS, max(1, -(-rows // PART_ROWS))))
    files = max(1, rows // (parts * FILE_ROWS))
    marked = postings.select("term", "chunk_ord", "tf", "dl", part_of(parts).alias("part"))
    sizes = marked.groupBy("part").count().where(F.col("count") > FILE_ROWS).select("part", F.ceil(F.col("count") / FILE_ROWS).cast("int").alias("files"))
    spread = F.pmod(F.xxhash64("chunk_ord"), F.coalesce("files", F.lit(1)))
    marked = marked.join(F.broadcast(sizes), "part", "left").withColumn("file", spread).drop("files")  # a row for each large part
    marked.repartition(parts * max(1, files), "part", "file").sortWithinPartitions("part", "term").drop("file").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    marked = df.select("term", "df", part_of(parts).alias("part"))
    marked.repartition(parts, "part").sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{path}/df")
    return parts


def load_segment(spark: SparkSession, path: str, parts: int, dead: DataFrame | None = None) -> Segment:
    # the schemas are given, since without terms there is no file
    postings = spark.read.schema("term string, chunk_ord long, tf long, dl long, part int").parquet(f"{path}/postings")
    return Segment(postings, spark.read.schema("term string, df long, part int").parquet(f"{path}/df"), parts, dead)


def save(index: LexicalIndex, path: str) -> None:
    """Postings by a hash of the term, so that a question reads only the parts of its terms."""
    spark: SparkSession = index.postings.sparkSession
    parts = save_parts(index.postings, index.df, path)
    stats = [(float(index.k1), float(index.b), index.n_chunks, float(index.avg_chunk_length), parts)]
    schema = "k1 double, b double, n_chunks long, avg_chunk_length double, parts int"
    spark.createDataFrame(stats, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def load(spark: SparkSession, path: str) -> LexicalIndex:
    k1, b, n, average, parts = spark.read.parquet(f"{path}/stats").first()
    return from_segments([load_segment(spark, path, parts)], n, average, k1, b)
