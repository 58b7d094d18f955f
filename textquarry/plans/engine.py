"""Index folder, caches and the calls that the command line and the server share."""

from __future__ import annotations

import threading
import uuid
from collections import OrderedDict
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import check_size
from ..operators import answering, chunking, dense, evaluation, fusion, incremental, lexical, prompts
from ..sources import jsonio
from ..sources.corpus import list_corpus, with_texts
from .ship import ship
from .versions import Versions
from .workspace import Workspace, delete_path, list_names

#: Changes whenever chunks or tokens change, so that an index of another tokenizer isn't added to.
TOKENIZER = 2
#: Dead files, as a share of all, and segments from which on an incremental run writes one new segment of what lives.
MOST_DEAD, MOST_SEGMENTS = 0.2, 16
#: Dead files up to this number are broadcast to the postings of a search.
BROADCAST_DEAD = 200_000
#: Files whose texts lie in one part of a segment, and the greatest number of parts.
PART_FILES, MOST_PARTS = 512, 4096

CHUNKS = "chunk_ord long, file_no long, file_path string, chunk_in_file int, first_character_index long, last_character_index long"
MANIFEST = "file_path string, kind string, mtime double, size long, file_no long, segment string"
DEAD = "segment string, file_no long"
FILES = "file_path string, file_no long, kind string, text string, part int"
SETTINGS = (
    "max_chunk_size int, tokenizer int, n_files long, n_chunks long, length long, next_file long, semantic boolean,"
    " segments array<struct<folder:string,parts:int,file_parts:int>>"
)


@dataclass(frozen=True)
class Source:
    file_path: str
    first_character_index: int
    last_character_index: int


class QueryCache:
    """The last results by (query, k, use_semantic, index version), least recently used out first. An empty result is a hit, too."""

    def __init__(self, size: int = 256):
        self.size, self.hits, self.misses = size, 0, 0
        self._rows: OrderedDict[tuple, list[Source]] = OrderedDict()
        self._lock = threading.Lock()

    def get(self, *key) -> list[Source] | None:
        with self._lock:
            found = self._rows.get(key)
            if found is None:
                self.misses += 1
                return None
            self._rows.move_to_end(key)
            self.hits += 1
            return found

    def put(self, value: list[Source], *key) -> None:
        with self._lock:
            self._rows[key] = value
            self._rows.move_to_end(key)
            while len(self._rows) > self.size:
                self._rows.popitem(last=False)


def _text_part(parts: int, path="file_path"):
    return F.pmod(F.xxhash64(path), F.lit(parts)).cast("int")


class Engine:
    """An index in a folder of versions (see ``plans.versions``).

    A version has a manifest of all files and names the segments that hold
    them: texts, chunks, postings, signed document frequencies and vectors. A
    run adds one segment, of the files it has cut; older segments stay where
    they are, and what is gone or cut anew in them is listed as dead. So the
    work of an incremental run is in what changed, but for the listing and the
    comparison of the manifests. When too much is dead, or segments are too
    many, a run writes all that lives into one segment.

    A version becomes the current one in one step; a run that fails changes nothing.
    """

    def __init__(self, spark: SparkSession, index_dir: str, encoder: dense.Encoder | None = None, generator: answering.Generator | None = None):
        ship(spark)
        self.spark, self.path = spark, index_dir.rstrip("/")
        self.encoder, self.generator = encoder or dense.HashEncoder(), generator or answering.ExtractiveGenerator()
        self.cache = QueryCache()
        self._versions = Versions(spark, self.path)
        self._loaded: tuple[int, dict] = (0, {})
        self._lock = threading.RLock()

    # versions

    def version(self) -> int:
        return self._versions.current()

    def _get(self, name: str, make):
        """``make(version)`` of the current version, once."""
        with self._lock:
            version = self.version()
            if not version:
                raise FileNotFoundError(f"no index in {self.path}")
            if self._loaded[0] != version:
                self.close()
                self._loaded = version, {}
            if name not in self._loaded[1]:
                self._loaded[1][name] = make(version)
            return self._loaded[1][name]

    def close(self) -> None:
        """Gives up the loaded tables."""
        with self._lock:
            for held in self._loaded[1].values():
                if isinstance(held, DataFrame):
                    held.unpersist()
            self._loaded = 0, {}

    def settings(self) -> dict | None:
        read = lambda v: self.spark.read.schema(SETTINGS).parquet(f"{self._versions.folder(v)}/settings").first().asDict(True)
        return self._get("settings", read) if self.version() else None

    def load_manifest(self) -> DataFrame | None:
        """Manifest of the current version; None before the first."""
        return self._get("manifest", lambda v: self.spark.read.schema(MANIFEST).parquet(f"{self._versions.folder(v)}/manifest")) if self.version() else None

    def dead(self) -> DataFrame:
        return self._get("dead", lambda v: self.spark.read.schema(DEAD).parquet(f"{self._versions.folder(v)}/dead"))

    def _dead_of(self, segment: str) -> DataFrame | None:
        """Numbers of the dead files of a segment; None if all live."""
        n = self._get("n_dead", lambda v: dict(self.dead().groupBy("segment").count().collect())).get(segment, 0)  # a row for each segment
        own = self.dead().where(F.col("segment") == segment).select("file_no")
        return None if not n else F.broadcast(own) if n <= BROADCAST_DEAD else own

    def _read(self, folder: str, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}/{name}")

    def _live(self, name: str, schema: str) -> DataFrame:
        """Rows of all segments whose files still count; the tables have ``file_no``."""
        return lexical._all(self._alive(s["folder"], self._read(s["folder"], name, schema)) for s in self.settings()["segments"])

    def _alive(self, folder: str, rows: DataFrame) -> DataFrame:
        dead = self._dead_of(folder)
        return rows if dead is None else rows.join(dead, "file_no", "left_anti")

    # building

    def _write_texts(self, files: DataFrame, n: int, path: str) -> int:
        parts = max(1, min(MOST_PARTS, -(-n // PART_FILES)))
        rows = files.select("file_path", "file_no", "kind", "text", _text_part(parts).alias("part"))
        rows.repartition(parts, "part").write.partitionBy("part").parquet(path)
        return parts

    def texts_of(self, paths: DataFrame, few: int = 1000) -> DataFrame:
        """``(file_path, file_no, kind, text)`` of the live files of ``paths``; for few paths, only their parts of the segments are read."""
        names = [r[0] for r in paths.select("file_path").distinct().limit(few + 1).collect()]
        out = []
        for s in self.settings()["segments"]:
            rows = self._read(s["folder"], "files", FILES)
            if len(names) <= few:
                found = self.spark.sql("SELECT :p AS p", {"p": names}).select(F.transform("p", partial(_text_part, s["file_parts"]))).first()[0] if names else []
                rows = rows.where(F.col("part").isin(sorted(set(found))) & F.col("file_path").isin(names))
            else:
                rows = rows.join(paths.select("file_path").distinct(), "file_path", "left_semi")
            out.append(self._alive(s["folder"], rows).select("file_path", "file_no", "kind", "text"))
        return lexical._all(out)

    def index(self, root: str, max_chunk_size: int = chunking.MAX_CHUNK_SIZE, build_embeddings: bool = False, incremental_run: bool = False) -> dict:
        """Indexes the files below ``root``; returns numbers of chunks, terms and reprocessed files.

        An incremental run reads, cuts and tokenizes changed files only. Without
        an index, or with one of another chunk size or tokenizer (or without
        vectors, if they are wanted), it is a full run. A file that can't be
        read is in no manifest, so the next run tries it again.
        """
        check_size(max_chunk_size)
        spark, base = self.spark, self.version()
        old = self.settings()
        kept = bool(incremental_run and old and (old["max_chunk_size"], old["tokenizer"]) == (max_chunk_size, TOKENIZER) and (old["semantic"] or not build_embeddings))
        semantic = build_embeddings or kept and old["semantic"]
        stage = self._versions.stage()
        folder = stage.rpartition("/")[2]
        ws = Workspace(spark, "index")
        try:
            listing = ws.cut(list_corpus(spark, root), "listing")
            before = self.load_manifest() if kept else None
            diff = ws.cut(incremental.diff_manifests(before, incremental.manifest(listing)), "diff")
            changed = listing.join(diff.where("status = 'changed'").select("file_path"), "file_path", "left_semi")
            # numbers: a file keeps its own; new ones follow, in order of their paths
            first = old["next_file"] if kept else 0
            new = changed.join(before.select("file_path"), "file_path", "left_anti") if kept else changed
            todo = chunking.number_files(new, ws).withColumn("file_no", F.col("start") + first).drop("start")
            if kept:
                todo = todo.unionByName(changed.join(before.select("file_path", "file_no"), "file_path"))
            todo = ws.cut(todo, "todo")
            top, volume = todo.agg(F.max("file_no"), F.sum("size")).first()
            files = ws.cut(with_texts(todo, root, volume or 0), "bodies")
            n_read = files.count()
            chunks = ws.cut(incremental.stable_chunks(files, max_chunk_size), "chunks")
            postings = ws.cut(lexical.term_counts(chunks), "postings")
            n_chunks, length = chunks.count(), postings.groupBy("chunk_ord").agg(F.max("dl").alias("dl")).agg(F.sum("dl")).first()[0] or 0
            df = lexical.document_frequencies(postings)
            vectors = dense.embed(chunks, self.encoder, "chunk_ord", "text").withColumn("file_no", F.shiftright("chunk_ord", lexical.FILE_SHIFT)) if semantic else None
            manifest = files.select("file_path", "kind", "mtime", "size", "file_no", F.lit(folder).alias("segment"))
            dead, segments = spark.createDataFrame([], DEAD), []

            if kept:
                gone = ws.cut(before.join(diff.where("status <> 'unchanged'").select("file_path"), "file_path", "left_semi"), "gone")
                stay = before.join(diff.where("status = 'unchanged'").select("file_path"), "file_path", "left_semi")
                took = ws.cut(chunking.chunk_files(self.texts_of(gone), max_chunk_size), "taken-chunks")
                lost = took.select(F.size(F.concat(lexical.tokenize(F.col("text")), lexical.tokenize(F.col("file_path")))).alias("dl"))
                m_chunks, m_length = lost.agg(F.count(F.lit(1)), F.sum("dl")).first()
                df = incremental.signed_frequencies(df, lexical.chunk_frequencies(took))
                n_chunks, length = n_chunks + old["n_chunks"] - m_chunks, length + old["length"] - (m_length or 0)
                manifest = manifest.unionByName(stay)
                dead = ws.cut(self.dead().unionByName(gone.select("segment", "file_no")), "dead")
                segments = old["segments"]
            manifest = ws.cut(manifest, "manifest")
            n_files = manifest.count()
            if segments and (dead.count() > MOST_DEAD * n_files or len(segments) >= MOST_SEGMENTS):
                # what lives in the old segments joins the new one
                mine = gone.select("file_no")
                alive = lambda name, schema: self._live(name, schema).join(mine, "file_no", "left_anti")
                files = files.select("file_path", "file_no", "kind", "text").unionByName(alive("files", FILES).drop("part"))
                chunks = chunks.drop("text").unionByName(alive("chunks", CHUNKS))
                number = F.shiftright("chunk_ord", lexical.FILE_SHIFT).alias("file_no")
                living = self.lexical_index().postings.select("*", number).join(mine, "file_no", "left_anti").drop("file_no")
                postings = ws.cut(postings.unionByName(living), "all-postings")
                df = lexical.document_frequencies(postings)
                if vectors is not None:
                    vectors = vectors.unionByName(alive("vectors", "chunk_ord long, embedding array<float>, file_no long"))
                manifest = manifest.withColumn("segment", F.lit(folder))
                dead, segments, n_read = dead.limit(0), [], n_files
            parts = lexical.save_parts(postings, df, stage)
            chunks.select([c.split()[0] for c in CHUNKS.split(", ")]).write.parquet(f"{stage}/chunks")
            file_parts = self._write_texts(files, n_read, f"{stage}/files")
            if vectors is not None:
                vectors.write.parquet(f"{stage}/vectors")
            manifest.write.parquet(f"{stage}/manifest")
            dead.write.parquet(f"{stage}/dead")
            segments = [(s["folder"], s["parts"], s["file_parts"]) for s in segments] + [(folder, parts, file_parts)]
            made = (max_chunk_size, TOKENIZER, n_files, n_chunks, length, max(first, -1 if top is None else top) + 1, semantic, segments)
            spark.createDataFrame([made], SETTINGS).coalesce(1).write.parquet(f"{stage}/settings")
            reprocessed = diff.where("status = 'changed'").count()
            self._versions.publish(stage, base)
        except BaseException:
            delete_path(spark, stage)
            raise
        finally:
            ws.close()
        self.close()
        n, terms = self.lexical_index().summary()
        return {"chunks": n, "terms": terms, "reprocessed": reprocessed, "version": base + 1}

    def vacuum(self) -> list[str]:
        """Removes the data that the current version doesn't need; to be called when no other run or reader is at work."""
        needed = {self._versions.folder(self.version()).rpartition("/")[2], *(s["folder"] for s in self.settings()["segments"])}
        gone = [n for n in list_names(self.spark, self.path) if n.startswith("data-") and n not in needed]
        for name in [*(f"v{v}" for v in self._versions.numbers()[:-1]), *gone]:
            delete_path(self.spark, f"{self.path}/{name}")
        return gone

    # loading

    def chunks(self) -> DataFrame:
        return self._get("chunks", lambda v: self._live("chunks", CHUNKS))

    def files(self) -> DataFrame:
        """``(file_path, text)`` of all live files."""
        return self._live("files", FILES).select("file_path", "text")

    def vectors(self) -> DataFrame:
        if not (self.settings() or {"semantic": True})["semantic"]:
            raise FileNotFoundError(f"no vectors in {self.path}: index with build_embeddings")
        return self._get("vectors", lambda v: self._live("vectors", "chunk_ord long, embedding array<float>, file_no long").select("chunk_ord", "embedding"))

    def lexical_index(self) -> lexical.LexicalIndex:
        def load(version: int) -> lexical.LexicalIndex:
            made = self.settings()
            segments = [lexical.load_segment(self.spark, f"{self.path}/{s['folder']}", s["parts"], self._dead_of(s["folder"])) for s in made["segments"]]
            n = made["n_chunks"]
            return lexical.from_segments(segments, n, made["length"] / n if n else 0.0)

        return self._get("index", load)

    # searching

    def rank(self, questions: DataFrame, k: int, use_semantic: bool = False) -> DataFrame:
        """``(question_id, chunk_ord, score, rank)`` for ``(question_id, question)``."""
        if k <= 0:
            questions = questions.limit(0)
        by_words = lexical.search(questions, self.lexical_index(), fusion.pool_size(k) if use_semantic else k)
        if not use_semantic:
            return by_words
        asked = dense.embed_questions(questions, self.encoder)
        by_vector = dense.cosine_top(asked, self.vectors(), fusion.pool_size(k))
        return fusion.hybrid(by_words, by_vector, k)

    def search(self, query: str, k: int = 10, use_semantic: bool = False) -> list[Source]:
        """Best sources of one query; nothing for blank queries and k below 1."""
        if k <= 0 or not query or not query.strip():
            return []
        key = query, k, use_semantic, self.version()
        found = self.cache.get(*key)
        if found is None:
            ranked = {r.chunk_ord: r.rank for r in self._rank_one(query, k, use_semantic)}
            rows = self.chunks().where(F.col("chunk_ord").isin(list(ranked))).collect() if ranked else []  # k rows at most
            rows.sort(key=lambda r: ranked[r.chunk_ord])
            found = [Source(r.file_path, r.first_character_index, r.last_character_index) for r in rows]
            self.cache.put(found, *key)
        return found

    def _rank_one(self, query: str, k: int, use_semantic: bool) -> list:
        one = self.spark.sql("SELECT '0' AS question_id, :q AS question", {"q": query})
        if use_semantic:
            return self.rank(one, k, True).collect()
        terms = one.select(F.array_distinct(lexical.tokenize(F.col("question")))).first()[0]
        return lexical.top_of(terms, self.lexical_index(), k).collect() if terms else []

    def search_dataset(self, dataset_path: str, k: int, save_directory: str, use_semantic: bool = False) -> str:
        questions = jsonio.read_questions(self.spark, dataset_path)
        found = lexical.grouped(questions, self.rank(questions, k, use_semantic), self.chunks(), order="q_ord")
        return jsonio.write_results(found, k, save_directory, dataset_path.rstrip("/").rpartition("/")[2])

    # answering and evaluation

    def _one(self, query: str, sources: list[Source]) -> DataFrame:
        kind = f"question_id string, question string, retrieved_sources array<{jsonio.SOURCE}>"
        rows = [(s.file_path, s.first_character_index, s.last_character_index) for s in sources]
        return self.spark.createDataFrame([(uuid.uuid4().hex, query, rows)], kind)

    def _cited(self, results: DataFrame) -> DataFrame:
        """Texts of the files that results cite."""
        return self.texts_of(results.select(F.explode("retrieved_sources").alias("s")).select("s.file_path")).select("file_path", "text")

    def prompt(self, query: str, sources: list[Source]) -> str:
        one = self._one(query, sources)
        return prompts.prompts(one, self._cited(one)).first()["prompt"]

    def answer(self, query: str, k: int = 10) -> tuple[str, list[Source]]:
        sources = self.search(query, k)
        one = self._one(query, sources)
        return answering.answer_results(one, self._cited(one), self.generator).first()["answer"], sources

    def answer_dataset(self, results_path: str, save_directory: str) -> str:
        results, k = jsonio.read_results(self.spark, results_path)
        order = results.select("question_id", "q_ord").dropDuplicates(["question_id"])
        made = answering.answer_results(results.dropDuplicates(["question_id"]), self._cited(results), self.generator)
        return jsonio.write_answers(made.join(order, "question_id"), k, save_directory, results_path.rstrip("/").rpartition("/")[2])

    def evaluate(self, results_path: str, dataset_path: str) -> dict[int, float]:
        results, _ = jsonio.read_results(self.spark, results_path)
        truth = jsonio.read_questions(self.spark, dataset_path)
        return {r.k: r.recall for r in evaluation.mean_recall(truth, results).collect()}
