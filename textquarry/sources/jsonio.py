"""Question sets, search results and answers as single JSON documents."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE = "struct<file_path:string,first_character_index:bigint,last_character_index:bigint>"
SOURCE_TYPE = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("first_character_index", T.LongType()),
        T.StructField("last_character_index", T.LongType()),
    ]
)
_TEXT = T.StringType()


def _list(*fields: tuple[str, T.DataType]) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields]))


_SOURCES = T.ArrayType(SOURCE_TYPE)
QUESTIONS = T.StructType(
    [T.StructField("rag_questions", _list(("question_id", _TEXT), ("question", _TEXT), ("sources", _SOURCES), ("answer", _TEXT)))]
)
_RESULT = [("question_id", _TEXT), ("question", _TEXT), ("retrieved_sources", _SOURCES)]
RESULTS = T.StructType([T.StructField("search_results", _list(*_RESULT)), T.StructField("k", T.LongType())])
ANSWERS = T.StructType([T.StructField("search_results", _list(*_RESULT, ("answer", _TEXT))), T.StructField("k", T.LongType())])


def _document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        raise FileNotFoundError(path)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def _checked(rows: DataFrame, required: list[str], path: str) -> DataFrame:
    """Reads the document once, so that a broken one is told of here and not in the middle of a job."""
    try:
        bad = rows.where(" or ".join(f"`{c}` is null" for c in required)).limit(1).count()
    except Exception as e:
        raise ValueError(f"{path} is not valid: {e}") from e
    if bad:
        raise ValueError(f"{path} is not valid: {', '.join(required)} must be given in every element")
    return rows


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """``(q_ord, question_id, question, sources, answer)``; a missing id is made up. ``ValueError`` if the document is malformed."""
    doc = _checked(_document(spark, path, QUESTIONS), ["rag_questions"], path)
    rows = doc.select(F.posexplode("rag_questions").alias("q_ord", "q")).select("q_ord", "q.*")
    # made from content, not drawn, so that it is the same whenever the row is computed
    made = F.sha2(F.concat_ws("\0", F.col("q_ord"), "question"), 256)
    rows = rows.withColumn("question_id", F.coalesce("question_id", made))
    return _checked(rows, ["question"], path)


def _read_results(spark: SparkSession, path: str, schema: T.StructType, required: list[str]) -> tuple[DataFrame, int]:
    doc = _checked(_document(spark, path, schema), ["search_results", "k"], path)
    k = doc.select("k").first()[0]
    rows = doc.select(F.posexplode("search_results").alias("q_ord", "r")).select("q_ord", "r.*")
    return _checked(rows, required, path), k


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """``(q_ord, question_id, question, retrieved_sources)`` and the document's k."""
    return _read_results(spark, path, RESULTS, ["question_id", "question", "retrieved_sources"])


def read_answers(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The same with ``answer``."""
    return _read_results(spark, path, ANSWERS, ["question_id", "question", "retrieved_sources", "answer"])


def _write(rows: DataFrame, k: int | None, target: str, columns: list[str], name: str = "search_results") -> str:
    """One JSON document, on whatever file system ``target`` lies.

    Rows pass through the driver one partition at a time; the result set of a
    question file is small. What was there before is replaced when all is written.
    """
    jvm, conf = rows.sparkSession._jvm, rows.sparkSession._jsc.hadoopConfiguration()
    path, part = (jvm.org.apache.hadoop.fs.Path(x) for x in (target, f"{target}.{uuid.uuid4().hex[:8]}"))
    fs = path.getFileSystem(conf)
    fs.setWriteChecksum(False)
    ordered = rows.orderBy("q_ord") if "q_ord" in rows.columns else rows
    out = fs.create(part, True)
    try:
        out.write(bytearray(f'{{"{name}": ['.encode()))
        for n, row in enumerate(ordered.select(*columns).toLocalIterator()):
            text = (",\n" if n else "\n") + json.dumps(row.asDict(recursive=True), ensure_ascii=False)
            out.write(bytearray(text.encode("utf-8", "surrogatepass")))
        out.write(bytearray((f'\n], "k": {int(k)}}}\n' if k is not None else "\n]}\n").encode()))
    except BaseException:
        out.close()
        fs.delete(part, False)
        raise
    out.close()
    fs.delete(path, False)
    if not fs.rename(part, path):
        raise OSError(f"{target} could not be written")
    return target


def write_questions(rows: DataFrame, target: str) -> str:
    """``target``: ``{rag_questions}`` of ``(question_id, question, sources, answer)``."""
    return _write(rows, None, target, ["question_id", "question", "sources", "answer"], "rag_questions")


def write_results(rows: DataFrame, k: int, directory: str, name: str) -> str:
    """``directory/name``: ``{search_results, k}``, in order of ``q_ord``."""
    return _write(rows, k, f"{directory.rstrip('/')}/{name}", ["question_id", "question", "retrieved_sources"])


def write_answers(rows: DataFrame, k: int, directory: str, name: str) -> str:
    return _write(rows, k, f"{directory.rstrip('/')}/{name}", ["question_id", "question", "retrieved_sources", "answer"])
