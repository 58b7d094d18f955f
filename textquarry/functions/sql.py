"""The column functions as SQL functions, and the tables of a folder as views."""

from __future__ import annotations

from pyspark.sql import SparkSession

_PARTS = "filter(split(regexp_replace(r, '(?<=[a-z0-9])(?=[A-Z])', '_'), '_'), p -> p <> '')"
_SOURCE = "STRUCT<file_path: STRING, first_character_index: BIGINT, last_character_index: BIGINT>"

# Name, arguments, result and body; bodies are expressions, so Catalyst puts them into the plan like any other.
FUNCTIONS = (
    (
        "code_tokens", "text STRING", "ARRAY<STRING>",
        f"flatten(transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+', 0), r -> concat(array(lower(r)),"
        f" CASE WHEN size({_PARTS}) > 1 THEN transform({_PARTS}, p -> lower(p)) ELSE CAST(array() AS ARRAY<STRING>) END)))",
    ),
    ("bm25_idf", "n BIGINT, df BIGINT", "DOUBLE", "ln((n - df + 0.5D) / (df + 0.5D) + 1.0D)"),
    (
        "bm25_part", "n BIGINT, df BIGINT, tf BIGINT, dl BIGINT, avgdl DOUBLE, k1 DOUBLE, b DOUBLE", "DOUBLE",
        "ln((n - df + 0.5D) / (df + 0.5D) + 1.0D) * tf * (k1 + 1.0D) / (tf + k1 * (1.0D - b + b * dl / avgdl))",
    ),
    (
        "span_iou", f"a {_SOURCE}, b {_SOURCE}", "DOUBLE",
        "CASE WHEN a.file_path = b.file_path AND least(a.last_character_index, b.last_character_index) > greatest(a.first_character_index, b.first_character_index)"
        " THEN (least(a.last_character_index, b.last_character_index) - greatest(a.first_character_index, b.first_character_index))"
        " / (greatest(a.last_character_index, b.last_character_index) - least(a.first_character_index, b.first_character_index)) ELSE 0.0D END",
    ),
    ("dot_product", "a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0.0D, (s, x) -> s + x)"),
    ("text_slice", "text STRING, first BIGINT, last BIGINT", "STRING", "substring(text, CAST(greatest(first, 0) + 1 AS INT), CAST(greatest(last - greatest(first, 0), 0) AS INT))"),
)


def register_functions(spark: SparkSession) -> list[str]:
    """Temporary SQL functions of this session; returns their names."""
    for name, args, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    return [f[0] for f in FUNCTIONS]


def register_tables(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Each ``folder/name.parquet`` as a view ``name``."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
