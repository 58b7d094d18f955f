"""Queries of this subpackage's operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dense
from ..plans.workspace import scoped
from . import leaks, neighbours, packing, pairs, shared_spans, split, terms


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@scoped
def p1_found(spark: SparkSession, sf: str, ws) -> DataFrame:
    bags = terms.latest_bags(table(spark, sf, "chunk_terms"))
    return terms.distinctive_terms(bags, ws, 3, "weight", 2).select("chunk_ord", "term")


@scoped
def p1_residuals(spark: SparkSession, sf: str, ws) -> DataFrame:
    bags = terms.latest_bags(table(spark, sf, "chunk_terms"))
    return terms.distinctive_terms(bags, ws, 3, "residual", 2).select("chunk_ord", "term", "tf", "df", "residual")


@scoped
def p2_found(spark: SparkSession, sf: str, ws) -> DataFrame:
    return neighbours.similar_pairs(table(spark, sf, "chunk_vectors"), ws)


@scoped
def p2_recall(spark: SparkSession, sf: str, ws) -> DataFrame:
    """Share of the true pairs that ``p2_found`` has, by brute force for the chunks whose number is divisible by 20."""
    found = neighbours.similar_pairs(table(spark, sf, "chunk_vectors"), ws)
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = table(spark, sf, "chunk_vectors").where((F.size("embedding") == neighbours.DIM) & good).groupBy("chunk_ord").agg(F.min("embedding").alias("embedding"))
    asked = rows.where("chunk_ord % 20 = 0").select(F.col("chunk_ord").alias("question_id"), "embedding")
    truth = dense.cosine_top(asked, rows, neighbours.K, exclude_self=True).where(F.col("score") >= neighbours.THRESHOLD)
    a, b = F.least("question_id", "chunk_ord").alias("chunk_ord_a"), F.greatest("question_id", "chunk_ord").alias("chunk_ord_b")
    truth = truth.select(a, b).distinct().join(found.withColumn("hit", F.lit(1)), ["chunk_ord_a", "chunk_ord_b"], "left")
    return truth.agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found"), F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("recall"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, sf, "answers"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_oversized(table(spark, sf, "chunks"))


@scoped
def p6_found(spark: SparkSession, sf: str, ws) -> DataFrame:
    state = terms.counts_by_builds(table(spark, sf, "chunk_terms"), ws)
    marked = terms.marked_terms(state.read(), state.records())
    return marked.where(F.col("mark").isNotNull()).select("term", "mark")


@scoped
def p6_counts(spark: SparkSession, sf: str, ws) -> DataFrame:
    state = terms.counts_by_builds(table(spark, sf, "chunk_terms"), ws)
    return terms.marked_terms(state.read(), state.records())


@scoped
def p7_pack(spark: SparkSession, sf: str, ws) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), ws)


@scoped
def p7_check(spark: SparkSession, sf: str, ws) -> DataFrame:
    """That every text is packed once and whole, no container is over capacity, and at most one in a thousand tokens' room is left."""
    documents = table(spark, sf, "documents")
    return packing.packed_check(ws.cut(packing.pack(documents, ws), "packed"), documents)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


@scoped
def p9_found(spark: SparkSession, sf: str, ws) -> DataFrame:
    return shared_spans.shared_spans(table(spark, sf, "documents"), ws)


_BAGS = """
WITH latest AS (SELECT DISTINCT chunk_ord, shard_no, build_no, term_frequencies AS m FROM (
  SELECT *, rank() OVER (PARTITION BY chunk_ord ORDER BY build_no DESC NULLS LAST) AS r FROM chunk_terms) WHERE r = 1),
kv AS (SELECT chunk_ord, unnest(map_keys(m)) AS k, unnest(map_values(m)) AS v FROM latest),
bags AS (SELECT chunk_ord, lower(trim(k)) AS term, CAST(sum(v) AS BIGINT) AS tf FROM kv
  WHERE v >= 1 AND trim(k) <> '' GROUP BY ALL),
n AS (SELECT count(DISTINCT chunk_ord) AS n FROM bags),
cols AS (SELECT term, count(*) AS df, sum(tf) AS col_sum FROM bags GROUP BY term),
"""

P1_FOUND_SQL = _BAGS + """
w AS (SELECT chunk_ord, term, round(tf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1), 6) AS w
  FROM bags JOIN cols USING (term), n WHERE df >= 2)
SELECT chunk_ord, term FROM (SELECT *, row_number() OVER (PARTITION BY chunk_ord ORDER BY w DESC, term) AS r FROM w)
WHERE r <= 3
"""

P1_RESIDUALS_SQL = _BAGS + """
total AS (SELECT CAST(sum(tf) AS DOUBLE) AS t FROM bags),
rows AS (SELECT chunk_ord, sum(tf) AS row_sum FROM bags GROUP BY 1),
w AS (SELECT chunk_ord, term, tf, df, row_sum * col_sum / t AS e, 1 - row_sum / t AS r1, 1 - col_sum / t AS c1
  FROM bags JOIN cols USING (term) JOIN rows USING (chunk_ord), total WHERE df >= 2),
s AS (SELECT *, round((tf - e) / sqrt(e * r1 * c1), 6) AS residual FROM w)
SELECT chunk_ord, term, tf, df, residual
FROM (SELECT *, row_number() OVER (PARTITION BY chunk_ord ORDER BY residual DESC, term) AS k FROM s) WHERE k <= 3
"""

P6_FOUND_SQL = _BAGS + """
m AS (SELECT term, CASE WHEN df <= 2 THEN 'rare' WHEN df > 0.4 * n THEN 'common' END AS mark FROM cols, n)
SELECT term, mark FROM m WHERE mark IS NOT NULL
"""

P6_COUNTS_SQL = _BAGS.rstrip().rstrip(",") + """
SELECT term, CAST(col_sum AS BIGINT) AS tf, df,
  CASE WHEN df <= 2 THEN 'rare' WHEN df > 0.4 * n THEN 'common' END AS mark FROM cols, n
"""

P5_FOUND_SQL = """
WITH RECURSIVE big AS (SELECT DISTINCT chunk_ord, first_character_index AS f, text AS t, length(text) AS n
  FROM chunks WHERE length(text) > 2000 AND first_character_index IS NOT NULL),
win AS (SELECT chunk_ord, f, t, n, 0::BIGINT AS s FROM big),
cut AS (
  SELECT chunk_ord, f, t, n, 0::BIGINT AS s, NULL::BIGINT AS e FROM big
  UNION ALL
  SELECT chunk_ord, f, t, n, x.e - 150, x.e FROM (
    SELECT chunk_ord, f, t, n, s, CASE
        WHEN p2 > 0 THEN s + 1000 + p2 WHEN p1 > 0 THEN s + 1000 + p1 WHEN p0 > 0 THEN s + 1000 + p0 ELSE s + 2000 END AS e
    FROM (SELECT *,
        CASE WHEN strpos(substr(r, 1, 1001), chr(10) || chr(10)) > 0 THEN 1001 - strpos(r, chr(10) || chr(10)) ELSE 0 END AS p2,
        CASE WHEN strpos(substr(r, 1, 1000), chr(10)) > 0 THEN 1001 - strpos(r, chr(10)) ELSE 0 END AS p1,
        CASE WHEN strpos(substr(r, 1, 1000), ' ') > 0 THEN 1001 - strpos(r, ' ') ELSE 0 END AS p0
      FROM (SELECT *, reverse(substr(t, s + 1000, 1001)) AS r FROM cut WHERE n - s > 2000) q0) q1) x
)
SELECT DISTINCT chunk_ord, f + s AS first_character_index,
  f + CASE WHEN n - s <= 2000 THEN n ELSE nxt END AS last_character_index
FROM (SELECT *, lead(e) OVER (PARTITION BY chunk_ord, f, t ORDER BY s) AS nxt FROM cut)
"""

P2_FOUND_SQL = """
WITH v AS (SELECT DISTINCT chunk_ord, embedding::DOUBLE[] AS e FROM chunk_vectors WHERE len(embedding) = 128 AND chunk_ord IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 128 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.chunk_ord AS a, b.chunk_ord AS b, round(list_cosine_similarity(a.e, b.e), 6) AS sim FROM v a JOIN v b ON a.chunk_ord <> b.chunk_ord),
t AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM s WHERE sim >= 0.75)
SELECT DISTINCT least(a, b) AS chunk_ord_a, greatest(a, b) AS chunk_ord_b FROM t WHERE r <= 5
"""

# what brute force finds for the chunks asked for; that nothing is missed holds for small tables, where all cells are looked into
P2_RECALL_SQL = P2_FOUND_SQL.rsplit("SELECT", 1)[0].replace("FROM v a JOIN v b ON a.chunk_ord <> b.chunk_ord", "FROM v a JOIN v b ON a.chunk_ord <> b.chunk_ord WHERE a.chunk_ord % 20 = 0") + """,
p AS (SELECT DISTINCT least(a, b) AS x, greatest(a, b) AS y FROM t WHERE r <= 5)
SELECT count(*) AS n_true, count(*) AS n_found, 1.0::DOUBLE AS recall FROM p
"""

_RUNS = "list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))"
P8_FOUND_SQL = f"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM eval_items),
g AS (SELECT DISTINCT item_id, unnest({_RUNS}) AS run FROM i WHERE len(w) >= 20),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
r AS (SELECT doc_id, unnest({_RUNS}) AS run FROM d WHERE len(w) >= 20)
SELECT DISTINCT doc_id, item_id FROM r JOIN g USING (run)
"""

P9_FOUND_SQL = """
WITH w AS (SELECT doc_id, p, md5_number(substr(text, p + 1, 400)) AS h
  FROM (SELECT doc_id, text, unnest(range(0, length(text) - 399)) AS p FROM documents WHERE length(text) >= 400)),
k AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
m AS (SELECT doc_id, p FROM w JOIN k USING (h)),
n AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER o <= 400 THEN 0 ELSE 1 END AS first FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
g AS (SELECT doc_id, p, sum(first) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM n)
SELECT doc_id, min(p) AS span_start, max(p) + 400 AS span_end FROM g GROUP BY doc_id, run
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_residuals": p1_residuals,
    "p2_found": p2_found,
    "p2_recall": p2_recall,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_counts": p6_counts,
    "p7_pack": p7_pack,
    "p7_check": p7_check,
    "p8_found": p8_found,
    "p9_found": p9_found,
}
SQL = {
    "p1_found": P1_FOUND_SQL,
    "p1_residuals": P1_RESIDUALS_SQL,
    "p2_found": P2_FOUND_SQL,
    "p2_recall": P2_RECALL_SQL,
    "p5_found": P5_FOUND_SQL,
    "p6_found": P6_FOUND_SQL,
    "p6_counts": P6_COUNTS_SQL,
    "p7_check": "SELECT count(*) AS n_texts, 0::BIGINT AS n_missing, 0::BIGINT AS n_over, true AS well_filled FROM documents",
    "p8_found": P8_FOUND_SQL,
    "p9_found": P9_FOUND_SQL,
}
