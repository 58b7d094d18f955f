"""The same queries in SQL (as DuckDB reads it)."""

from __future__ import annotations

P3_FOUND = """
WITH runs AS (SELECT run_id, row_number() OVER (ORDER BY started_at NULLS FIRST, run_id) AS seq
  FROM (SELECT DISTINCT run_id, started_at FROM index_runs WHERE status = 'succeeded')),
state AS (SELECT seq, run_id, file_path, mtime, size FROM (
  SELECT r.seq, s.*, row_number() OVER (PARTITION BY s.run_id, s.file_path
    ORDER BY s.seen_at DESC, s.loaded_at DESC, s.scan_id DESC) AS rn
  FROM file_scans s JOIN runs r USING (run_id) WHERE s.mtime IS NOT NULL AND s.size IS NOT NULL) WHERE rn = 1)
"""
P3_SQL = P3_FOUND + """
SELECT n.run_id, n.file_path FROM state n LEFT JOIN state o ON o.file_path = n.file_path AND o.seq = n.seq - 1
WHERE o.file_path IS NULL OR o.mtime <> n.mtime OR o.size <> n.size
"""

P3_STORE = P3_FOUND.rstrip() + """, m AS (SELECT max(seq) AS m FROM runs)
SELECT n.file_path, n.mtime, n.size FROM m JOIN state n ON n.seq = m LEFT JOIN state o ON o.file_path = n.file_path AND o.seq = n.seq - 1
WHERE o.file_path IS NULL OR o.mtime <> n.mtime OR o.size <> n.size
"""

# tokens of x: each run, then its parts if it has more than one
_PARTS = "list_filter(string_split(regexp_replace(r, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '_'), lambda p: p <> '')"


def _tokens(x: str) -> str:
    return f"""flatten(list_transform(regexp_extract_all({x}, '[A-Za-z0-9_]+'), lambda r: list_concat([lower(r)],
      CASE WHEN len({_PARTS}) > 1 THEN list_transform({_PARTS}, lambda p: lower(p)) ELSE [] END)))"""


_CHUNKS = "WITH c AS (SELECT DISTINCT chunk_ord, file_path, first_character_index, last_character_index, text FROM chunks),\n"
_TF = _CHUNKS + f"""tf AS (SELECT chunk_ord, term, count(*) AS tf FROM (
  SELECT chunk_ord, unnest(list_concat({_tokens("text")}, {_tokens("file_path")})) AS term FROM c WHERE text IS NOT NULL) GROUP BY ALL),
dl AS (SELECT chunk_ord, CAST(sum(tf) AS BIGINT) AS dl FROM tf GROUP BY 1),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
st AS (SELECT (SELECT count(DISTINCT chunk_ord) FROM c) AS n, (SELECT sum(dl) FROM dl)::DOUBLE / (SELECT count(DISTINCT chunk_ord) FROM c) AS avgdl),
"""


def _search(questions: str, k: int, k1: float = 1.2, b: float = 0.5, tf: str = _TF) -> str:
    """CTEs up to ``ranked (question_id, chunk_ord, score, rank)`` for a query that gives question_id and question."""
    return tf + f"""q AS ({questions}),
qt AS (SELECT DISTINCT question_id, unnest({_tokens("question")}) AS term FROM q WHERE question IS NOT NULL),
sc AS (SELECT question_id, chunk_ord, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * ({k1} + 1)::DOUBLE
    / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * dl / avgdl))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (chunk_ord), st GROUP BY ALL),
ranked AS (SELECT * FROM (SELECT question_id, chunk_ord, score,
  row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_ord) AS rank FROM sc WHERE score > 0) WHERE rank <= {k})
"""


_ITEMS = "SELECT item_id AS question_id, text AS question FROM eval_items"

_FIRST_ASKED = """asked AS (SELECT question_id, question, answer, retrieved_sources FROM (SELECT *, row_number() OVER (PARTITION BY question_id
  ORDER BY coalesce(answered_at, TIMESTAMP '1970-01-01'), question NULLS FIRST, answer NULLS FIRST) AS rn FROM answers WHERE question_id IS NOT NULL) WHERE rn = 1)"""

# spans by folds: a list of lengths or spans is reduced to a list of spans
_S = "STRUCT(s BIGINT, e BIGINT)[]"
_LINES = "list_transform(list_filter(regexp_extract_all({t}, '[^\\n]*\\n|[^\\n]+'), lambda x: x <> ''), lambda x: length(x))"


def _hard(p: str, n: str, size: int) -> str:
    return f"list_transform(range({p}, {p} + {n}, {size}), lambda k: {{'s': k, 'e': least(k + {size}, {p} + {n})}})"


def _pack_lines(t: str, base: str, size: int) -> str:
    """Fold over line lengths; state {o, cs, ce, p, n}, where only n is set in the items."""
    items = f"list_transform({_LINES.format(t=t)}, lambda n: {{'o': []::{_S}, 'cs': 0::BIGINT, 'ce': 0::BIGINT, 'p': 0::BIGINT, 'n': n::BIGINT}})"
    start = f"{{'o': []::{_S}, 'cs': ({base})::BIGINT, 'ce': ({base})::BIGINT, 'p': ({base})::BIGINT, 'n': 0::BIGINT}}"
    held = "CASE WHEN a.ce > a.cs THEN [{'s': a.cs, 'e': a.ce}] ELSE [] END"
    fold = f"""list_reduce({items}, lambda a, x: CASE
      WHEN x.n > {size} THEN {{'o': list_concat(a.o, {held}, {_hard("a.p", "x.n", size)}), 'cs': a.p + x.n, 'ce': a.p + x.n, 'p': a.p + x.n, 'n': 0::BIGINT}}
      WHEN a.ce - a.cs + x.n > {size} THEN {{'o': list_concat(a.o, {held}), 'cs': a.p, 'ce': a.p + x.n, 'p': a.p + x.n, 'n': 0::BIGINT}}
      ELSE {{'o': a.o, 'cs': a.cs, 'ce': a.p + x.n, 'p': a.p + x.n, 'n': 0::BIGINT}} END, {start})"""
    return fold


_PARAGRAPHS = f"""pieces AS (SELECT doc_id, text, unnest(list_transform(range(1, len(p) + 1), lambda i: {{'i': i, 'x': p[i]}})) AS u
  FROM (SELECT doc_id, text, regexp_extract_all(text, '\\n\\n+|(?:[^\\n]|\\n[^\\n]|\\n$)+') AS p FROM docs WHERE text IS NOT NULL)),
placed AS (SELECT doc_id, u.i AS i, u.x AS x, coalesce(sum(length(u.x)) OVER (PARTITION BY doc_id ORDER BY u.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM pieces),
para AS (SELECT doc_id, s::BIGINT AS s, (s + length(x))::BIGINT AS e, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n
  FROM placed WHERE regexp_matches(x, '[^\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]'))"""

_DOCS = "WITH docs AS (SELECT doc_id, text FROM documents),\n"

HARD_SPLIT = """
SELECT doc_id, CAST(k / 2000 AS BIGINT) AS n, k AS s, least(k + 2000, length(text)) AS e
FROM (SELECT doc_id, text, unnest(range(0, length(text), 2000)) AS k FROM documents)
"""

LINE_PACK = f"""
WITH f AS (SELECT doc_id, {_pack_lines("text", "0", 2000)} AS a FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, CASE WHEN a.ce > a.cs THEN list_concat(a.o, [{{'s': a.cs, 'e': a.ce}}]) ELSE a.o END AS o FROM f)
SELECT doc_id, i - 1 AS n, o[i].s AS s, o[i].e AS e FROM (SELECT doc_id, o, unnest(range(1, len(o) + 1)) AS i FROM g)
"""

PARAGRAPHS = _DOCS + _PARAGRAPHS + "\nSELECT doc_id, n, s, e FROM para"

MARKDOWN = _DOCS.replace("FROM documents", "FROM documents WHERE kind = 'markdown'") + _PARAGRAPHS + f""",
lists AS (SELECT doc_id, list({{'o': []::{_S}, 's': s, 'e': e}} ORDER BY n) AS l FROM para GROUP BY doc_id),
packed AS (SELECT doc_id, list_reduce(l, lambda a, x: CASE WHEN x.e - a.s <= 2000 THEN {{'o': a.o, 's': a.s, 'e': x.e}}
   ELSE {{'o': list_concat(a.o, [{{'s': a.s, 'e': a.e}}]), 's': x.s, 'e': x.e}} END) AS a FROM lists),
groups AS (SELECT doc_id, unnest(list_concat(a.o, [{{'s': a.s, 'e': a.e}}])) AS g FROM packed),
long AS (SELECT doc_id, g, {_pack_lines("substr(text, (g.s + 1)::BIGINT, (g.e - g.s)::BIGINT)", "g.s", 2000)} AS a FROM groups JOIN docs USING (doc_id) WHERE g.e - g.s > 2000),
every AS (SELECT doc_id, g.s AS s, g.e AS e FROM groups WHERE g.e - g.s <= 2000 UNION ALL
  SELECT doc_id, x.s, x.e FROM (SELECT doc_id, unnest(CASE WHEN a.ce > a.cs THEN list_concat(a.o, [{{'s': a.cs, 'e': a.ce}}]) ELSE a.o END) AS x FROM long))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS n, s, e FROM every
"""

CORPUS_FILTER = """
SELECT file_path, CASE WHEN suffix = '.py' THEN 'python' ELSE 'markdown' END AS kind
FROM (SELECT file_path, regexp_extract(file_path, '[^/](\\.[^./]+)$', 1) AS suffix FROM documents)
WHERE suffix IN ('.py', '.md', '.txt')
  AND NOT list_has_any(string_split(file_path, '/'), ['.git', '.github', '.buildkite', '__pycache__', 'csrc', 'cmake', 'docker', 'tests'])
"""

L2_NORMALISE = """
SELECT vec_id, i - 1 AS pos, round(embedding[i]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 6) AS x
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
"""

COSINE_TOPK = """
WITH q AS (SELECT vec_id AS question_id, embedding AS qe FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT question_id, vec_id, round(list_cosine_similarity(qe::DOUBLE[], embedding::DOUBLE[]), 6) AS score
  FROM q, embeddings WHERE question_id <> vec_id)
SELECT question_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""

_RANKINGS = _search(
    """SELECT chunk_ord AS question_id, min(file_path) AS question FROM c WHERE chunk_ord % 20 = 0 AND chunk_ord IN (SELECT chunk_ord FROM v) GROUP BY 1""", 30,
    tf=_TF.replace(_CHUNKS, _CHUNKS + """v AS (SELECT chunk_ord, min(embedding) AS e FROM chunk_vectors WHERE len(embedding) = 128
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 128 GROUP BY 1),
"""),
) + """,
cs AS (SELECT a.chunk_ord AS question_id, b.chunk_ord, round(list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]), 6) AS score FROM v a, v b WHERE a.chunk_ord % 20 = 0),
cr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_ord) AS rank FROM cs WHERE score > 0 AND NOT isnan(score)) WHERE rank <= 30),
"""  # fmt: skip


def _fused(w1: float, w2: float) -> str:
    return _RANKINGS + f"""
al AS (SELECT question_id, chunk_ord, 0 AS l, rank, {w1}::DOUBLE AS w FROM ranked UNION ALL SELECT question_id, chunk_ord, 1, rank, {w2}::DOUBLE FROM cr),
fu AS (SELECT question_id, chunk_ord, round(sum(w / (60 + rank)::DOUBLE), 6) AS score, min(l * 1000000 + rank) AS seen FROM al GROUP BY 1, 2)
SELECT question_id, chunk_ord, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, seen, chunk_ord) AS rank FROM fu) WHERE rank <= 10
"""


_EVAL = "WITH " + _FIRST_ASKED + """,
gt AS (SELECT question_id, u.i - 1 AS gt_no, u.x AS g FROM (SELECT question_id, unnest(list_transform(range(1, len(l) + 1), lambda i: {'i': i, 'x': l[i]})) AS u
  FROM (SELECT question_id, retrieved_sources AS l FROM asked WHERE retrieved_sources IS NOT NULL AND answer IS NOT NULL))),
rt AS (SELECT question_id, n - u.i + 1 AS rank, u.x AS h FROM (SELECT question_id, len(l) AS n, unnest(list_transform(range(1, len(l) + 1), lambda i: {'i': i, 'x': l[i]})) AS u
  FROM (SELECT question_id, retrieved_sources AS l FROM asked))),
io AS (SELECT question_id, gt_no, rank,
  (least(g.last_character_index, h.last_character_index + 500) - greatest(g.first_character_index, h.first_character_index + 300))::DOUBLE
  / (greatest(g.last_character_index, h.last_character_index + 500) - least(g.first_character_index, h.first_character_index + 300)) AS raw
  FROM {gt} JOIN rt USING (question_id) WHERE g.file_path = h.file_path)
"""

IOU_PAIRS = _EVAL.replace("{gt}", "(SELECT question_id, u.i - 1 AS gt_no, u.x AS g FROM (SELECT question_id, unnest(list_transform(range(1, len(l) + 1), lambda i: {'i': i, 'x': l[i]})) AS u FROM (SELECT question_id, retrieved_sources AS l FROM asked)))") + """
SELECT question_id, gt_no, rank, round(raw, 6) AS iou FROM io WHERE round(raw, 6) > 0
"""

_RECALL = _EVAL.replace("{gt}", "gt") + """,
ks AS (SELECT unnest([1, 3, 5, 10])::INTEGER AS k),
base AS (SELECT question_id, len(retrieved_sources) AS n FROM asked WHERE retrieved_sources IS NOT NULL AND answer IS NOT NULL),
hit AS (SELECT question_id, k, count(DISTINCT gt_no) AS hits FROM io, ks WHERE rank <= k AND raw >= 0.05::DOUBLE GROUP BY ALL),
rec AS (SELECT question_id, k, CASE WHEN n > 0 THEN round(coalesce(hits, 0)::DOUBLE / n, 6) END AS recall
  FROM (SELECT * FROM base, ks) LEFT JOIN hit USING (question_id, k))
"""
RECALL = _RECALL + "SELECT question_id, k, recall FROM rec"
MEAN_RECALL = _RECALL + "SELECT k, round(coalesce(avg(recall), 0), 6) AS recall FROM rec GROUP BY k"

_SLICES = "WITH " + _FIRST_ASKED + """,
src AS (SELECT question_id, u.i AS rank, u.x AS s FROM (SELECT question_id, unnest(list_transform(range(1, len(l) + 1), lambda i: {'i': i, 'x': l[i]})) AS u
  FROM (SELECT question_id, retrieved_sources AS l FROM asked))),
sl AS (SELECT question_id, rank, s.file_path AS file_path, coalesce(substr(text, greatest(s.first_character_index, 0) + 1,
  greatest(s.last_character_index - greatest(s.first_character_index, 0), 0)), '') AS slice
  FROM src LEFT JOIN documents ON documents.file_path = s.file_path)
"""
SLICES = _SLICES + "SELECT question_id, rank, file_path, slice FROM sl"
_BLOCKS = _SLICES + """,
bl AS (SELECT question_id, rank, '[Source: ' || file_path || ']' || chr(10) || slice AS block FROM sl WHERE slice <> ''),
nb AS (SELECT question_id, block, row_number() OVER w AS block_no, sum(length(block)) OVER w AS total FROM bl
  WINDOW w AS (PARTITION BY question_id ORDER BY rank ROWS UNBOUNDED PRECEDING)),
kept AS (SELECT question_id, block_no, block FROM nb WHERE total <= 3000 OR block_no = 1)
"""
BLOCKS = _BLOCKS + "SELECT question_id, block_no, block FROM kept"
_INSTRUCTION = (
    "Answer the question from the context below and from nothing else. If the context does not hold the answer, "
    "say that it does not. Be brief and keep to what was asked."
)
PROMPTS = _BLOCKS + f"""
SELECT question_id, '{_INSTRUCTION}' || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(c, '') || chr(10) || chr(10) || 'Question: '
  || coalesce(question, '') || chr(10) || 'Answer:' AS prompt
FROM asked LEFT JOIN (SELECT question_id, string_agg(block, chr(10) || chr(10) ORDER BY block_no) AS c FROM kept GROUP BY 1) USING (question_id)
"""

ANSWERS = _BLOCKS + """,
cx AS (SELECT question_id, string_agg(block, chr(10) || chr(10) ORDER BY block_no) AS c FROM kept GROUP BY 1)
SELECT question_id, coalesce(len(retrieved_sources), -1)::INTEGER AS n, CASE WHEN coalesce(len(retrieved_sources), 0) < 1
  THEN 'No relevant sources found -- cannot answer.'
  ELSE trim(substr(trim(regexp_replace(coalesce(substr(c, strpos(c, ']' || chr(10)) + 2), ''), '\\s+', ' ', 'g')), 1, 300)) END AS answer
FROM asked LEFT JOIN cx USING (question_id)
"""

_SNAPSHOTS = P3_FOUND + """, last AS (SELECT max(seq) AS m FROM runs),
old AS (SELECT file_path, mtime, size FROM state, last WHERE seq = m - 1), new AS (SELECT file_path, mtime, size FROM state, last WHERE seq = m)
"""
MANIFEST_DIFF = _SNAPSHOTS + """
SELECT coalesce(n.file_path, o.file_path) AS file_path, CASE WHEN n.file_path IS NULL THEN 'removed'
  WHEN o.file_path IS NULL OR o.mtime IS DISTINCT FROM n.mtime OR o.size IS DISTINCT FROM n.size THEN 'changed' ELSE 'unchanged' END AS status
FROM new n FULL JOIN old o ON o.file_path = n.file_path
"""

# document frequencies of the last snapshot's markdown files, built in full
_SNAPSHOT_MD = "docs AS (SELECT file_path AS doc_id, text FROM documents WHERE kind = 'markdown' AND file_path IN (SELECT file_path FROM new)),\n"
_MD_CHUNKS = MARKDOWN.split("SELECT doc_id, row_number()")[0].replace(_DOCS.replace("FROM documents", "FROM documents WHERE kind = 'markdown'"), "")
SNAPSHOT_DF = _SNAPSHOTS.rstrip() + ",\n" + _SNAPSHOT_MD + _MD_CHUNKS + f""",
mc AS (SELECT doc_id AS file_path, s, substr(text, s + 1, e - s) AS text FROM every JOIN docs USING (doc_id)),
tk AS (SELECT DISTINCT file_path, s, unnest(list_concat({_tokens("text")}, {_tokens("file_path")})) AS term FROM mc)
SELECT term, count(*) AS df FROM tk GROUP BY 1
"""

# retrieval by BM25 for the questions of answers, against what these cite
SEARCH_RECALL = _search("SELECT question_id, question FROM asked", 10, tf=_TF.replace("WITH c AS", "WITH " + _FIRST_ASKED + ",\nc AS", 1)).rstrip() + """,
pl AS (SELECT chunk_ord, min(file_path) AS f, min(first_character_index) AS s, min(last_character_index) AS e FROM c GROUP BY 1),
gt AS (SELECT question_id, u.i - 1 AS gt_no, u.x AS g FROM (SELECT question_id, unnest(list_transform(range(1, len(l) + 1), lambda i: {'i': i, 'x': l[i]})) AS u
  FROM (SELECT question_id, retrieved_sources AS l FROM asked WHERE retrieved_sources IS NOT NULL AND answer IS NOT NULL))),
io AS (SELECT question_id, gt_no, rank, (least(g.last_character_index, e) - greatest(g.first_character_index, s))::DOUBLE
  / (greatest(g.last_character_index, e) - least(g.first_character_index, s)) AS raw
  FROM gt JOIN ranked USING (question_id) JOIN pl USING (chunk_ord) WHERE g.file_path = f),
ks AS (SELECT unnest([1, 3, 5, 10])::INTEGER AS k),
base AS (SELECT question_id, len(retrieved_sources) AS n FROM asked WHERE retrieved_sources IS NOT NULL AND answer IS NOT NULL),
hit AS (SELECT question_id, k, count(DISTINCT gt_no) AS hits FROM io, ks WHERE rank <= k AND raw >= 0.05::DOUBLE GROUP BY ALL),
rec AS (SELECT question_id, k, CASE WHEN n > 0 THEN round(coalesce(hits, 0)::DOUBLE / n, 6) END AS recall
  FROM (SELECT * FROM base, ks) LEFT JOIN hit USING (question_id, k))
"""

_PLACES = "list_transform(retrieved_sources, lambda x: x.file_path || ':' || x.first_character_index || ':' || x.last_character_index)"
_ROUND = "WITH " + _FIRST_ASKED + f"""
SELECT question_id, question, array_to_string({_PLACES}, ' ') AS sources, 10::BIGINT AS k{{answer}} FROM asked
WHERE question IS NOT NULL AND retrieved_sources IS NOT NULL{{more}}
"""
_LINED = "replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
# spans of the fixed Python sources
PYTHON_GOLDEN = """
SELECT * FROM (VALUES ('comments', 0, 6, 20), ('comments, small', 0, 6, 10), ('comments, small', 1, 16, 20), ('class', 0, 9, 15), ('class', 1, 16, 40),
  ('one line', 0, 0, 8), ('one line, small', 0, 0, 7), ('one line, small', 1, 7, 8), ('one line, small', 2, 0, 7), ('one line, small', 3, 7, 8),
  ('decorator', 0, 0, 19), ('no syntax', 0, 0, 6), ('no syntax', 1, 6, 9)) AS t(file_path, chunk_in_file, first_character_index, last_character_index)
"""

SQL = {
    "p3_found": P3_SQL,
    "p3_store": P3_STORE,
    "tokenize_chunks": _CHUNKS + f"t AS (SELECT chunk_ord, {_tokens('text')} AS l FROM c WHERE text IS NOT NULL)\n"
    "SELECT chunk_ord, i - 1 AS pos, l[i] AS token FROM (SELECT chunk_ord, l, unnest(range(1, len(l) + 1)) AS i FROM t)",
    "hard_split_docs": HARD_SPLIT,
    "line_pack_docs": LINE_PACK,
    "paragraph_spans": PARAGRAPHS,
    "markdown_chunks": MARKDOWN,
    "corpus_filter": CORPUS_FILTER,
    "l2_normalise": L2_NORMALISE,
    "question_guard": "SELECT DISTINCT question_id, question FROM answers WHERE regexp_matches(question, '\\S')",
    "bm25_tf": _TF.rstrip().rstrip(",") + "\nSELECT chunk_ord, term, tf FROM tf",
    "bm25_df": _TF.rstrip().rstrip(",") + "\nSELECT term, df FROM df",
    "bm25_doc_len": _TF.rstrip().rstrip(",") + "\nSELECT chunk_ord, dl FROM dl",
    "bm25_stats": _TF.rstrip().rstrip(",") + "\nSELECT n AS n_chunks, (SELECT count(*) FROM df) AS n_terms, round(avgdl, 6) AS avg_chunk_length FROM st",
    "bm25_search_batch": _search(_ITEMS, 10) + "SELECT question_id, chunk_ord, score, rank FROM ranked",
    "bm25_no_path_tokens": _search(_ITEMS, 10, 1.5, 0.75, _TF.replace(f", {_tokens('file_path')}", ", []")) + "SELECT question_id, chunk_ord, score, rank FROM ranked",
    "search_results": _search(_ITEMS, 10) + """, pl AS (SELECT chunk_ord, min(file_path) AS f, min(first_character_index) AS s, min(last_character_index) AS e FROM c GROUP BY 1)
SELECT question_id, count(chunk_ord)::INTEGER AS n, coalesce(string_agg(f || ':' || s || ':' || e, ' ' ORDER BY rank), '') AS sources
FROM q LEFT JOIN (SELECT * FROM ranked JOIN pl USING (chunk_ord)) USING (question_id) GROUP BY question_id""",
    "cosine_topk": COSINE_TOPK,
    "hybrid_search": _fused(10, 1),
    "rrf_equal": _fused(1, 1),
    "iou_pairs": IOU_PAIRS,
    "recall_at_k": RECALL,
    "mean_recall": MEAN_RECALL,
    "prompt_blocks": BLOCKS,
    "prompt_text": PROMPTS,
    "source_slices": SLICES,
    "answer_dataset": ANSWERS,
    "manifest_diff": MANIFEST_DIFF,
    "incremental_df": SNAPSHOT_DF,
    "full_df": SNAPSHOT_DF,
    "incremental_check": "SELECT 0::BIGINT AS n_differing",
    "python_golden": PYTHON_GOLDEN,
    "python_chunk_check": "SELECT file_path, 0::BIGINT AS n_over, 0::BIGINT AS n_unordered, 0::BIGINT AS n_empty, 0::BIGINT AS n_other_text FROM documents WHERE kind = 'python'",
    "corpus_chunk_check": "SELECT true AS from_zero, 0::BIGINT AS n_gaps, true AS dense",
    "stored_search_batch": _search(_ITEMS, 10) + "SELECT question_id, chunk_ord, score, rank FROM ranked",
    "search_recall": SEARCH_RECALL + "SELECT question_id, k, recall FROM rec",
    "search_mean_recall": SEARCH_RECALL + "SELECT k, round(coalesce(avg(recall), 0), 6) AS recall FROM rec GROUP BY k",
    "questions_roundtrip": "WITH " + _FIRST_ASKED + " SELECT question_id, question, coalesce(len(retrieved_sources), -1)::INTEGER AS n, answer FROM asked WHERE question IS NOT NULL",
    "results_roundtrip": _ROUND.format(answer="", more=""),
    "answers_roundtrip": _ROUND.format(answer=", answer", more=" AND answer IS NOT NULL"),
    "engine_files": f"SELECT d.file_path, c.kind, strlen(coalesce(text, '')) AS n_bytes, length({_LINED}) AS n_chars FROM documents d JOIN ({CORPUS_FILTER}) c USING (file_path)",
    "engine_check": "SELECT 0::BIGINT AS n_without_vector, 0::BIGINT AS n_other_length, true AS all_counted, 0::BIGINT AS n_other_df",
}
