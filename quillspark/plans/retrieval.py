"""Queries over the chunks: dense, lexical and hybrid search, their signals and their evaluation.

Queries of the searches are the chunks one in fifty of whose ids' hashes falls to: a chunk's vector, and as text its symbol,
the symbol around it and its file's name. They are asked against all chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import vectors as V
from quillspark.functions.paths import file_name
from quillspark.operators import answers, dense, evaluation, fusion, incremental, lexical
from quillspark.session import table

EVERY = 50
FLOOR, WEAK = 0.45, 0.55
INFO = ["repo_id", "path", "symbol", "parent_symbol", "kind", "lang", "category", "start_line", "end_line"]


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    rows = table(spark, d, "code_chunks").filter("id is not null")
    return incremental.latest(rows.select("id", "indexed_at", *columns), ["id"], "indexed_at")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, "dense").filter("exists(dense, x -> x <> 0)").select("id", F.col("dense").alias("vector"))


def _one_in_fifty(column: str = "id") -> object:
    return F.conv(F.substring(F.md5(F.col(column)), 1, 8), 16, 10).cast("bigint") % EVERY == 0


def _asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).filter(_one_in_fifty()).withColumnRenamed("id", "query_id")


def _asked_texts(spark: SparkSession, d: str) -> DataFrame:
    words = F.concat_ws(" ", "symbol", "parent_symbol", file_name(F.col("path")))
    return _chunks(spark, d, "symbol", "parent_symbol", "path").filter(_one_in_fifty()).select(F.col("id").alias("query_id"), words.alias("text"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """All deliveries with their texts; the search keeps the latest of an id by its terms, so that texts aren't shuffled."""
    return table(spark, d, "code_chunks").filter("id is not null").select("id", F.col("indexed_text").alias("text"), "indexed_at")


def _dense(spark: SparkSession, d: str, k: int = 8) -> DataFrame:
    return dense.dense_topk(_asked_vectors(spark, d), _vectors(spark, d), k)


def _bm25(spark: SparkSession, d: str, k: int = 8) -> DataFrame:
    return lexical.bm25_topk(_asked_texts(spark, d), _texts(spark, d), k, latest="indexed_at")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(_dense(spark, d), _bm25(spark, d), depth=8)


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the embeddings table, each query among the rows of its own label."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    asked = v.filter(F.col("id") % EVERY == 0).withColumnRenamed("id", "query_id")
    return dense.dense_topk(asked, v, 8, same="label").select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def vector_normalise(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d, "dense").filter("dense is not null").withColumnRenamed("dense", "v")
    return c.select("id", F.round(V.norm(F.col("v")), 4).alias("norm"), F.round(V.norm(V.normalised(F.col("v"))), 4).alias("unit"))


def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    centre = each.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return centre.groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 4).alias("centroid_norm"))


def bm25_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return lexical.corpus_stats(docs).select("n_docs", "n_terms", F.round("avg_dl", 4).alias("avg_dl"))


def term_statistics(spark: SparkSession, d: str) -> DataFrame:
    return lexical.term_statistics(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d).select("query_id", "id", "rank", F.round("score", 4).alias("score"))


def hybrid_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Both channels over the chunks, fused by reciprocal ranks."""
    return _fused(spark, d).select("query_id", "id", "rank", F.round("rrf", 8).alias("rrf"), F.round("dense", 6).alias("dense"), F.round("bm25", 4).alias("bm25"))


def score_floor(spark: SparkSession, d: str) -> DataFrame:
    return fusion.floor(_fused(spark, d), FLOOR).select("query_id", "id", "rank")


def weak_match_signal(spark: SparkSession, d: str) -> DataFrame:
    return fusion.signals(_fused(spark, d), FLOOR, WEAK)


def response_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents, other chunks and dropped hits of each response."""
    return answers.response_counts(_fused(spark, d).join(_chunks(spark, d, "category"), "id"), FLOOR)


def hit_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Dense hits whose file has another hash in the manifest than in the index."""
    manifest = incremental.latest(table(spark, d, "files"), ["repo_id", "path"], "indexed_at")
    hits = _dense(spark, d).join(_chunks(spark, d, "repo_id", "path", "file_sha"), "id")
    return answers.with_freshness(hits, manifest).select("query_id", "id", "rank", "stale")


def route_queries(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "documents").filter("doc_kind = 'question' and text is not null").select(F.col("text").alias("q"))
    names = table(spark, d, "code_chunks").filter("symbol <> ''").select(F.col("symbol").alias("q"))
    return asked.union(names).distinct().select("q", T.is_symbol(F.col("q")).alias("symbol"), T.search_mode(F.col("q"), F.lit("auto")).alias("mode"))


def _evaluated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Cases and hits of three kinds.

    ``symbol``: a chunk's symbol asked for by words, its file and symbol and the file and symbol around it expected;
    ``similar``: a chunk's vector, any other chunk of a file of that path expected; ``negative``: vectors of another
    collection, of which nothing is expected.
    """
    info = _chunks(spark, d, "path", "symbol", "parent_symbol")
    named = info.filter(_one_in_fifty() & (F.coalesce("symbol", F.lit("")) != "")).withColumn("query_id", F.concat(F.lit("q:"), "id"))
    likes = _asked_vectors(spark, d)
    others = table(spark, d, "embeddings").filter(F.col("vec_id") % EVERY == 0).select(F.concat(F.lit("n:"), F.col("vec_id").cast("string")).alias("query_id"), F.col("embedding").alias("vector"))
    kind = lambda rows, name, mode: rows.select("query_id", F.lit(name).alias("kind"), F.lit(mode).alias("mode"))
    cases = kind(named, "symbol", "all").union(kind(likes, "similar", "any")).union(kind(others, "negative", "all"))
    around = named.filter("parent_symbol <> ''").select("query_id", F.concat_ws("::", "path", "parent_symbol").alias("expect"))
    expected = named.select("query_id", F.concat_ws("::", "path", "symbol").alias("expect")).union(around).union(likes.join(info, F.col("query_id") == F.col("id")).select("query_id", F.col("path").alias("expect")))
    by_vector = dense.dense_topk(likes.union(others), _vectors(spark, d), 8).withColumnRenamed("score", "dense").withColumn("mode", F.lit("dense"))
    by_term = lexical.bm25_topk(named.select("query_id", F.col("symbol").alias("text")), _texts(spark, d), 8, latest="indexed_at")
    hits = by_vector.unionByName(by_term.select("query_id", "id", "rank", F.lit(None).cast("double").alias("dense"), F.lit("bm25").alias("mode")))
    hits = fusion.with_weak(fusion.floor(hits, FLOOR, F.col("mode")), WEAK, F.col("mode")).join(info, "id")
    return evaluation.scored_cases(cases, hits, expected), hits


def eval_cases(spark: SparkSession, d: str) -> DataFrame:
    c = _evaluated(spark, d)[0]
    return c.select("query_id", "kind", "negative", F.round("recall", 6).alias("recall"), F.round("rr", 6).alias("rr"), "found", "weak", "abstained", F.round("top_dense", 6).alias("top_dense"))


def eval_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.by_kind(_evaluated(spark, d)[0])


def eval_abstain(spark: SparkSession, d: str) -> DataFrame:
    """The whole report: means over positives, rates of abstention and of weak positives, misses."""
    return evaluation.report(_evaluated(spark, d)[0])


def eval_calibration(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.calibration(_evaluated(spark, d)[0])


def eval_misses(spark: SparkSession, d: str) -> DataFrame:
    cases, hits = _evaluated(spark, d)
    return evaluation.misses(cases, hits).select("query_id", "kind", F.array_join("top", " ").alias("top"))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.nearest_percentiles(table(spark, d, "index_stats"), "repo_id", "total_seconds")


def prompt_assembly(spark: SparkSession, d: str) -> DataFrame:
    """A prompt for each query from its eight best chunks, whole."""
    asked = _asked_texts(spark, d).withColumnRenamed("text", "query")
    hits = fusion.with_weak(_fused(spark, d), WEAK).join(_chunks(spark, d, "context", "content", *INFO), "id")
    return answers.prompts(asked, hits)


QUERIES = [
    dense_topk, dense_topk_filtered, vector_normalise, label_centroids, bm25_corpus_stats, term_statistics, bm25_topk, hybrid_retrieval, score_floor, weak_match_signal, response_counts, hit_freshness, route_queries, eval_cases, eval_by_kind,
    eval_abstain, eval_calibration, eval_misses, latency_percentiles, prompt_assembly,
]

_LATEST = "ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) AS r_ FROM code_chunks WHERE id IS NOT NULL) WHERE r_ = 1)"
_ASKED = "('0x' || substring(md5(id), 1, 8))::BIGINT % 50 = 0"
_VEC = _LATEST + ", vec AS (SELECT id, dense::DOUBLE[] AS v FROM ch WHERE len(list_filter(dense, lambda x: x <> 0)) > 0)"
_DENSE = f"""{_VEC},
pairs AS (SELECT q.id AS query_id, c.id AS id, list_cosine_similarity(q.v, c.v) AS score FROM (SELECT * FROM vec WHERE {_ASKED}) q JOIN vec c ON c.id <> q.id),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM pairs) WHERE rank <= 8)"""
_WORDS = r"regexp_extract_all(lower(translate(coalesce({0}, ''), 'İ', 'I')), '[\p{{L}}\p{{M}}\p{{N}}_]+')"
_TERMS = f"""
tokens AS (SELECT id, unnest({_WORDS.format("text")}) AS term FROM docs),
post AS (SELECT id, term, count(*) AS tf FROM tokens GROUP BY ALL),
lens AS (SELECT id, len({_WORDS.format("text")}) AS dl FROM docs),
stats AS (SELECT count(*) AS n_docs, sum(dl) AS n_terms, avg(dl) AS avg_dl FROM lens),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""
_DOCUMENTS = f"docs AS (SELECT doc_id AS id, text FROM documents),{_TERMS}"


def _bm25_of(queries: str) -> str:
    return f"""docs AS (SELECT id, indexed_text AS text FROM ch),{_TERMS},
qt AS (SELECT DISTINCT query_id, unnest({_WORDS.format("text")}) AS term FROM ({queries})),
bm AS (
  SELECT a.query_id AS query_id, p.id AS id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS score
  FROM qt a JOIN dfs USING (term) JOIN post p USING (term) JOIN lens ON lens.id = p.id CROSS JOIN stats WHERE p.id <> a.query_id GROUP BY ALL
),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM bm) WHERE rank <= 8)"""


_TEXT = f"SELECT id AS query_id, concat_ws(' ', symbol, parent_symbol, regexp_extract(path, '([^/]*)$', 1)) AS text FROM ch WHERE {_ASKED}"
_BM25 = _bm25_of(_TEXT)
_FUSED = f"""{_DENSE}, {_BM25},
both_ AS (
  SELECT coalesce(d.query_id, b.query_id) AS query_id, coalesce(d.id, b.id) AS id, d.rank AS dr, b.rank AS br, d.score AS dense, b.score AS bm25,
         coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS rrf
  FROM dense d FULL OUTER JOIN bm25 b ON d.query_id = b.query_id AND d.id = b.id
),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, dr ASC NULLS LAST, br) AS rank FROM both_) WHERE rank <= 8)"""
_NAMED = f"SELECT 'q:' || id AS query_id, symbol AS text FROM ch WHERE {_ASKED} AND symbol <> ''"
_CASES = f"""{_VEC}, {_bm25_of(_NAMED)},
named AS (SELECT 'q:' || id AS query_id, path, symbol, parent_symbol FROM ch WHERE {_ASKED} AND symbol <> ''),
qv AS (SELECT id AS query_id, v FROM vec WHERE {_ASKED} UNION ALL SELECT 'n:' || vec_id, embedding::DOUBLE[] FROM embeddings WHERE vec_id % 50 = 0),
qp AS (SELECT q.query_id, c.id, list_cosine_similarity(q.v, c.v) AS dense FROM qv q JOIN vec c ON c.id <> q.query_id),
qd AS (SELECT query_id, id, rank, dense FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dense, 9) DESC, id) AS rank FROM qp) WHERE rank <= 8 AND dense >= 0.45),
hits AS (SELECT h.*, c.path, c.symbol, coalesce(c.parent_symbol, '') AS parent FROM (SELECT query_id, id, rank, dense, max(dense) OVER (PARTITION BY query_id) < 0.55 AS weak FROM qd
  UNION ALL SELECT query_id, id, rank, NULL, false FROM bm25) h JOIN ch c USING (id)),
expected AS (SELECT query_id, path, symbol AS wanted FROM named UNION SELECT query_id, path, parent_symbol FROM named WHERE parent_symbol <> ''
  UNION SELECT id, path, NULL FROM ch WHERE {_ASKED} AND id IN (SELECT id FROM vec)),
hit_of AS (SELECT e.query_id, e.path, e.wanted, min(h.rank) AS rank FROM expected e JOIN hits h ON h.query_id = e.query_id AND h.path = e.path
  AND (e.wanted IS NULL OR h.symbol = e.wanted OR h.parent = e.wanted OR ends_with(h.parent, '.' || e.wanted)) GROUP BY ALL),
kinds AS (SELECT query_id, 'symbol' AS kind, false AS one FROM named UNION ALL SELECT query_id, CASE WHEN query_id LIKE 'n:%' AND query_id NOT IN (SELECT id FROM vec) THEN 'negative' ELSE 'similar' END, true FROM qv),
needs AS (SELECT query_id, count(*) AS need FROM expected GROUP BY query_id),
gots AS (SELECT query_id, count(*) AS found, min(rank) AS first FROM hit_of GROUP BY query_id),
tops AS (SELECT query_id, max(dense) AS top_dense, bool_or(weak) AS weak FROM hits GROUP BY query_id),
cases AS (
  SELECT k.query_id, kind, kind = 'negative' AS negative, coalesce(found, 0) AS found, coalesce(weak, false) AS weak, t.query_id IS NULL OR weak AS abstained, top_dense,
    CASE WHEN kind = 'negative' THEN (t.query_id IS NULL OR weak)::INT::DOUBLE WHEN one THEN least(coalesce(found, 0), 1)::DOUBLE ELSE coalesce(found, 0)::DOUBLE / need END AS recall,
    CASE WHEN first IS NULL THEN 0.0 ELSE 1.0::DOUBLE / first END AS rr
  FROM kinds k LEFT JOIN needs n USING (query_id) LEFT JOIN gots g USING (query_id) LEFT JOIN tops t ON t.query_id = k.query_id
)"""
_SYMBOL = r"""(regexp_matches(trim(q), '^[A-Za-z_][A-Za-z0-9_.\-/:]*$')
  AND (regexp_matches(trim(q), '[a-z0-9][A-Z]') OR regexp_matches(trim(q), '[_\-./]|::') OR (regexp_matches(trim(q), '^[A-Z0-9_:]*[A-Z][A-Z0-9_:]*$') AND length(trim(q)) > 1)))"""

SQL = {
    "dense_topk": f"WITH {_DENSE} SELECT query_id, id, rank, round(score, 6) AS score FROM dense",
    "dense_topk_filtered": """SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (
        SELECT q.vec_id AS query_id, c.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND c.label = q.label)) WHERE rank <= 8""",
    "vector_normalise": f"""WITH {_LATEST} SELECT id, round(sqrt(list_sum(list_transform(dense, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm,
        CASE WHEN list_sum(list_transform(dense, lambda x: abs(x))) = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS unit FROM ch WHERE dense IS NOT NULL""",
    "label_centroids": """WITH each AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
        c AS (SELECT label, i, avg(x) AS m FROM each GROUP BY ALL) SELECT label, round(sqrt(sum(m * m)), 4) AS centroid_norm FROM c GROUP BY label""",
    "bm25_corpus_stats": f"WITH {_DOCUMENTS} SELECT n_docs, n_terms::BIGINT AS n_terms, round(avg_dl, 4) AS avg_dl FROM stats",
    "term_statistics": f"WITH {_DOCUMENTS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term",
    "bm25_topk": f"WITH {_LATEST}, {_BM25} SELECT query_id, id, rank, round(score, 4) AS score FROM bm25",
    "hybrid_retrieval": f"WITH {_FUSED} SELECT query_id, id, rank, round(rrf, 8) AS rrf, round(dense, 6) AS dense, round(bm25, 4) AS bm25 FROM fused",
    "score_floor": f"WITH {_FUSED} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM fused WHERE coalesce(dense, 1.0) >= 0.45",
    "weak_match_signal": f"""WITH {_FUSED} SELECT query_id, count(*) FILTER (coalesce(dense, 1.0) >= 0.45) AS n_hits, count(*) FILTER (coalesce(dense, 1.0) < 0.45) AS dropped,
        coalesce(max(coalesce(dense, 0.0)) FILTER (coalesce(dense, 1.0) >= 0.45) < 0.55, false) AS weak FROM fused GROUP BY query_id""",
    "response_counts": f"""WITH {_FUSED} SELECT query_id, count(*) FILTER (coalesce(fused.dense, 1.0) >= 0.45 AND category = 'doc') AS docs, count(*) FILTER (coalesce(fused.dense, 1.0) >= 0.45 AND category IS DISTINCT FROM 'doc') AS code,
        count(*) FILTER (coalesce(fused.dense, 1.0) < 0.45) AS dropped FROM fused JOIN ch USING (id) GROUP BY query_id""",
    "hit_freshness": f"""WITH {_DENSE}, m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY indexed_at DESC NULLS LAST) AS n_ FROM files) WHERE n_ = 1)
        SELECT query_id, d.id AS id, d.rank AS rank, c.file_sha <> m.sha AS stale FROM dense d JOIN ch c ON c.id = d.id LEFT JOIN m ON m.repo_id = c.repo_id AND m.path = c.path""",
    "route_queries": f"""SELECT q, {_SYMBOL} AS symbol, CASE WHEN {_SYMBOL} THEN 'bm25' ELSE 'dense' END AS mode FROM (
        SELECT text AS q FROM documents WHERE doc_kind = 'question' AND text IS NOT NULL UNION SELECT symbol FROM code_chunks WHERE symbol <> '')""",
    "eval_cases": f"WITH {_CASES} SELECT query_id, kind, negative, round(recall, 6) AS recall, round(rr, 6) AS rr, found, weak, abstained, round(top_dense, 6) AS top_dense FROM cases",
    "eval_by_kind": f"""WITH {_CASES} SELECT kind, count(*) AS n, CASE WHEN kind <> 'negative' THEN round(avg(recall), 6) END AS recall, CASE WHEN kind <> 'negative' THEN round(avg(rr), 6) END AS mrr,
        CASE WHEN kind = 'negative' THEN round(avg(abstained::INT::DOUBLE), 6) END AS abstain FROM cases GROUP BY kind""",
    "eval_abstain": f"""WITH {_CASES} SELECT count(*) AS n, round(avg(recall) FILTER (NOT negative), 6) AS recall, round(avg(rr) FILTER (NOT negative), 6) AS mrr, round(avg(abstained::INT::DOUBLE) FILTER (negative), 6) AS abstain_rate,
        round(avg(weak::INT::DOUBLE) FILTER (NOT negative), 6) AS false_weak_rate, count(*) FILTER (recall < 1) AS misses FROM cases""",
    "eval_calibration": f"""WITH {_CASES} SELECT round(min(top_dense) FILTER (NOT negative AND recall >= 1), 3) AS found_min, round(median(top_dense) FILTER (NOT negative AND recall >= 1), 3) AS found_median,
        round(max(top_dense) FILTER (negative), 3) AS negative_max, round(median(top_dense) FILTER (negative), 3) AS negative_median FROM cases WHERE top_dense IS NOT NULL""",
    "eval_misses": f"""WITH {_CASES} SELECT c.query_id AS query_id, kind, coalesce(string_agg(CASE WHEN h.symbol <> '' THEN h.path || '::' || h.symbol ELSE h.path END, ' ' ORDER BY h.rank) FILTER (h.rank <= 5), '') AS top
        FROM cases c LEFT JOIN hits h USING (query_id) WHERE recall < 1 GROUP BY ALL""",
    "latency_percentiles": """WITH o AS (SELECT repo_id, total_seconds AS v, row_number() OVER (PARTITION BY repo_id ORDER BY total_seconds) - 1 AS i, count(*) OVER (PARTITION BY repo_id) AS n
        FROM index_stats WHERE total_seconds IS NOT NULL)
        SELECT repo_id, max(n) AS n, max(v) FILTER (i = n // 2) AS p50, max(v) FILTER (i = least(n - 1, n * 95 // 100)) AS p95 FROM o GROUP BY repo_id""",
    "prompt_assembly": f"""WITH {_FUSED}, asked AS ({_TEXT}), b AS (SELECT query_id, rank, fused.dense AS dense, '[' || rank || '] ' || path || ':' || start_line || '-' || end_line || CASE WHEN category = 'doc' THEN ' — DOCUMENT' ELSE '' END
        || CASE WHEN symbol <> '' THEN ' — ' || coalesce(kind, '') || ' ' || symbol ELSE '' END || ' (repo: ' || repo_id || ')' || CASE WHEN context <> '' THEN chr(10) || context ELSE '' END
        || chr(10) || '```' || coalesce(lang, '') || chr(10) || coalesce(content, '') || chr(10) || '```' AS block FROM fused JOIN ch USING (id)),
        p AS (SELECT query_id, 'CODE CHUNKS (most relevant first):' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY rank)
          || CASE WHEN max(coalesce(dense, 0)) < 0.55 THEN chr(10) || chr(10) || 'Note: the best match is weak, and chunks as far off as these seldom help. If they don''t answer the question, say so.' ELSE '' END AS body FROM b GROUP BY query_id)
        SELECT a.query_id AS query_id, coalesce(body, '(no code chunks were found)') || chr(10) || chr(10) || 'Question: ' || a.text AS prompt FROM asked a LEFT JOIN p USING (query_id)""",
}
