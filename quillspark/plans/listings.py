"""Listings and small expressions over the given tables: repositories, files, health, stamps, signatures, descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import signing
from quillspark.functions import text as T
from quillspark.operators import enrichment, incremental, state
from quillspark.session import table

SECRET = "a shared secret"


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return incremental.latest(table(spark, d, "files"), ["repo_id", "path"], "indexed_at")


def repo_listing(spark: SparkSession, d: str) -> DataFrame:
    """Repositories of each provider by creation."""
    place = F.row_number().over(Window.partitionBy("provider").orderBy("created_at", "id"))
    return table(spark, d, "repos").select("id", "provider", place.alias("place"))


def file_listing(spark: SparkSession, d: str) -> DataFrame:
    """Files of each repository by path."""
    return _manifest(spark, d).select("repo_id", "path", F.row_number().over(Window.partitionBy("repo_id").orderBy("path")).alias("place"), "chunk_count")


def repo_lines(spark: SparkSession, d: str) -> DataFrame:
    """One line of text for each repository, with its totals."""
    r = table(spark, d, "repos").join(state.repo_totals(table(spark, d, "files")).withColumnRenamed("repo_id", "id"), "id", "left").fillna(0, ["file_count", "chunk_count"])
    some = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    line = F.concat(
        F.lit("- "), F.col("id"), F.lit(" ("), F.col("provider"), F.lit(", "), F.coalesce(some("branch"), F.lit("no branch")), F.lit(") — "), F.col("status"), F.lit(", "), F.col("file_count").cast("string"), F.lit(" files, "),
        F.col("chunk_count").cast("string"), F.lit(" chunks"), F.coalesce(F.concat(F.lit(", last index "), some("last_indexed_at")), F.lit("")),
    )
    return r.select("id", line.alias("line"))


def health(spark: SparkSession, d: str) -> DataFrame:
    """One row: repositories, files, chunks, and repositories in error."""
    r = table(spark, d, "repos").agg(F.count("*").alias("repos"), F.count_if(F.col("status") == "error").alias("in_error"))
    return r.join(_manifest(spark, d).agg(F.count("*").alias("files"))).join(table(spark, d, "code_chunks").agg(F.countDistinct("id").alias("chunks")))


def remote_registered(spark: SparkSession, d: str) -> DataFrame:
    """Remote repositories that events name, with the id under which each is registered."""
    remote = table(spark, d, "push_events").filter("external_id <> ''").select("external_id", "repo_name").distinct()
    known = table(spark, d, "repos").filter("external_id <> ''").groupBy("external_id").agg(F.min("id").alias("registered_as"))
    return remote.join(known, "external_id", "left")


def repo_removed(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each table once the repositories in error are removed, with all that belongs to them."""
    gone = table(spark, d, "repos").filter("status = 'error'").select(F.col("id").alias("repo_id"))
    left = lambda name, rows: state.without(rows, gone, "repo_id").agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"))
    repos = left("repos", table(spark, d, "repos").withColumnRenamed("id", "repo_id"))
    return repos.union(left("files", table(spark, d, "files"))).union(left("code_chunks", table(spark, d, "code_chunks"))).union(left("index_stats", table(spark, d, "index_stats")))


def short_stamps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_chunks").select("indexed_at").union(table(spark, d, "repos").select("last_indexed_at")).distinct().filter("indexed_at is not null").select("indexed_at", T.short_stamp(F.col("indexed_at")).alias("stamp"))


def header_redaction(spark: SparkSession, d: str) -> DataFrame:
    """Texts and contents that name an authorization header, by the hash of what is left."""
    rows = table(spark, d, "documents").select("text").union(table(spark, d, "code_chunks").select("content")).filter(F.col("text").rlike("(?i)(Basic|Bearer)\\s")).distinct()
    return rows.select(F.md5("text").alias("before"), F.md5(T.without_authorization(F.col("text"))).alias("after"))


def offset_lines(spark: SparkSession, d: str) -> DataFrame:
    """The line on which the middle character of each content stands."""
    rows = table(spark, d, "code_chunks").filter("content <> ''").groupBy("id").agg(F.max(T.line_of(F.col("content"), F.floor(F.length("content") / 2).cast("int"))).alias("line"))
    return rows.select("id", F.col("line").cast("bigint").alias("line"))


def stats_json(spark: SparkSession, d: str) -> DataFrame:
    """Stats of runs written as JSON and read back."""
    fields = ["files_seen", "added", "modified", "deleted", "unchanged", "skipped", "chunks_written", "redactions", "embed_seconds", "total_seconds", "forced", "reason"]
    s = table(spark, d, "index_stats")
    schema = s.select(*fields).schema
    written = s.select("run_id", F.to_json(F.struct(*fields)).alias("stats")).distinct()
    return written.select("run_id", F.from_json("stats", schema).alias("s")).select("run_id", "s.*")


def push_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of events' texts, and whether they fit their own and the text of the event before."""
    body = F.concat_ws("|", "external_id", "branch", "new_commit")
    e = table(spark, d, "push_events").select("event_no", body.alias("body")).withColumn("signature", signing.signed(SECRET, F.col("body")))
    return e.select("event_no", "signature", signing.verified(SECRET, F.col("body"), F.col("signature")).alias("own"), signing.verified(SECRET, F.concat("body", F.lit("x")), F.col("signature")).alias("other"))


def usable_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions of chunks that may be shown, by repository."""
    c = table(spark, d, "code_chunks").filter("context <> ''").select("repo_id", "context").distinct()
    return c.groupBy("repo_id").agg(F.count("*").alias("n_contexts"), F.count_if(enrichment.usable(F.col("context"))).alias("n_usable"))


QUERIES = [repo_listing, file_listing, repo_lines, health, remote_registered, repo_removed, short_stamps, header_redaction, offset_lines, stats_json, push_signatures, usable_descriptions]

_MANIFEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY indexed_at DESC NULLS LAST, chunk_count DESC) AS r_ FROM files) WHERE r_ = 1)"
_LEFT = "SELECT '{0}' AS name, count(*) AS n_rows FROM {0} WHERE {1} NOT IN (SELECT id FROM repos WHERE status = 'error') OR {1} IS NULL"
_KEY = SECRET.encode().ljust(64, b"\0")
_INNER, _OUTER = (bytes(b ^ pad for b in _KEY).hex() for pad in (0x36, 0x5C))
_SIGNED = f"'sha256=' || sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || encode(concat_ws('|', external_id, branch, new_commit)))))"

SQL = {
    "repo_listing": "SELECT id, provider, row_number() OVER (PARTITION BY provider ORDER BY created_at NULLS FIRST, id) AS place FROM repos",
    "file_listing": f"SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS place, chunk_count FROM {_MANIFEST}",
    "repo_lines": f"""SELECT id, '- ' || id || ' (' || provider || ', ' || coalesce(nullif(branch, ''), 'no branch') || ') — ' || status || ', ' || coalesce(f, 0) || ' files, ' || coalesce(c, 0)::BIGINT || ' chunks'
        || coalesce(', last index ' || nullif(last_indexed_at, ''), '') AS line FROM repos LEFT JOIN (SELECT repo_id, count(*) AS f, sum(chunk_count) AS c FROM {_MANIFEST} GROUP BY repo_id) t ON t.repo_id = id""",
    "health": f"SELECT (SELECT count(*) FROM repos) AS repos, (SELECT count(*) FROM repos WHERE status = 'error') AS in_error, (SELECT count(*) FROM {_MANIFEST}) AS files, (SELECT count(DISTINCT id) FROM code_chunks) AS chunks",
    "remote_registered": "SELECT e.external_id, repo_name, registered_as FROM (SELECT DISTINCT external_id, repo_name FROM push_events WHERE external_id <> '') e LEFT JOIN (SELECT external_id, min(id) AS registered_as FROM repos WHERE external_id <> '' GROUP BY 1) r USING (external_id)",
    "repo_removed": " UNION ALL ".join(_LEFT.format(t, "id" if t == "repos" else "repo_id") for t in ("repos", "files", "code_chunks", "index_stats")),
    "short_stamps": """SELECT i AS indexed_at, CASE WHEN regexp_matches(i, '(Z|[+-]\\d{2}:?\\d{2})$') AND try_cast(i AS TIMESTAMPTZ) IS NOT NULL THEN strftime(timezone('UTC', try_cast(i AS TIMESTAMPTZ)), '%Y-%m-%d %H:%M') || ' UTC'
        WHEN try_cast(i AS TIMESTAMP) IS NOT NULL THEN strftime(try_cast(i AS TIMESTAMP), '%Y-%m-%d %H:%M') ELSE i END AS stamp FROM (SELECT indexed_at AS i FROM code_chunks UNION SELECT last_indexed_at FROM repos) WHERE i IS NOT NULL""",
    "header_redaction": """SELECT md5(t) AS before, md5(regexp_replace(t, '(?i)(Basic|Bearer)\\s+[A-Za-z0-9+/=_\\-]+', '\\1 [REDACTED]', 'g')) AS after FROM (SELECT text AS t FROM documents UNION SELECT content FROM code_chunks)
        WHERE regexp_matches(t, '(?i)(Basic|Bearer)\\s')""",
    "offset_lines": "SELECT id, max(len(string_split(substring(content, 1, length(content) // 2), chr(10)))) AS line FROM code_chunks WHERE content <> '' GROUP BY id",
    "stats_json": "SELECT DISTINCT run_id, files_seen, added, modified, deleted, unchanged, skipped, chunks_written, redactions, embed_seconds, total_seconds, forced, reason FROM index_stats",
    "push_signatures": f"SELECT event_no, {_SIGNED} AS signature, true AS own, false AS other FROM push_events",
    "usable_descriptions": """SELECT repo_id, count(*) AS n_contexts, count(*) FILTER (length(trim(context)) >= 20 AND NOT regexp_matches(context, '[\\x{3040}-\\x{30ff}\\x{4e00}-\\x{9fff}\\x{ac00}-\\x{d7a3}\\x{0400}-\\x{04ff}]')) AS n_usable
        FROM (SELECT DISTINCT repo_id, context FROM code_chunks WHERE context <> '') GROUP BY repo_id""",
}
