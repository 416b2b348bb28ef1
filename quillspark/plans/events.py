"""Queries over push events, jobs and the event stream; some run as streams over all that is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import events as E
from quillspark.operators import jobs as J
from quillspark.session import checkpoint_folder, table
from quillspark.streaming import pushes


def push_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return E.first_deliveries(table(spark, d, "push_events"))


def event_to_repo(spark: SparkSession, d: str) -> DataFrame:
    return E.matched(table(spark, d, "push_events"), table(spark, d, "repos"))


def pending_jobs(spark: SparkSession, d: str) -> DataFrame:
    return E.pending_jobs(table(spark, d, "push_events"), table(spark, d, "repos"))


def branch_heads(spark: SparkSession, d: str) -> DataFrame:
    return E.heads(table(spark, d, "push_events"))


def repos_behind(spark: SparkSession, d: str) -> DataFrame:
    return E.behind(table(spark, d, "repos"), table(spark, d, "push_events"), table(spark, d, "index_stats"))


def latest_run(spark: SparkSession, d: str) -> DataFrame:
    """Newest run of each repository."""
    jobs = table(spark, d, "index_stats").select(F.col("run_id").alias("id"), "repo_id", F.col("finished_at").alias("created_at")).distinct()
    return E.latest_jobs(jobs).select("repo_id", F.col("id").alias("run_id"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs, each once, with the time at which they started."""
    s = table(spark, d, "index_stats").filter("run_id is not null and repo_id is not null").groupBy("repo_id", "run_id").agg(F.max("finished_at").alias("finished_at"), F.max("total_seconds").alias("seconds"))
    took = F.expr("make_dt_interval(0, 0, 0, cast(coalesce(seconds, 0) as decimal(18, 6)))")
    return s.select("repo_id", "run_id", (F.col("finished_at") - took).alias("started_at"), "finished_at")


def job_states(spark: SparkSession, d: str) -> DataFrame:
    """Jobs that the enqueued pushes open and the runs take."""
    e = table(spark, d, "push_events")
    hits = E.matched(e, table(spark, d, "repos")).filter(F.col("outcome") == E.ENQUEUED).join(e.select("event_no", F.col("received_at").alias("at"), "old_commit", "new_commit"), "event_no")
    return J.of_pushes(hits, _runs(spark, d))


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    return job_states(spark, d).select(
        F.concat_ws("#", "repo_id", F.col("job_no").cast("string")).alias("id"), "repo_id", F.lit("webhook").alias("trigger"), "status", F.lit(False).alias("force"), "created_at", none("timestamp_ntz").alias("started_at"), none("timestamp_ntz").alias("finished_at"), none("string").alias("error")
    )


def repos_with_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Every repository with its active job."""
    return table(spark, d, "repos").select("id", "status").join(J.active(_jobs(spark, d)).select(F.col("repo_id").alias("id"), F.col("id").alias("job_id"), F.col("status").alias("job_status")), "id", "left")


def newest_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The three newest jobs of each repository."""
    return J.newest(_jobs(spark, d), 3).select("repo_id", "place", "id", "status")


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """All events as payloads of both providers, read back.

    Every sixth carries a tag beside its branch, every tenth the deletion of a branch, every fourth a second branch (the
    other provider: every seventh is a tag, every ninth a deletion). Ids that are no numbers go through the provider of string ids.
    """
    e = table(spark, d, "push_events").withColumn("numeric", F.coalesce(F.col("external_id").rlike("^[0-9]+$"), F.lit(False)) & (F.col("event_no") % 2 == 1))
    ref = F.concat(F.lit(E.HEADS), F.col("branch"))
    update = lambda name, new: F.struct(name.alias("name"), F.col("old_commit").alias("oldObjectId"), new.alias("newObjectId"))
    new, n = F.col("new_commit"), F.col("event_no")
    more = [F.when(n % 6 == 0, update(F.lit("refs/tags/v1"), new)), F.when(n % 10 == 0, update(F.lit(E.HEADS + "gone"), F.lit(E.ZERO))), F.when(n % 4 == 0, update(F.lit(E.HEADS + "second"), new))]
    updates = F.filter(F.array(update(ref, new), *more), lambda x: x.isNotNull())
    azure = F.to_json(F.struct(F.lit("git.push").alias("eventType"), F.struct(updates.alias("refUpdates"), F.struct(F.col("external_id").alias("id"), F.col("repo_name").alias("name"), F.struct(F.col("project").alias("name")).alias("project")).alias("repository")).alias("resource")))
    tag = F.when(n % 7 == 0, F.concat(F.lit("refs/tags/"), F.col("branch"))).otherwise(ref)
    github = F.to_json(F.struct(tag.alias("ref"), F.col("old_commit").alias("before"), new.alias("after"), (n % 9 == 0).alias("deleted"), F.struct(F.expr("try_cast(external_id as bigint)").alias("id"), F.col("repo_name").alias("name"), F.struct(F.col("project").alias("login")).alias("owner")).alias("repository")))
    return E.azure_pushes(e.filter(~F.col("numeric")).select(azure.alias("body"))).unionByName(E.github_pushes(e.filter("numeric").select(github.alias("body"))))


def push_payloads(spark: SparkSession, d: str) -> DataFrame:
    """What the parsers of both providers read out of payloads of all events."""
    return _payloads(spark, d).groupBy("provider", "external_id", "repo_name", "project", "branch").agg(F.count("*").alias("n_events"), F.countDistinct("new_commit").alias("n_commits"))


def payloads_to_repos(spark: SparkSession, d: str) -> DataFrame:
    """Events parsed, by the outcome of matching their provider too."""
    e = _payloads(spark, d).withColumn("event_no", F.xxhash64("provider", "external_id", "branch", "new_commit")).withColumn("received_at", F.lit(0)).dropDuplicates(["provider", "external_id", "branch", "new_commit"])
    return E.matched(e, table(spark, d, "repos")).groupBy("repo_id", "outcome").agg(F.count("*").alias("n_events"))


def late_pushes(spark: SparkSession, d: str) -> DataFrame:
    """Events by whole days between push and receipt."""
    e = table(spark, d, "push_events").filter("pushed_at is not null")
    days = F.floor((F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("pushed_at").cast("timestamp"))) / F.lit(86_400_000_000))
    return e.groupBy(days.cast("bigint").alias("days")).agg(F.count("*").alias("n_events"))


def push_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Seconds since the push before on the same repository and branch."""
    w = Window.partitionBy("external_id", "branch").orderBy("pushed_at", "event_no")
    e = table(spark, d, "push_events").filter("external_id is not null and pushed_at is not null")
    us = F.unix_micros(F.col("pushed_at").cast("timestamp"))
    return e.select("event_no", F.floor((us - F.lag(us).over(w)) / 1_000_000).cast("bigint").alias("gap_seconds"))


def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 2).alias("total"))
    return e.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n_events", "total")


def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n_events"))
    return e.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n_events")


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("w")).agg(F.count("*").alias("n_events"))
    return e.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n_events")


def _folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_push_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """First deliveries, put together from the parts that the stream's batches wrote."""
    folder = _folder(spark)
    pushes.keep_first_deliveries(pushes.table_stream(spark, d, "push_events"), f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return pushes.first_of_all(spark, f"{folder}/table")


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts of the stream: the windows that the watermark (an hour behind the latest event) has closed."""
    folder = _folder(spark)
    stream = pushes.tumbling(pushes.table_stream(spark, d, "events", 1000))
    pushes.closed_windows(stream, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/table").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n_events", F.round("total", 2).alias("total"))


QUERIES = [push_dedupe, event_to_repo, pending_jobs, branch_heads, repos_behind, latest_run, job_states, repos_with_jobs, newest_jobs, push_payloads, payloads_to_repos, late_pushes, push_gaps, tumbling_windows, sliding_windows, session_windows, stream_push_dedupe, stream_tumbling]

_DEDUPE = "SELECT external_id, new_commit, arg_min(event_no, struct_pack(a := received_at, b := event_no)) AS event_no, count(*) AS deliveries FROM push_events WHERE external_id IS NOT NULL AND new_commit IS NOT NULL GROUP BY ALL"
_MATCHED = """(SELECT event_no, repo_id, CASE WHEN repo_id IS NULL THEN 'ignored: not a tracked repo/branch' WHEN new_commit <> '' AND n > 1 THEN 'ignored: this commit was already handled' ELSE 'enqueued' END AS outcome FROM (
  SELECT e.event_no, r.id AS repo_id, new_commit, row_number() OVER (PARTITION BY r.id, new_commit ORDER BY received_at, event_no) AS n FROM push_events e LEFT JOIN
  (SELECT external_id, branch, min(id) AS id FROM repos WHERE external_id <> '' GROUP BY ALL) r ON r.external_id = e.external_id AND r.branch = e.branch))"""
_JOBS = f"""r AS (SELECT repo_id, run_id, max(finished_at) AS finished_at, max(finished_at) - to_microseconds(round(coalesce(max(total_seconds), 0) * 1000000)::BIGINT) AS started FROM index_stats WHERE run_id IS NOT NULL AND repo_id IS NOT NULL GROUP BY ALL),
  rn AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY started, run_id) - 1 AS job_no FROM r WHERE started IS NOT NULL),
  p AS (SELECT m.repo_id, e.*, (SELECT count(*) FROM rn WHERE rn.repo_id = m.repo_id AND rn.started <= e.received_at) AS job_no FROM {_MATCHED} m JOIN push_events e USING (event_no) WHERE outcome = 'enqueued'),
  g AS (SELECT repo_id, job_no, min(received_at) AS created_at, arg_min(old_commit, struct_pack(a := received_at, b := event_no)) AS from_commit, arg_max(new_commit, struct_pack(a := received_at, b := event_no)) AS to_commit, count(*) AS pushes FROM p GROUP BY ALL),
  jobs AS (SELECT g.*, rn.run_id AS run_id, CASE WHEN rn.run_id IS NULL THEN 'queued' WHEN finished_at IS NULL THEN 'running' ELSE 'done' END AS status FROM g LEFT JOIN rn ON rn.repo_id = g.repo_id AND rn.job_no = g.job_no)"""
_PARSED = """e AS (SELECT *, coalesce(regexp_matches(external_id, '^[0-9]+$'), false) AND event_no % 2 = 1 AS hub FROM push_events),
  parsed AS (SELECT 'azure' AS provider, external_id, coalesce(repo_name, '') AS repo_name, coalesce(project, '') AS project, branch, coalesce(new_commit, '') AS new_commit FROM e WHERE NOT hub AND external_id <> '' AND branch IS NOT NULL
    UNION ALL SELECT 'azure', external_id, coalesce(repo_name, ''), coalesce(project, ''), 'second', coalesce(new_commit, '') FROM e WHERE NOT hub AND external_id <> '' AND event_no % 4 = 0
    UNION ALL SELECT 'azure', external_id, coalesce(repo_name, ''), coalesce(project, ''), 'gone', repeat('0', 40) FROM e WHERE NOT hub AND external_id <> '' AND event_no % 10 = 0
    UNION ALL SELECT 'github', external_id::BIGINT::VARCHAR, coalesce(repo_name, ''), coalesce(project, ''), branch, coalesce(new_commit, '') FROM e WHERE hub AND event_no % 7 <> 0 AND event_no % 9 <> 0 AND branch IS NOT NULL)"""
_HEADS = "(SELECT external_id, branch, arg_max(new_commit, struct_pack(a := pushed_at, b := event_no)) AS head FROM push_events WHERE external_id IS NOT NULL AND pushed_at IS NOT NULL GROUP BY ALL)"
_TUMBLING = "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n_events, round(sum(value), 2) AS total FROM events GROUP BY ALL"

SQL = {
    "push_dedupe": _DEDUPE,
    "event_to_repo": f"SELECT event_no, repo_id, outcome FROM {_MATCHED}",
    "pending_jobs": f"""SELECT repo_id, arg_min(old_commit, struct_pack(a := received_at, b := e.event_no)) AS from_commit, arg_max(new_commit, struct_pack(a := received_at, b := e.event_no)) AS to_commit, count(*) AS pushes
        FROM {_MATCHED} m JOIN push_events e ON e.event_no = m.event_no WHERE outcome = 'enqueued' GROUP BY repo_id""",
    "branch_heads": f"SELECT external_id, branch, head FROM {_HEADS}",
    "repos_behind": f"""SELECT r.id AS id, head, coalesce(commit_sha, '') AS indexed FROM repos r JOIN {_HEADS} h ON h.external_id = r.external_id AND h.branch = r.branch
        LEFT JOIN (SELECT * FROM (SELECT repo_id, commit_sha, row_number() OVER (PARTITION BY repo_id ORDER BY finished_at DESC NULLS LAST, commit_sha DESC NULLS LAST, run_id DESC) AS n FROM index_stats) WHERE n = 1) s ON s.repo_id = r.id
        WHERE auto_sync AND status <> 'indexing' AND r.external_id <> '' AND head <> coalesce(commit_sha, '')""",
    "latest_run": "SELECT repo_id, run_id FROM (SELECT repo_id, run_id, row_number() OVER (PARTITION BY repo_id ORDER BY finished_at DESC NULLS LAST, run_id DESC) AS n FROM index_stats) WHERE n = 1",
    "job_states": f"WITH {_JOBS} SELECT repo_id, job_no, created_at, from_commit, to_commit, pushes, run_id, status FROM jobs",
    "repos_with_jobs": f"""WITH {_JOBS}, a AS (SELECT repo_id, arg_min(struct_pack(i := repo_id || '#' || job_no, s := status), struct_pack(c := created_at, i := repo_id || '#' || job_no)) AS j FROM jobs WHERE status IN ('queued', 'running') GROUP BY repo_id)
        SELECT r.id AS id, r.status AS status, j.i AS job_id, j.s AS job_status FROM repos r LEFT JOIN a ON a.repo_id = r.id""",
    "newest_jobs": f"WITH {_JOBS} SELECT * FROM (SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, repo_id || '#' || job_no DESC) AS place, repo_id || '#' || job_no AS id, status FROM jobs) WHERE place <= 3",
    "push_payloads": f"WITH {_PARSED} SELECT provider, external_id, repo_name, project, branch, count(*) AS n_events, count(DISTINCT new_commit) AS n_commits FROM parsed GROUP BY ALL",
    "payloads_to_repos": f"""WITH {_PARSED}, d AS (SELECT DISTINCT provider, external_id, branch, new_commit FROM parsed),
        m AS (SELECT d.*, r.id AS repo_id FROM d LEFT JOIN (SELECT external_id, branch, provider, min(id) AS id FROM repos WHERE external_id <> '' GROUP BY ALL) r ON r.external_id = d.external_id AND r.branch = d.branch AND r.provider = d.provider),
        n AS (SELECT *, row_number() OVER (PARTITION BY repo_id, new_commit) AS n FROM m)
        SELECT repo_id, CASE WHEN repo_id IS NULL THEN 'ignored: not a tracked repo/branch' WHEN new_commit <> '' AND n > 1 THEN 'ignored: this commit was already handled' ELSE 'enqueued' END AS outcome, count(*) AS n_events FROM n GROUP BY ALL""",
    "late_pushes": "SELECT floor((epoch_us(received_at) - epoch_us(pushed_at)) / 86400000000)::BIGINT AS days, count(*) AS n_events FROM push_events WHERE pushed_at IS NOT NULL GROUP BY 1",
    "push_gaps": """SELECT event_no, floor((epoch_us(pushed_at) - lag(epoch_us(pushed_at)) OVER (PARTITION BY external_id, branch ORDER BY pushed_at, event_no)) / 1000000)::BIGINT AS gap_seconds
        FROM push_events WHERE external_id IS NOT NULL AND pushed_at IS NOT NULL""",
    "tumbling_windows": _TUMBLING,
    "sliding_windows": """SELECT start, count(*) AS n_events FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS start FROM events UNION ALL SELECT time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour' FROM events) GROUP BY start""",
    "session_windows": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
        SELECT user_id, min(ts) AS start, count(*) AS n_events FROM s GROUP BY user_id, n""",
    "stream_push_dedupe": _DEDUPE,
    "stream_tumbling": f"SELECT * FROM ({_TUMBLING}) WHERE start + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)",
}
