"""Index jobs as tables: enqueueing, state changes, recovery, and the jobs that pushes and runs imply.

``jobs`` has ``id, repo_id, trigger, status, force, created_at, started_at, finished_at, error``; a repository has one queued
job at most. ``status`` goes from ``queued`` to ``running`` to ``done``, ``failed`` or ``skipped``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "id string, repo_id string, trigger string, status string, force boolean, created_at timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz, error string"
NEXT = {"queued": ("running", "skipped"), "running": ("done", "failed")}


def enqueued(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """The jobs after ``requests`` (``repo_id, trigger, force, at``): a repository's queued job takes further requests and their ``force``, else one is opened by the first."""
    first = F.struct("at", "trigger")
    asked = requests.groupBy("repo_id").agg(F.min("at").alias("at"), F.min_by("trigger", first).alias("asked_by"), F.max(F.coalesce("force", F.lit(False))).alias("asked_force"))
    queued = jobs.filter("status = 'queued'").join(asked.select("repo_id", "asked_force"), "repo_id", "left").withColumn("force", F.col("force") | F.coalesce("asked_force", F.lit(False))).select(*jobs.columns)
    fresh = asked.join(jobs.filter("status = 'queued'").select("repo_id"), "repo_id", "left_anti")
    none = lambda t: F.lit(None).cast(t)
    opened = fresh.select(
        F.substring(F.sha2(F.concat_ws("/", "repo_id", F.col("at").cast("string")), 256), 1, 12).alias("id"), "repo_id", F.col("asked_by").alias("trigger"), F.lit("queued").alias("status"), F.col("asked_force").alias("force"), F.col("at").alias("created_at"),
        none("timestamp_ntz").alias("started_at"), none("timestamp_ntz").alias("finished_at"), none("string").alias("error"),
    )
    return jobs.filter("status <> 'queued'").unionByName(queued).unionByName(opened)


def changed(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """The jobs after ``changes`` (``id, to, at, message``); a change that the state doesn't allow leaves the job as it is."""
    c = changes.select("id", "to", "at", "message")
    allowed = F.lit(False)
    for status, after in NEXT.items():
        allowed = allowed | ((F.col("status") == status) & F.col("to").isin(*after))
    ok = F.coalesce(allowed, F.lit(False))
    started, over = ok & (F.col("to") == "running"), ok & (F.col("to") != "running")
    j = jobs.join(c, "id", "left")
    new = {
        "status": F.when(ok, F.col("to")).otherwise(F.col("status")), "started_at": F.when(started, F.col("at")).otherwise(F.col("started_at")), "finished_at": F.when(over, F.col("at")).otherwise(F.col("finished_at")),
        "error": F.when(over, F.substring("message", 1, 2000)).otherwise(F.col("error")),
    }
    return j.select(*[new[n].alias(n) if n in new else F.col(n) for n in jobs.columns])


def recovered(jobs: DataFrame, reason: str, at: str) -> DataFrame:
    """After a restart: jobs still marked running were cut short and have failed."""
    cut = F.col("status") == "running"
    when = F.lit(at).cast("timestamp_ntz")
    new = {"status": F.when(cut, "failed").otherwise(F.col("status")), "error": F.when(cut, reason).otherwise(F.col("error")), "finished_at": F.when(cut, when).otherwise(F.col("finished_at"))}
    return jobs.select(*[new[n].alias(n) if n in new else F.col(n) for n in jobs.columns])


def active(jobs: DataFrame) -> DataFrame:
    """The oldest queued or running job of each repository."""
    rest = [c for c in jobs.columns if c != "repo_id"]
    return jobs.filter("status in ('queued', 'running')").groupBy("repo_id").agg(F.min_by(F.struct(*rest), F.struct("created_at", "id")).alias("j")).select("repo_id", "j.*")


def newest(jobs: DataFrame, most: int = 50) -> DataFrame:
    """The newest jobs of each repository, the last created first (``place`` from 1)."""
    w = Window.partitionBy("repo_id").orderBy(F.desc("created_at"), F.desc("id"))
    return jobs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def of_pushes(pushes: DataFrame, runs: DataFrame) -> DataFrame:
    """``repo_id, job_no, created_at, from_commit, to_commit, pushes, run_id, status``: the jobs that pushes open and runs take.

    ``pushes`` has ``repo_id, at, event_no, old_commit, new_commit``, ``runs`` ``repo_id, run_id, started_at, finished_at``. All
    pushes between two starts of runs are one job; the next start takes it. Starts are counted by day first, so that only
    the events of a repository's single days are sorted, however many events it has.
    """
    p = pushes.select("repo_id", "at", F.lit(1).alias("push"), F.col("event_no").cast("string").alias("key"), "event_no", "old_commit", "new_commit")
    r = runs.filter("started_at is not null").select("repo_id", F.col("started_at").alias("at"), F.lit(0).alias("push"), F.col("run_id").alias("key"), "run_id", "finished_at")
    both = p.unionByName(r, allowMissingColumns=True).withColumn("day", F.to_date("at"))
    daily = both.groupBy("repo_id", "day").agg(F.count_if(F.col("push") == 0).alias("starts"))
    before = F.coalesce(F.sum("starts").over(Window.partitionBy("repo_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum(1 - F.col("push")).over(Window.partitionBy("repo_id", "day").orderBy("at", "push", "key").rowsBetween(Window.unboundedPreceding, 0))
    numbered = both.join(daily.withColumn("before", before), ["repo_id", "day"]).withColumn("n", F.col("before") + inside)
    order = F.struct("at", "event_no")
    jobs = numbered.filter("push = 1").groupBy("repo_id", F.col("n").alias("job_no")).agg(F.min("at").alias("created_at"), F.min_by("old_commit", order).alias("from_commit"), F.max_by("new_commit", order).alias("to_commit"), F.count("*").alias("pushes"))
    takes = numbered.filter("push = 0").select("repo_id", (F.col("n") - 1).alias("job_no"), "run_id", "finished_at")
    status = F.when(F.col("run_id").isNull(), "queued").when(F.col("finished_at").isNull(), "running").otherwise("done")
    return jobs.join(takes, ["repo_id", "job_no"], "left").select("repo_id", "job_no", "created_at", "from_commit", "to_commit", "pushes", "run_id", status.alias("status"))
