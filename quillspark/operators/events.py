"""Push events: parsing, deduplication, matching with repositories, pending jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.incremental import latest

AZURE = "eventType string, resource struct<refUpdates:array<struct<name:string,oldObjectId:string,newObjectId:string>>,repository:struct<id:string,name:string,project:struct<name:string>>>"
GITHUB = "ref string, before string, after string, deleted boolean, repository struct<id:bigint,name:string,owner:struct<login:string,name:string>>"
ZERO = "0" * 40
HEADS = "refs/heads/"
EVENT = ["external_id", "repo_name", "project", "branch", "old_commit", "new_commit"]


def _or_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def azure_pushes(payloads: DataFrame) -> DataFrame:
    """Events of JSON payloads (column ``body``) of one provider: one row for each updated branch, its deletion too; tags, other kinds of events and payloads without a repository id give none."""
    e = payloads.select(F.from_json("body", AZURE).alias("e")).filter("coalesce(e.eventType, 'git.push') = 'git.push' and e.resource.repository.id <> ''")
    u = e.select("e.resource.repository", F.explode("e.resource.refUpdates").alias("u")).filter(F.col("u.name").startswith(HEADS))
    return u.select(
        F.lit("azure").alias("provider"), F.col("repository.id").alias("external_id"), _or_empty("repository.name").alias("repo_name"), _or_empty("repository.project.name").alias("project"),
        F.expr(f"substring(u.name, {len(HEADS) + 1})").alias("branch"), _or_empty("u.oldObjectId").alias("old_commit"), _or_empty("u.newObjectId").alias("new_commit"),
    )


def github_pushes(payloads: DataFrame) -> DataFrame:
    """Events of the other provider's payloads, one branch each; tags, deletions and payloads without a repository id give none."""
    e = payloads.select(F.from_json("body", GITHUB).alias("e")).filter(F.col("e.ref").startswith(HEADS) & ~F.coalesce("e.deleted", F.lit(False)) & F.col("e.repository.id").isNotNull())
    owner = F.coalesce(F.when(F.col("e.repository.owner.login") != "", F.col("e.repository.owner.login")), F.col("e.repository.owner.name"), F.lit(""))
    return e.select(
        F.lit("github").alias("provider"), F.col("e.repository.id").cast("string").alias("external_id"), _or_empty("e.repository.name").alias("repo_name"), owner.alias("project"),
        F.expr(f"substring(e.ref, {len(HEADS) + 1})").alias("branch"), _or_empty("e.before").alias("old_commit"), _or_empty("e.after").alias("new_commit"),
    )


def first_deliveries(events: DataFrame, *also: str) -> DataFrame:
    """The first event received of each (repository, commit), its columns ``also``, and how many came; aggregation keeps one row per key before the shuffle."""
    keys = ["external_id", "new_commit"]
    return events.filter("external_id is not null and new_commit is not null").groupBy(*keys).agg(
        *[F.min_by(c, F.struct("received_at", "event_no")).alias(c) for c in ("event_no", *also)], F.count("*").alias("deliveries")
    )


UNKNOWN, HANDLED, ENQUEUED = "ignored: not a tracked repo/branch", "ignored: this commit was already handled", "enqueued"


def matched(events: DataFrame, repos: DataFrame) -> DataFrame:
    """``event_no, repo_id, outcome`` of each event.

    An event belongs to the repository of its external id and branch, and of its provider where the events have that
    column (of several the least id). Of the events of one repository and commit only the first received is enqueued;
    events without a commit always are.
    """
    by = ["external_id", "branch"] + (["provider"] if "provider" in events.columns else [])
    r = repos.filter("external_id <> ''").groupBy(*by).agg(F.min("id").alias("repo_id"))
    e = events.select("event_no", "new_commit", "received_at", *by).join(r, by, "left").select("event_no", "repo_id", "new_commit", "received_at")
    # the first delivery of a commit is an aggregate, so that a hot repository is no group of its own
    known = e.filter("repo_id is not null and new_commit <> ''")
    first = known.groupBy("repo_id", "new_commit").agg(F.min_by("event_no", F.struct("received_at", "event_no")).alias("event_no")).select("event_no", F.lit(True).alias("first"))
    again = F.col("first").isNull() & (F.coalesce("new_commit", F.lit("")) != "")
    outcome = F.when(F.col("repo_id").isNull(), UNKNOWN).when(again, HANDLED).otherwise(ENQUEUED)
    return e.join(first, "event_no", "left").select("event_no", "repo_id", outcome.alias("outcome"))


def pending_jobs(events: DataFrame, repos: DataFrame) -> DataFrame:
    """One pending job per repository from the commits pushed: first and last commit, number of pushes."""
    hits = matched(events, repos).filter(F.col("outcome") == ENQUEUED).join(events.select("event_no", "old_commit", "new_commit", "received_at"), "event_no")
    order = F.struct("received_at", "event_no")
    return hits.groupBy("repo_id").agg(F.min_by("old_commit", order).alias("from_commit"), F.max_by("new_commit", order).alias("to_commit"), F.count("*").alias("pushes"))


def heads(events: DataFrame) -> DataFrame:
    """The commit at the head of each (repository, branch): the latest pushed."""
    known = events.filter("external_id is not null and pushed_at is not null").select("external_id", "branch", "new_commit", "pushed_at", "event_no")
    return known.groupBy("external_id", "branch").agg(F.max_by("new_commit", F.struct("pushed_at", "event_no")).alias("head"))


def behind(repos: DataFrame, events: DataFrame, stats: DataFrame) -> DataFrame:
    """Synced repositories whose head isn't the commit of their last run."""
    last = latest(stats.filter("repo_id is not null").select("repo_id", "commit_sha", "finished_at", "run_id"), ["repo_id"], "finished_at").select(F.col("repo_id").alias("id"), "commit_sha")
    r = repos.filter("auto_sync and status <> 'indexing' and external_id <> ''").select("id", "external_id", "branch")
    return r.join(heads(events), ["external_id", "branch"]).join(last, "id", "left").filter("head <> coalesce(commit_sha, '')").select("id", "head", F.coalesce("commit_sha", F.lit("")).alias("indexed"))


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """Newest job of each repository."""
    w = Window.partitionBy("repo_id").orderBy(F.desc("created_at"), F.desc("id"))
    return jobs.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
