"""Incremental maintenance: which files changed against the manifest, and writing only those again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["repo_id", "path"]


def latest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The latest row of each key (greatest ``at``, nulls first, ties by a hash of the row)."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, F.xxhash64(*rest))).alias("r"))
    return picked.select(*keys, "r.*")


def manifest_diff(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``repo_id, path, state``: added, modified, deleted or unchanged by content hash; a null hash never equals another."""
    f = files.select(*KEY, F.col("sha").alias("new_sha"), F.lit(True).alias("here"))
    m = manifest.select(*KEY, F.col("sha").alias("old_sha"), F.lit(True).alias("known"))
    state = F.when(F.col("known").isNull(), "added").when(F.col("here").isNull(), "deleted").when(F.col("new_sha") == F.col("old_sha"), "unchanged").otherwise("modified")
    return f.join(m, KEY, "full_outer").select(*KEY, state.alias("state"))


def counters(diff: DataFrame) -> DataFrame:
    """Files seen, added, modified, deleted and unchanged by repository."""
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    return diff.groupBy("repo_id").agg(
        n("added", "modified", "unchanged").alias("files_seen"), n("added").alias("added"), n("modified").alias("modified"), n("deleted").alias("deleted"), n("unchanged").alias("unchanged")
    )


def rewritten(chunks: DataFrame, diff: DataFrame, fresh: DataFrame) -> DataFrame:
    """The chunk table after a run: chunks of changed and deleted files replaced by the fresh ones."""
    gone = diff.filter(F.col("state").isin("modified", "deleted", "added")).select(*KEY)
    return chunks.join(gone, KEY, "left_anti").unionByName(fresh)


def needs_rebuild(repos: DataFrame, version: str) -> DataFrame:
    """Repositories that another index version wrote, or none."""
    return repos.select("id", "index_version", (F.coalesce("index_version", F.lit("")) != version).alias("rebuild"))


def index_version(settings: dict[str, object]) -> str:
    """One string of everything that shapes the index."""
    return ";".join(f"{k}={settings[k]}" for k in sorted(settings))


def cached_contexts(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks with the description cached for their hash and model, ``''`` and ``hit`` false where there is none."""
    known = cache.groupBy("chunk_hash", "model").agg(F.max("context").alias("cached"))
    return chunks.join(known, ["chunk_hash", "model"], "left").withColumn("hit", F.col("cached").isNotNull()).withColumn("cached", F.coalesce("cached", F.lit("")))
