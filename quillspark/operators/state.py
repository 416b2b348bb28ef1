"""State tables without MERGE: append versions, read the latest, rewrite partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.incremental import latest


def upserted(table: DataFrame, rows: DataFrame, key: str, at: str) -> DataFrame:
    """The table with ``rows`` in place of those of the same key; of several the latest by ``at``."""
    return latest(table.unionByName(rows), [key], at)


def without(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Append to the chunk table, one folder per repository."""
    chunks.write.mode("append").partitionBy("repo_id").parquet(path)


def replace_repos(chunks: DataFrame, path: str) -> None:
    """Overwrite the folders of the repositories in ``chunks``, leaving all others."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(path)


def drop_repo(spark: SparkSession, path: str, repo_id: str) -> None:
    """Remove a repository's folder; dynamic overwrite can't, since an empty frame touches no folder."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/repo_id={repo_id}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def renamed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns of older tables under their names of today."""
    return rows.withColumnsRenamed({old: new for old, new in names.items() if old in rows.columns and new not in rows.columns})


def repo_totals(files: DataFrame) -> DataFrame:
    """``repo_id, file_count, chunk_count`` from the latest manifest rows."""
    last = latest(files, ["repo_id", "path"], "indexed_at")
    return last.groupBy("repo_id").agg(F.count("*").alias("file_count"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunk_count"))
