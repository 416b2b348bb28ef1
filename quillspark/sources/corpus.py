"""Reading corpora: files on disk with their guards, question files, content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.paths import indexable

MAX_BYTES, MAX_JSON_BYTES, PROBED = 512_000, 64_000, 8192


def source_files(spark: SparkSession, root: str, extra: list[str] | None = None) -> DataFrame:
    """``path, sha, text`` of the files below ``root`` that can be indexed.

    Left out by name before any content is read: ignored folders and names; by length: empty and oversized files; by
    content: NUL bytes at the beginning, invalid UTF-8, blank text.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    start = root.rstrip("/") + "/"
    path = F.expr(f"substring(path, instr(path, '{start}') + {len(start)})")
    named = raw.withColumn("path", path).filter(indexable(F.col("path"), extra)).filter((F.col("length") > 0) & (F.col("length") <= F.when(F.col("path").endswith(".json"), MAX_JSON_BYTES).otherwise(MAX_BYTES)))
    sound = named.filter((F.position(F.lit(b"\0"), F.substring("content", 1, PROBED)) == 0) & F.is_valid_utf8("content"))
    return sound.select("path", F.sha2("content", 256).alias("sha"), F.decode("content", "UTF-8").alias("text")).filter(F.col("text").rlike(r"\S"))


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """``q, expect, mode, kind`` of a JSON-lines file; blank lines and those that begin with ``#`` are skipped."""
    lines = spark.read.text(path).filter("trim(value) <> '' and not startswith(trim(value), '#')")
    c = lines.select(F.from_json("value", "q string, expect array<string>, mode string, kind string").alias("c")).select("c.*")
    expect = F.coalesce("expect", F.array().cast("array<string>"))
    return c.select("q", expect.alias("expect"), F.coalesce("mode", F.lit("all")).alias("mode"), F.coalesce("kind", F.when(F.size(expect) > 0, "prose").otherwise("negative")).alias("kind"))


def guarded_slice(files: DataFrame, manifest: DataFrame, requests: DataFrame, most: int = 400) -> DataFrame:
    """``repo_id, path, start, text, stale``: requested lines of files in the manifest; others have null text."""
    clean = F.regexp_replace(F.regexp_replace(F.trim("path"), "^/+", ""), r"(^|/)(\./)+", "$1")
    asked = requests.withColumn("path", clean)
    known = manifest.select("repo_id", "path", F.col("sha").alias("known_sha"))
    rows = asked.join(known, ["repo_id", "path"], "left").join(files.select("repo_id", "path", "sha", "text"), ["repo_id", "path"], "left")
    text = F.when(F.col("known_sha").isNotNull(), F.array_join(F.slice(F.split("text", "\n", -1), F.greatest(F.col("start"), F.lit(1)), F.least(F.col("count"), F.lit(most))), "\n"))
    return rows.select("repo_id", "path", "start", text.alias("text"), (F.col("sha") != F.col("known_sha")).alias("stale"))
