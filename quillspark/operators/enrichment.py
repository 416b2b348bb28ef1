"""Descriptions of chunks by a model that the caller brings: cache look-up, prompts for what is missing, answers parsed and counted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Chunks of one prompt, and characters of the file shown beside them.
BATCH, CONTEXT = 6, 8000
ANSWER = "chunks array<struct<n:string,description:string>>"


def chunk_hash(header: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\n", header, text), 256)


def usable(description: Column) -> Column:
    """At least 20 characters, and none of a script that small models drift into."""
    t = F.trim(description)
    return (F.length(t) >= 20) & ~t.rlike("[\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7a3\u0400-\u04ff]")


def parsed(answer: Column) -> Column:
    """``n`` and ``description`` of the first JSON object in a model's answer; anything else gives an empty list."""
    found = F.from_json(F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)(\{.*\})", 1), ANSWER)["chunks"]
    numbered = F.transform(found, lambda x: F.struct(x.n.try_cast("int").alias("n"), x.description.alias("description")))
    return F.coalesce(F.filter(numbered, lambda x: x.n.isNotNull()), F.array().cast("array<struct<n:int,description:string>>"))


def described(units: DataFrame, files: DataFrame, cache: DataFrame, key: str, model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """``repo_id, path, ordinal, chunk_hash, description, status`` of each unit (as ``chunk_files`` gives them).

    ``cache`` has ``chunk_hash, model, context``; ``key`` names model and language. Misses are asked for in batches of
    ``BATCH`` chunks of a file with the file's beginning; ``model`` maps prompts to answers on Arrow batches. ``status`` is
    ``cached``, ``generated``, ``rejected`` (not usable) or ``failed``; only generated ones belong into the cache.
    """
    u = units.select("repo_id", "path", "ordinal", "text", chunk_hash(F.col("header"), F.col("text")).alias("chunk_hash"))
    known = cache.filter(F.col("model") == key).groupBy("chunk_hash").agg(F.max("context").alias("known"))
    u = u.join(known, "chunk_hash", "left")
    place = F.row_number().over(Window.partitionBy("repo_id", "path").orderBy("ordinal")) - 1
    missing = u.filter("known is null").withColumn("place", place).withColumn("batch", F.floor(F.col("place") / BATCH)).withColumn("n", (F.col("place") % BATCH + 1).cast("int"))
    part = F.concat(F.lit("### Chunk "), F.col("n").cast("string"), F.lit("\n"), F.col("text"))
    batches = missing.groupBy("repo_id", "path", "batch").agg(F.array_sort(F.collect_list(F.struct("n", part.alias("t")))).alias("parts"))
    shown = batches.join(files.select("repo_id", "path", F.substring("text", 1, CONTEXT).alias("head")), ["repo_id", "path"], "left")
    prompt = F.concat(F.lit("File: "), F.col("path"), F.lit("\n\n```\n"), F.coalesce("head", F.lit("")), F.lit("\n```\n\nNumbered chunks:\n\n"), F.array_join(F.transform("parts", lambda p: p.t), "\n\n"))
    asked = shown.select("repo_id", "path", "batch", F.pandas_udf(model, "string")(prompt).alias("answer"))
    answers = asked.select("repo_id", "path", "batch", F.explode(parsed(F.col("answer"))).alias("a")).groupBy("repo_id", "path", "batch", F.col("a.n").alias("n")).agg(F.max("a.description").alias("said"))
    fresh = missing.join(answers, ["repo_id", "path", "batch", "n"], "left")
    said = F.trim(F.coalesce("said", F.lit("")))
    status = F.when(said == "", "failed").when(usable(said), "generated").otherwise("rejected")
    new = fresh.select("repo_id", "path", "ordinal", "chunk_hash", F.when(status == "generated", said).otherwise("").alias("description"), status.alias("status"))
    return new.unionByName(u.filter("known is not null").select("repo_id", "path", "ordinal", "chunk_hash", F.col("known").alias("description"), F.lit("cached").alias("status")))


def counters(rows: DataFrame) -> DataFrame:
    """One row: ``generated, cached, rejected, failures``."""
    return rows.agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("generated", "generated"), ("cached", "cached"), ("rejected", "rejected"), ("failed", "failures"))])


def embedded(rows: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], out: str = "dense") -> DataFrame:
    """The rows with unit vectors of their texts; ``load`` makes the embedder, once for each worker's stream of batches."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        embedder = load()
        for texts in batches:
            v = np.asarray(embedder(texts.fillna("").tolist()), dtype=np.float64)
            n = np.sqrt((v * v).sum(1, keepdims=True)) if len(v) else np.ones((0, 1))
            yield pd.Series(list((v / np.where(n == 0, 1, n)).astype(np.float32)) if len(v) else [])

    return rows.withColumn(out, encode(F.col(text)))
