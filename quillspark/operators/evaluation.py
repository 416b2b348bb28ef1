"""Evaluation of retrieval against expected results: recall, reciprocal rank, abstention, calibration, latencies.

``cases`` has ``query_id, kind, mode`` (``all`` or ``any``), ``expected`` ``query_id, expect`` (``path`` or ``path::symbol``),
``hits`` ``query_id, rank, path, symbol, parent_symbol, dense, weak``. A case of which nothing is expected is negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wanted_path(expect: Column) -> Column:
    return F.substring_index(expect, "::", 1)


def wanted_symbol(expect: Column) -> Column:
    """What follows the first ``::``, null where there is none."""
    return F.when(F.contains(expect, F.lit("::")), F.expr("substring(expect, instr(expect, '::') + 2)"))


def symbol_matches(wanted: Column, symbol: Column, parent: Column) -> Column:
    """The symbol itself, the one that contains it, or a container's last name; a path alone matches any symbol."""
    parent = F.coalesce(parent, F.lit(""))
    return wanted.isNull() | (F.coalesce(symbol, F.lit("")) == wanted) | (parent == wanted) | F.endswith(parent, F.concat(F.lit("."), wanted))


def found_at(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """``query_id, expect, rank``: the first hit that each expectation matches."""
    e = expected.select("query_id", "expect").distinct().select("query_id", "expect", wanted_path(F.col("expect")).alias("path"), wanted_symbol(F.col("expect")).alias("wanted"))
    both = hits.select("query_id", "rank", "path", "symbol", "parent_symbol").join(e, ["query_id", "path"])
    return both.filter(symbol_matches(F.col("wanted"), F.col("symbol"), F.col("parent_symbol"))).groupBy("query_id", "expect").agg(F.min("rank").alias("rank"))


def scored_cases(cases: DataFrame, hits: DataFrame, expected: DataFrame) -> DataFrame:
    """``query_id, kind, negative, recall, rr, found, weak, abstained, top_dense`` of each case.

    A case abstains where no hit came or the match is weak; a negative's recall is 1 if it abstains, its reciprocal rank 0.
    """
    need = expected.groupBy("query_id").agg(F.countDistinct("expect").alias("need"))
    got = found_at(hits, expected).groupBy("query_id").agg(F.count("*").alias("found"), F.min("rank").alias("first"))
    best = hits.groupBy("query_id").agg(F.max("dense").alias("top_dense"), F.count("*").alias("n_hits"), F.max("weak").alias("weak"))
    rows = cases.join(need, "query_id", "left").join(got, "query_id", "left").join(best, "query_id", "left").fillna(0, ["need", "found", "n_hits"]).fillna(False, ["weak"])
    negative, abstained = F.col("need") == 0, (F.col("n_hits") == 0) | F.col("weak")
    asked = F.when(F.col("mode") == "any", 1).otherwise(F.col("need"))
    recall = F.when(negative, abstained.cast("double")).otherwise(F.least("found", asked) / asked)
    return rows.select(
        "query_id", "kind", negative.alias("negative"), recall.alias("recall"), F.when(negative, 0.0).otherwise(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("rr"), "found", "weak", abstained.alias("abstained"), "top_dense"
    )


def by_kind(cases: DataFrame) -> DataFrame:
    """``kind, n, recall, mrr, abstain``: kinds of negatives alone have a rate of abstention, all others recall and mean reciprocal rank."""
    only = F.min("negative")
    return cases.groupBy("kind").agg(
        F.count("*").alias("n"), F.when(~only, F.round(F.avg("recall"), 6)).alias("recall"), F.when(~only, F.round(F.avg("rr"), 6)).alias("mrr"), F.when(only, F.round(F.avg(F.col("abstained").cast("double")), 6)).alias("abstain")
    )


def report(cases: DataFrame) -> DataFrame:
    """One row: ``n, recall, mrr`` (over positives), ``abstain_rate`` (over negatives), ``false_weak_rate`` (over positives), ``misses``."""
    positive = lambda c: F.avg(F.when(~F.col("negative"), c))
    return cases.agg(
        F.count("*").alias("n"), F.round(F.coalesce(positive(F.col("recall")), F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(positive(F.col("rr")), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.avg(F.when(F.col("negative"), F.col("abstained").cast("double"))), 6).alias("abstain_rate"),
        F.round(F.coalesce(positive(F.col("weak").cast("double")), F.lit(0.0)), 6).alias("false_weak_rate"), F.count_if(F.col("recall") < 1).alias("misses"),
    )


def calibration(cases: DataFrame) -> DataFrame:
    """Least and median best score of positives found in full, greatest and median of negatives."""
    found, junk = ~F.col("negative") & (F.col("recall") >= 1), F.col("negative")
    return cases.filter("top_dense is not null").agg(
        F.round(F.min(F.when(found, F.col("top_dense"))), 3).alias("found_min"), F.round(F.median(F.when(found, F.col("top_dense"))), 3).alias("found_median"),
        F.round(F.max(F.when(junk, F.col("top_dense"))), 3).alias("negative_max"), F.round(F.median(F.when(junk, F.col("top_dense"))), 3).alias("negative_median"),
    )


def misses(cases: DataFrame, hits: DataFrame, most: int = 5) -> DataFrame:
    """``query_id, kind, top``: cases not found in full, each with the citations of its first hits in order."""
    ref = F.when(F.coalesce("symbol", F.lit("")) != "", F.concat_ws("::", "path", "symbol")).otherwise(F.col("path"))
    top = hits.filter(F.col("rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", ref.alias("ref")))).alias("top"))
    lost = cases.filter("recall < 1").select("query_id", "kind")
    return lost.join(top, "query_id", "left").select("query_id", "kind", F.coalesce(F.transform("top", lambda x: x.ref), F.array().cast("array<string>")).alias("top"))


def nearest_percentiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """``by, n, p50, p95``: by the nearest place in order, not interpolated.

    The places come from counts of the distinct values, so no group is collected.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by).orderBy(value)
    upto = counted.withColumn("hi", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    at50, at95 = F.floor(F.col("n") / 2), F.least(F.col("n") - 1, F.floor(F.col("n") * 95 / 100))
    inside = lambda at: (at >= F.col("hi") - F.col("c")) & (at < F.col("hi"))
    return upto.groupBy(by).agg(F.max("n").alias("n"), F.max(F.when(inside(at50), F.col(value))).alias("p50"), F.max(F.when(inside(at95), F.col(value))).alias("p95"))


def save(result: DataFrame, folder: str, tag: str, at: str) -> str:
    """Write a report as JSON lines into a folder of its own, named by time (``2025-01-31_1200``) and tag; returns its path."""
    path = f"{folder.rstrip('/')}/{at}_{tag}.json"
    result.write.mode("error").json(path)
    return path
