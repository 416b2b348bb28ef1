"""One object over an indexed corpus: search, files, repositories, jobs, synchronisation and evaluation as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import citation, search_mode
from quillspark.operators import answers, dense, evaluation, events, fusion, incremental, lexical, state
from quillspark.sources.corpus import guarded_slice


@dataclass(frozen=True)
class Settings:
    prose_mode: str = "dense"
    rrf_k: int = 60
    top_k: int = 8
    candidates: int = 40
    weak_dense_score: float = 0.55
    min_dense_score: float = 0.45
    index_version: str = "v8"

    def __post_init__(self) -> None:
        if self.min_dense_score > self.weak_dense_score:
            raise ValueError("min_dense_score must not exceed weak_dense_score")


class Engine:
    """``chunks`` is the table of chunk rows (deliveries of one id are told apart by ``indexed_at``).

    ``write_chunks`` of the table's last deliveries, bucketed by id, saves the searches that work. Requests are frames of
    ``query_id, query, vector`` and optionally ``mode``: one request is a frame of one row. The vector comes from whatever
    model the caller runs; without one only lexical search can be asked for.
    """

    COLUMNS = ["id", "indexed_at", "repo_id", "path", "ordinal", "symbol", "parent_symbol", "kind", "lang", "category", "start_line", "end_line", "content", "context", "indexed_text", "file_sha", "dense"]

    def __init__(self, spark: SparkSession, chunks: DataFrame, manifest: DataFrame | None = None, repos: DataFrame | None = None, settings: Settings = Settings()) -> None:
        self.spark, self.manifest, self.repos, self.settings = spark, manifest, repos, settings
        self.chunks = incremental.latest(chunks.filter("id is not null").select(*self.COLUMNS), ["id"], "indexed_at")

    def written(self, name: str, buckets: int | None = None) -> "Engine":
        """An engine on the deduplicated chunks, written once as the table ``name``, bucketed by id so that joins on it need no shuffle."""
        self.chunks.write.mode("overwrite").bucketBy(buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions")), "id").sortBy("id").saveAsTable(name)
        other = Engine.__new__(Engine)
        other.spark, other.manifest, other.repos, other.settings, other.chunks = self.spark, self.manifest, self.repos, self.settings, self.spark.table(name)
        return other

    def filtered(self, repo_ids: list[str] | None = None, path_prefix: str = "", lang: str = "", category: str = "") -> DataFrame:
        """Chunks that pass the scalar filters; an empty one passes all."""
        keep: Column = F.lit(True)
        if repo_ids:
            keep = keep & F.col("repo_id").isin(repo_ids)
        if path_prefix:
            keep = keep & F.col("path").startswith(path_prefix)
        if lang:
            keep = keep & (F.col("lang") == lang)
        if category:
            keep = keep & (F.col("category") == category)
        return self.chunks.filter(keep)

    def search(self, queries: DataFrame, rerank: Callable[[pd.Series, pd.Series], pd.Series] | None = None, **filters) -> DataFrame:
        """The hits of each query, by the mode it asks for or is routed to, with their chunks' columns, ``ref``, scores and ``weak``.

        The batch is split by mode before the channels run, so that no query pays for a channel it doesn't use. Hits
        below the floor are dropped after the cut, without a refill; lexical results have no floor.
        """
        s = self.settings
        pool = self.filtered(**filters)
        depth = max(s.candidates, s.top_k) if rerank else s.top_k
        asked = F.col("mode") if "mode" in queries.columns else F.lit("auto")
        routed = queries.withColumn("mode", search_mode(F.col("query"), asked, s.prose_mode))
        vectors = pool.filter("exists(dense, x -> x <> 0)").select("id", F.col("dense").alias("vector"))
        by_vector = dense.dense_topk(routed.filter("mode in ('dense', 'hybrid')").select("query_id", "vector"), vectors, depth)
        by_term = lexical.bm25_topk(routed.filter("mode in ('bm25', 'hybrid')").select("query_id", F.col("query").alias("text")), pool.select("id", F.col("indexed_text").alias("text")), depth)
        hits = fusion.fuse(by_vector, by_term, s.rrf_k, depth).join(routed.select("query_id", "mode", "query"), "query_id")
        named = hits.join(pool.drop("dense", "indexed_at", "indexed_text"), "id").withColumn("text", F.coalesce("content", F.lit("")))
        if rerank:
            named = fusion.rerank(named.withColumn("text", F.concat_ws("\n", "path", "text")), rerank, s.top_k)
        found = fusion.with_weak(fusion.floor(named, s.min_dense_score, F.col("mode")), s.weak_dense_score, F.col("mode"))
        scores = [F.round(c, 6).alias(c) for c in ("rrf", "dense", "bm25")]
        return found.select("query_id", "rank", "id", "repo_id", citation(F.col("path"), F.col("symbol")).alias("ref"), *scores, "weak", "text", *[c for c in self.COLUMNS if c in found.columns and c not in ("id", "repo_id", "dense")])

    def prompts(self, queries: DataFrame, hits: DataFrame) -> DataFrame:
        return answers.prompts(queries, hits)

    def ask(self, queries: DataFrame, model: Callable[[pd.Series], pd.Series], **filters) -> DataFrame:
        """Search, prompt and the answer of the model, a function on batches of prompts."""
        return answers.asked(queries, self.search(queries, **filters), model)

    def chunks_of(self, repo_id: str, path: str) -> DataFrame:
        return self.chunks.filter((F.col("repo_id") == repo_id) & (F.col("path") == path)).orderBy("ordinal")

    def read_slices(self, files: DataFrame, requests: DataFrame, most: int = 400) -> DataFrame:
        """Lines of files that the manifest knows."""
        return guarded_slice(files, incremental.latest(self.manifest, ["repo_id", "path"], "indexed_at"), requests, most)

    def sync(self, files: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The chunk table after a run over ``files`` (with ``sha``), and its counters; ``fresh`` are the chunks of all files."""
        diff = incremental.manifest_diff(files, incremental.latest(self.manifest, ["repo_id", "path"], "indexed_at"))
        changed = diff.filter("state in ('added', 'modified')").select("repo_id", "path")
        return incremental.rewritten(self.chunks, diff, fresh.join(changed, ["repo_id", "path"], "left_semi")), incremental.counters(diff)

    def without(self, repo_id: str) -> "Engine":
        """The engine after a repository's removal: its chunks, manifest rows and record are gone, descriptions stay cached."""
        keep = F.coalesce(F.col("repo_id"), F.lit("")) != repo_id
        other = Engine.__new__(Engine)
        other.spark, other.settings, other.chunks = self.spark, self.settings, self.chunks.filter(keep)
        other.manifest = self.manifest.filter(keep) if self.manifest is not None else None
        other.repos = self.repos.filter(F.col("id") != repo_id) if self.repos is not None else None
        return other

    def health(self) -> DataFrame:
        """One row: repositories, files and chunks."""
        files = incremental.latest(self.manifest, ["repo_id", "path"], "indexed_at").agg(F.count("*").alias("files"))
        return self.repos.agg(F.count("*").alias("repos")).join(files).join(self.chunks.agg(F.count("*").alias("chunks")))

    def totals(self) -> DataFrame:
        return state.repo_totals(self.manifest)

    def pending(self, pushes: DataFrame) -> DataFrame:
        return events.pending_jobs(pushes, self.repos)

    def evaluate(self, cases: DataFrame, hits: DataFrame, expected: DataFrame) -> DataFrame:
        """The report over cases (``query_id, kind, mode``), hits of ``search`` and what is expected (``path`` or ``path::symbol``)."""
        return evaluation.report(evaluation.scored_cases(cases, hits, expected))
