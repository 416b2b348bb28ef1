"""Exact dense search: a set of queries against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one pass over the corpus: their matrix is all that is broadcast. Queries that are multiplied at once.
BLOCK, STRIP = 65_536, 1024


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    n = np.sqrt((m * m).sum(1))
    return m / np.where(n == 0, 1, n)[:, None]


class _Best:
    """The k best rows so far of each query, ties by id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.bound = k, np.full(queries, -np.inf)
        self.query, self.id, self.score = np.zeros(0, np.int64), None, np.zeros(0)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        ids = ids if self.id is None else np.concatenate([self.id, ids])
        by = np.lexsort((ids, -np.round(score, 12), query))
        query = query[by]
        kept = by[np.arange(len(query)) - np.searchsorted(query, query) < self.k]
        query, self.id, self.score = query[np.arange(len(query)) - np.searchsorted(query, query) < self.k], ids[kept], score[kept]
        self.query = query
        last = np.flatnonzero(np.append(query[1:] != query[:-1], True)) if len(query) else np.zeros(0, np.int64)
        full = last[np.bincount(query, minlength=len(self.bound))[query[last]] == self.k]
        self.bound[query[full]] = self.score[full] - 1e-11

    def offer(self, which: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        """The cosines ``s`` of the queries ``which`` with the rows ``ids``; those that can't be among the best are left out first."""
        bound = self.bound[which]
        open_ = np.isneginf(bound)
        if open_.any() and s.shape[1] > self.k:
            bound[open_] = np.partition(s[open_], s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k] - 1e-11
        rows, columns = np.nonzero((s >= bound[:, None]) & np.isfinite(s))
        if len(rows):
            self.add(which[rows], ids[columns], s[rows, columns])


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = 8, same: str | None = None) -> DataFrame:
    """``query_id, id, rank, score``: the k rows of highest cosine for each query, itself left out, ties by id.

    ``queries`` has ``query_id, vector``, ``corpus`` ``id, vector``; ids are of any type that has an order; with ``same``
    both have that column and it must agree. Null and empty vectors take no part; all others must be of one length. Each
    task keeps its k best of every query before anything is shuffled.
    """
    spark = corpus.sparkSession
    columns = ["query_id", "vector", *([same] if same else [])]
    queries = queries.filter("size(vector) > 0 and query_id is not null").select(*columns)
    corpus = corpus.filter("size(vector) > 0 and id is not null").select("id", "vector", *([same] if same else []))
    asked, kind = queries.schema["query_id"].dataType.simpleString(), corpus.schema["id"].dataType.simpleString()
    schema = f"query_id {asked}, id {kind}, score double"
    count = queries.count()
    parts = -(-count // BLOCK)
    found = None
    for part in range(parts):
        block = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part) if parts > 1 else queries
        rows = block.orderBy("query_id").toArrow()
        if not rows.num_rows:
            continue
        first = rows.column("vector").combine_chunks()
        dim = len(first[0])
        groups: dict = {}
        if same:
            for i, g in enumerate(rows.column(same).to_pylist()):
                groups.setdefault(g, []).append(i)
        shared = spark.sparkContext.broadcast((rows.column("query_id").combine_chunks(), _matrix(first, dim), {g: np.array(i) for g, i in groups.items()}))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, dim=dim) -> Iterator[pa.RecordBatch]:
            names, q, groups = shared.value
            place: dict = {}
            for i, name in enumerate(names.to_pylist()):
                place.setdefault(name, []).append(i)
            best = _Best(len(names), k)
            all_queries = np.arange(len(names))
            ids_type = None
            for b in batches:
                if not b.num_rows:
                    continue
                ids_type = b.column(0).type
                listed = b.column(0).to_pylist()
                ids, x = np.array(listed), _matrix(b.column(1), dim)
                own = [(i, r) for r, name in enumerate(listed) if name in place for i in place[name]]
                by_group: dict = {None: np.arange(len(ids))}
                if same:
                    values = b.column(2).to_pylist()
                    by_group = {}
                    for r, g in enumerate(values):
                        if g in groups:
                            by_group.setdefault(g, []).append(r)
                for g, rows in by_group.items():
                    rows, which = np.asarray(rows), groups[g] if same else all_queries
                    at = dict(zip(rows.tolist(), range(len(rows))))
                    for start in range(0, len(which), STRIP):
                        some = which[start : start + STRIP]
                        s = q[some] @ x[rows].T
                        spot = dict(zip(some.tolist(), range(len(some))))
                        for i, r in own:
                            if i in spot and r in at:
                                s[spot[i], at[r]] = -np.inf
                        best.offer(some, ids[rows], s)
            if len(best.query):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(best.query)), pa.array(best.id.tolist(), ids_type), pa.array(best.score)], names=["query_id", "id", "score"])

        got = corpus.mapInArrow(run, schema)
        found = got if found is None else found.union(got)
    if found is None:
        return spark.createDataFrame([], f"query_id {asked}, id {kind}, rank int, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "id", "rank", "score")
