"""Most similar vectors for every vector (problem 5): a permutation index.

A vector is represented by its ``PREFIX`` nearest pivots in order and posted in the inverted
file of each. Every file is reranked whole: the exact cosine of all its rows with one another,
a matrix product, costs less than their footrule distances would, and a cut by footrule before
it loses neighbours (README). The k best of all files of a row remain.

Pivots come from a bounded sample of the rows (the lowest hashes of ids); there are ``sqrt(n / 2)``
of them, so that files grow with the square root of the number of rows, and the whole work with
its power 1.5. A pivot's nearness is its cosine less ``BALANCE`` times the cosine that the
sample's nearest rows exceed: pivots in the middle of a dense group would otherwise draw the
whole group. Files are thereby of like size; one of more than ``BLOCK_ROWS``, by the exact
counts of all rows, is compared in pairs of blocks, nothing left out. Equal vectors (by 128
bits of hash) are searched once and expanded afterwards.

Defined results: null and zero vectors, those with a null, NaN or infinite component
and those not of the usual length take no part; an id delivered again counts once (its
latest row); neighbours of equal cosine are taken by id, those at the last place in a fixed
order. Copies: of the vectors equal to one vector each is linked with the ``k`` next of them.
Empty tables give empty ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import cut_lineage, parallelism

#: Nearest pivots by which a vector is posted.
PREFIX = 8
#: Share of a pivot's usual nearness that is taken off.
BALANCE = 0.8
#: Rows of a file that one task compares at once; files beyond are compared in pairs of blocks.
BLOCK_ROWS = 100_000
#: Rows of a file that are compared with the others at once, and cosines held for it.
STRIP, CELLS = 512, 1 << 22
MAX_PIVOTS = 65_536
#: Rows that the index is fitted on: so many, or twice the pivots, so at most 131,072.
SAMPLE = 30_000
#: Rows of one shuffle partition of postings.
PARTITION_ROWS = 30_000
#: Equal vectors from which on the copies are matched through a broadcast; at most one in so many rows is such a vector.
HOT_COPIES = 20_000


def pivot_count(n: int) -> int:
    """Pivots for ``n`` different vectors."""
    return max(1, min(MAX_PIVOTS, math.isqrt(n // 2)))


def unit_vectors(rows: DataFrame, id_column: str, vector_column: str, latest: Column) -> DataFrame:
    """``id, vec``: the unit vector of each id as bytes of 4-byte floats."""
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 3e38)) & F.exists("v", lambda x: x != 0)
    rows = rows.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v"), latest.alias("at")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(sound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(1)
            ends = vectors.offsets.to_numpy()
            flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
            out = []
            for i in range(b.num_rows):
                v = flat[ends[i] : ends[i + 1]]
                v = v / np.abs(v).max()
                out.append((v / np.sqrt(v @ v)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), b.column(2)], names=["id", "vec", "at"])

    return rows.mapInArrow(run, "id string, vec binary, at string").groupBy("id").agg(F.max_by("vec", F.struct("at", "vec")).alias("vec"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, width)


class Index:
    """Pivots and what is taken off the cosines with each; fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, pivots: int) -> None:
        self.pivots = sample[:pivots]
        self.prefix = min(PREFIX, pivots)
        usual = max(1, len(sample) * self.prefix // pivots)
        parts = [np.partition(sample @ self.pivots[at : at + STRIP].T, len(sample) - usual, axis=0)[len(sample) - usual] for at in range(0, pivots, STRIP)]
        self.taken = BALANCE * np.concatenate(parts)

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """Numbers of the nearest pivots of each vector, the nearest first."""
        s = self.taken - vectors @ self.pivots.T
        near = np.argpartition(s, self.prefix - 1, axis=1)[:, : self.prefix]
        return np.take_along_axis(near, np.argsort(np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)


def ordered(groups: DataFrame, index: Index) -> DataFrame:
    """``id, n, vec, files``: each vector with its nearest pivots in order."""
    shared = groups.sparkSession.sparkContext.broadcast(index)  # at most MAX_PIVOTS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                order = ix.order(_matrix(b.column(2), ix.pivots.shape[1]))
                files = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, ix.prefix), pa.int32()), pa.array(order.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns, files], names=["id", "n", "vec", "files"])

    return groups.select("id", "n", "vec").mapInArrow(run, "id string, n bigint, vec binary, files array<int>")


def postings(rows: DataFrame, n: int) -> DataFrame:
    """``file, low, high, side, no, vec``: a row for each inverted file that holds the vector, or for each pair of blocks of a large one."""
    posted = rows.select(F.explode("files").alias("file"), "no", "vec")
    sizes = posted.groupBy("file").count().filter(F.col("count") > BLOCK_ROWS).select(F.col("file"), F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks"))
    if n * PREFIX <= BLOCK_ROWS or not sizes.head(1):
        zero = F.lit(0)
        out = posted.select("file", zero.alias("low"), zero.alias("high"), F.lit(0).cast("tinyint").alias("side"), "no", "vec")
    else:
        # one row for a pivot at most, so at most MAX_PIVOTS
        cut = posted.join(F.broadcast(sizes), "file", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int")
        each = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        out = each.select("file", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("tinyint").alias("side"), "no", "vec")
    parts = max(parallelism(rows.sparkSession), n * PREFIX // PARTITION_ROWS)
    return out.repartition(parts, "file", "low", "high").sortWithinPartitions("file", "low", "high", "side", "no")


def strongest(cosine: np.ndarray, k: int, least: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k greatest of each row that reach ``least`` (ties at the end may add to them), by rows."""
    m, g = cosine.shape
    bound = np.full(m, -1.5 if least is None else least, dtype=np.float32)
    full = np.arange(m) if least is None else np.flatnonzero(cosine.max(1) >= bound)
    part = cosine[full] if len(full) < m else cosine
    width = g // 32
    if len(full) and width >= 4 * k:
        # the k-th greatest of maxima of disjoint columns isn't above the k-th greatest of all
        heads = part[:, : 32 * width].reshape(len(full), 32, width).max(1)
        bound[full] = np.maximum(bound[full], np.partition(heads, width - k, axis=1)[:, width - k])
    elif len(full) and g > k:
        bound[full] = np.maximum(bound[full], np.partition(part, g - k, axis=1)[:, g - k])
    rows, columns = np.divmod(np.flatnonzero(part >= bound[full, None]), g)
    return full[rows], columns


def search_file(vectors: np.ndarray, others: np.ndarray | None, k: int, least: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For strips of rows their k best among the others (of the same file where None): row, place and cosine, by rows."""
    among = vectors if others is None else others
    strip = max(1, min(STRIP, CELLS // max(1, len(among))))
    for first in range(0, len(vectors) if len(among) > (others is None) else 0, strip):
        cosine = vectors[first : first + strip] @ among.T
        if others is None:
            own = np.arange(len(cosine))
            cosine[own, first + own] = -2
        rows, at = strongest(cosine, k, least)
        values = cosine[rows, at]
        by = np.lexsort((at, -values, rows))
        rows, at, values = rows[by], at[by], values[by]
        kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        yield first + rows[kept], at[kept], values[kept]


NEAR = "no bigint, near array<bigint>, cosines array<float>"


def _lists(rows: np.ndarray, near: np.ndarray, cosines: np.ndarray) -> pa.RecordBatch:
    """One row of ``NEAR`` for each run of equal numbers."""
    starts = np.flatnonzero(np.diff(rows, prepend=rows[0] - 1)) if len(rows) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(starts, len(rows)), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[starts], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(near, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(cosines, pa.float32()))], names=["no", "near", "cosines"]
    )


def file_neighbours(posted: DataFrame, dim: int, k: int, least: float | None) -> DataFrame:
    """The best neighbours of each row within each of its files; files stream through a task one by one."""

    def close(held: list[pa.RecordBatch], name: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
        numbers = np.concatenate([b.column(4).to_numpy() for b in held])
        vectors = np.concatenate([_matrix(b.column(5), dim) for b in held])
        cut = int(sum((b.column(3).to_numpy() == 0).sum() for b in held))
        whole = name[1] == name[2]
        for start, own, base, others in [(0, vectors, 0, None)] if whole else [(0, vectors[:cut], cut, vectors[cut:]), (cut, vectors[cut:], 0, vectors[:cut])]:
            for rows, at, cosine in search_file(own, others, k, least):
                if len(rows):
                    yield _lists(numbers[start + rows], numbers[base + at], cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in range(3)])
            ends = [*(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), b.num_rows]
            at = 0
            for end in ends:
                new = tuple(keys[:, at].tolist())
                if new != name and held:
                    yield from close(held, name)
                    held = []
                name = new
                held.append(b.slice(at, end - at))
                at = end
        if held:
            yield from close(held, name)

    return posted.select("file", "low", "high", "side", "no", "vec").mapInArrow(run, NEAR)


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of all files of each row; a neighbour met in several files counts once."""

    def best(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        lengths = np.concatenate([np.diff(b.column(1).offsets.to_numpy()) for b in held])
        rows = np.repeat(np.concatenate([b.column(0).to_numpy() for b in held]), lengths)
        near = np.concatenate([b.column(1).flatten().to_numpy() for b in held])
        cosines = np.concatenate([b.column(2).flatten().to_numpy() for b in held])
        by = np.lexsort((-cosines, near, rows))
        rows, near, cosines = rows[by], near[by], cosines[by]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (near[1:] != near[:-1])
        rows, near, cosines = rows[new], near[new], cosines[new]
        by = np.lexsort((near, -cosines, rows))
        rows, near, cosines = rows[by], near[by], cosines[by]
        kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        return _lists(rows[kept], near[kept], cosines[kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            # the last row's lists may go on in the next batch
            numbers = b.column(0).to_numpy()
            cut = int(np.searchsorted(numbers, numbers[-1]))
            if cut:
                yield best([*held, b.slice(0, cut)])
                held = []
            elif held and held[-1].column(0)[-1].as_py() != numbers[0]:
                yield best(held)
                held = []
            held.append(b.slice(cut))
        if held:
            yield best(held)

    return found.repartition("no").sortWithinPartitions("no").mapInArrow(run, NEAR)


def copies(units: DataFrame, groups: DataFrame) -> DataFrame:
    """``no, id, n``: every id whose vector others have too; vectors of very many copies don't meet in one task."""
    prints = [F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2")]
    several = groups.filter("n > 1").select("no", "n", *prints)
    each = units.select("id", *prints)
    hot = F.broadcast(several.filter(F.col("n") > HOT_COPIES))
    return each.join(hot, ["h1", "h2"]).unionByName(each.join(hot, ["h1", "h2"], "left_anti").join(several.filter(F.col("n") <= HOT_COPIES), ["h1", "h2"])).select("no", "id", "n")


def neighbours(
    rows: DataFrame, id_column: str = "id", vector_column: str = "dense", latest: Column | None = None, k: int = 10, least: float | None = None, checkpoint: bool = True
) -> DataFrame:
    """``id, neighbour, cosine``: the k most similar other ids of each, those of a cosine of at least ``least`` where given."""
    keep = cut_lineage if checkpoint else (lambda df: df)
    spark = rows.sparkSession
    units = keep(unit_vectors(rows, id_column, vector_column, F.coalesce(latest.cast("string") if latest is not None else F.lit(""), F.lit(""))))
    usual = units.groupBy(F.length("vec").alias("bytes")).count().orderBy(F.desc("count"), "bytes").limit(1).collect()
    if not usual:
        return spark.createDataFrame([], "id string, neighbour string, cosine double")
    dim, n = usual[0]["bytes"] // 4, usual[0]["count"]
    units = units.filter(F.length("vec") == 4 * dim)
    # the share of hashes that holds a little more than the sample is cut out first, so that no task sorts more than that
    size = max(SAMPLE, 2 * pivot_count(n))
    h = F.shiftrightunsigned(F.xxhash64("id"), 33)
    drawn = units.select("vec", h.alias("h"), "id").filter(F.col("h") < int(min(1.0, 1.2 * (size + 1000) / n) * 2**31))
    sample = drawn.orderBy("h", "id").limit(size).select("vec").toArrow().column("vec").to_pylist()
    different = list(dict.fromkeys(sample))
    index = Index(np.frombuffer(b"".join(different), dtype=np.float32).reshape(-1, dim), min(len(different), pivot_count(n * len(different) // len(sample))))

    # one row of each vector is searched; the others are told by its number
    each = units.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    # an odd number tells that other ids have the same vector
    number = F.monotonically_increasing_id() * 2 + F.when(F.col("n") > 1, 1).otherwise(0)
    groups = keep(ordered(each, index).withColumn("no", number))
    best = keep(merged(file_neighbours(postings(groups.select("no", "vec", "files"), n), dim, k, least), k))
    pairs = F.explode(F.arrays_zip("near", "cosines")).alias("x")
    other = [F.col("x.near").alias("other"), F.col("x.cosines").cast("double").alias("cosine")]
    copied = (F.col("no") % 2 == 1) | F.exists("near", lambda x: x % 2 == 1)
    links = best.filter(copied).select("no", pairs).select("no", *other)
    # a row without copies, its own or its neighbours', has its neighbours already
    single = groups.select("no", "id")
    plain = best.filter(~copied).join(single, "no").select("id", pairs).select("id", *other).join(single.select(F.col("no").alias("other"), F.col("id").alias("neighbour")), "other").select("id", "neighbour", "cosine")

    twins = keep(copies(units, groups))
    # the copies of one vector: each with the next k, in parts of bounded size
    parted = twins.withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / F.lit(1000))))
    ring = Window.partitionBy("no", "part").orderBy("id")
    after = [F.lead("id", i).over(ring) for i in range(1, k + 1)]
    equal = parted.select("id", F.array(*after).alias("after")).select("id", F.explode("after").alias("neighbour"), F.lit(1.0).alias("cosine")).filter("neighbour is not null")
    equal = equal.union(equal.select("neighbour", "id", "cosine"))

    # links between vectors hold for their copies: all of a group of up to k, the k least of a larger one
    first = twins.withColumn("r", F.row_number().over(Window.partitionBy("no").orderBy("id"))).filter(F.col("r") <= k).groupBy("no").agg(F.collect_list("id").alias("several"))
    named = groups.select("no", "id", "n").join(first, "no", "left").select("no", "n", F.coalesce("several", F.array("id")).alias("ids"))
    here = named.filter(F.col("n") <= k).select("no", F.col("ids").alias("mine"))
    there = named.select(F.col("no").alias("other"), F.col("ids").alias("theirs"))
    spread = links.join(here, "no").join(there, "other").select(F.explode("mine").alias("id"), "theirs", "cosine").select("id", F.explode("theirs").alias("neighbour"), "cosine")
    ranked = spread.union(equal).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")))
    return plain.union(ranked.filter(F.col("r") <= k).select("id", "neighbour", "cosine"))


def linked_pairs(near: DataFrame) -> DataFrame:
    """``id_a, id_b``: each pair once, the smaller id first."""
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def recall(rows: DataFrame, k: int = 10, every: int = 50) -> DataFrame:
    """``n_queries, found, wanted, recall``: of the ids whose hash ``every`` divides, how many of the k nearest (exact search, in blocks) the index finds.

    A neighbour of the same cosine (to six digits) as one of the nearest counts as that one.
    """
    from quillspark.operators.dense import dense_topk

    units = unit_vectors(rows, "id", "dense", F.coalesce("indexed_at", F.lit("")))
    asked = F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(every)) == 0
    latest = rows.filter("id is not null and dense is not null").groupBy("id").agg(F.max_by("dense", F.struct("indexed_at", "dense")).alias("vector")).join(units.select("id"), "id", "left_semi")
    exact = dense_topk(latest.filter(asked).select(F.col("id").alias("query_id"), "vector"), latest, k)
    worst = exact.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("wanted"))
    got = neighbours(rows, latest=F.col("indexed_at"), k=k).filter(asked).select(F.col("id").alias("query_id"), "cosine")
    hits = worst.join(got, "query_id", "left").groupBy("query_id", "wanted").agg(F.count_if(F.col("cosine") >= F.col("least") - 1e-6).alias("found"))
    return hits.agg(F.count("*").alias("n_queries"), F.sum("found").alias("found"), F.sum("wanted").alias("wanted")).withColumn("recall", F.round(F.col("found") / F.col("wanted"), 4))
