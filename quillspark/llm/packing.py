"""Filling containers of fixed capacity with whole documents (problem 7).

Every document gets its number of tokens and a place on a Hilbert curve: its bag of
hashed pre-tokens, projected to ``DIMS`` dimensions and quantised. Items are range-sorted
along the curve; each task packs successive blocks of neighbours (``block_of``), the longest
first into the fullest container that still holds it, and hands the worse filled
containers' items on to the next block.

A text above the capacity is cut into parts of exactly the capacity and a rest; the rest
is packed like any other item.

Defined results: null and empty texts aren't placed; a text of white space is; rows of
the same id are items of their own; windows of null name or of a capacity below 1 are left
out; empty tables give empty ones; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.tokenizer import TOKENIZER_DIR, encoder
from quillspark.session import cut_lineage

BUCKETS, DIMS, BITS = 4096, 4, 8
#: Items that are packed together: a run of so many tokens of small containers' items, within these bounds. Shorter runs hold
#: neighbours closer together, longer ones leave less space unused.
RUN_TOKENS, LEAST_BLOCK, BLOCK = 2_000_000, 1000, 4000
#: Containers filled less than this are emptied again into the next block.
GOOD_FILL = 0.98


def projection() -> np.ndarray:
    """Fixed random directions of the hash buckets."""
    return np.random.default_rng(20).standard_normal((BUCKETS, DIMS))


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of cells (n x dims of whole numbers below 2**bits), by Skilling's transposed form."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def placed(docs: DataFrame, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``doc_id, n_tokens, place`` of each document that isn't empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, directions = encoder(folder), projection()
        number: dict[str, int] = {}
        sizes, moves = [], []
        table = (np.zeros(0, np.int64), np.zeros((0, DIMS)))
        for b in batches:
            counts, cells = [], np.zeros((b.num_rows, DIMS))
            for i, text in enumerate(b.column(1).to_pylist()):
                tokens = e.split(text)
                new = {t for t in tokens if t not in number}
                if new:
                    e.learn(new)
                    for t in new:
                        number[t] = len(sizes)
                        sizes.append(len(e.known[t]))
                        moves.append(directions[zlib.crc32(t.strip().lower().encode("utf-8", "surrogatepass")) % BUCKETS])
                    if len(sizes) > len(table[0]):
                        grown = max(len(sizes), 2 * len(table[0]), 4096)
                        table = (np.zeros(grown, np.int64), np.zeros((grown, DIMS)))
                        table[0][: len(sizes)], table[1][: len(sizes)] = sizes, moves
                    else:
                        table[0][len(sizes) - len(new) : len(sizes)] = sizes[-len(new) :]
                        table[1][len(sizes) - len(new) : len(sizes)] = moves[-len(new) :]
                at = np.array([number[t] for t in tokens])
                counts.append(int(table[0][at].sum()))
                cells[i] = table[1][at].mean(0)
            e.tidy()
            if len(number) > 200_000:
                number.clear()
                sizes, moves = [], []
            keys = hilbert_key(((np.tanh(3 * cells) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.int64())], names=["doc_id", "n_tokens", "place"])

    return docs.select("doc_id", "text").filter("text is not null and text <> ''").mapInArrow(run, "doc_id bigint, n_tokens bigint, place bigint")


def pack_block(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of item numbers: longest item first, into the container it fills best."""
    free: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(free, (sizes[i], -1))
        if at < len(free):
            left, k = free.pop(at)
        else:
            left, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        if left > sizes[i]:
            insort(free, (left - sizes[i], k))
    return bins


def block_of(capacity: int) -> int:
    """Neighbours along the curve that are packed together for containers of a capacity."""
    return max(LEAST_BLOCK, min(BLOCK, RUN_TOKENS // capacity))


def pack(docs: DataFrame, windows: DataFrame, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``window_name, container, doc_id, part, first_token, n_tokens``: where each item lies."""
    sized = cut_lineage(placed(docs, folder))
    kinds = [(r["window_name"], r["capacity_tokens"]) for r in windows.filter("window_name is not null and capacity_tokens >= 1").groupBy("window_name").agg(F.min("capacity_tokens").alias("capacity_tokens")).orderBy("window_name").collect()]
    schema = "window_name string, container string, doc_id bigint, part int, first_token bigint, n_tokens bigint"
    if not kinds:
        return sized.sparkSession.createDataFrame([], schema)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(capacity).cast("bigint").alias("capacity")) for name, capacity in kinds]))
    items = sized.select("*", each.alias("w")).select("w.name", "w.capacity", "place", "doc_id", "n_tokens")
    ordered = items.repartitionByRange("name", "place", "doc_id", "n_tokens").sortWithinPartitions("name", "place", "doc_id", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        part_no = pyspark.TaskContext.get().partitionId()
        made = 0
        name, capacity = None, 0
        waiting: list[tuple[int, int, int, int]] = []  # doc_id, part, first token, tokens
        out: list[tuple] = []

        def close(rest: bool) -> None:
            nonlocal made, waiting
            if not waiting:
                return
            again = []
            for members in pack_block([w[3] for w in waiting], capacity):
                if not rest and sum(waiting[i][3] for i in members) < GOOD_FILL * capacity:
                    again += [waiting[i] for i in sorted(members)]
                    continue
                out.extend((name, f"{name}-{part_no}-{made}", *waiting[i]) for i in members)
                made += 1
            # what can't be filled well is let go before it fills the block
            waiting = again
            if len(waiting) > block_of(capacity) // 2:
                close(True)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 6
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["window_name", "container", "doc_id", "part", "first_token", "n_tokens"])
            out.clear()
            return done

        for b in batches:
            for r_name, r_capacity, doc, n in zip(*(b.column(c).to_pylist() for c in (0, 1, 3, 4))):
                if r_name != name:
                    close(True)
                    name, capacity = r_name, r_capacity
                first = part = 0
                while n - first > capacity:
                    out.append((name, f"{name}-{part_no}-{made}", doc, part, first, capacity))
                    made += 1
                    part += 1
                    first += capacity
                waiting.append((doc, part, first, n - first))
                if len(waiting) >= block_of(capacity):
                    close(False)
            if len(out) > 5000:
                yield flush()
        if waiting:
            close(True)
        yield flush()

    return ordered.mapInArrow(run, schema)


def fill(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """``window_name, containers, items, tokens, unused_share`` of each window."""
    by = packed.groupBy("window_name").agg(F.countDistinct("container").alias("containers"), F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
    capacity = windows.groupBy("window_name").agg(F.min("capacity_tokens").alias("capacity_tokens"))
    return by.join(capacity, "window_name").select("window_name", "containers", "items", "tokens", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4).alias("unused_share"))


def validity(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """``window_name, n_docs, too_full, torn``: documents placed, containers above the capacity, and documents in several parts that one container could have held or whose parts don't join."""
    capacity = windows.groupBy("window_name").agg(F.min("capacity_tokens").alias("capacity_tokens"))
    full = packed.groupBy("window_name", "container").agg(F.sum("n_tokens").alias("n")).join(capacity, "window_name").groupBy("window_name").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("too_full"))
    parts = packed.groupBy("window_name", "doc_id").agg(F.count("*").alias("parts"), F.countDistinct("part").alias("numbers"), F.max("part").alias("last"), F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end")).join(capacity, "window_name")
    torn = (F.col("parts") > 1) & (F.col("n") <= F.col("capacity_tokens")) | (F.col("numbers") != F.col("parts")) | (F.col("last") != F.col("parts") - 1) | (F.col("end") != F.col("n"))
    return parts.groupBy("window_name").agg(F.count("*").alias("n_docs"), F.count_if(torn).alias("torn")).join(full, "window_name").select("window_name", "n_docs", "too_full", "torn")
