"""Splitting of oversized items at natural boundaries (problem 4).

The text is seen as atoms: its lines, and where a line alone exceeds the limit, the
words (or short runs) of that line. Every border between atoms has a strength. A
sparse table answers "strongest border in this range, the rightmost of equals" in
constant time; from the start of a piece the range is what keeps the piece between
``min_bytes`` and ``max_bytes``. The next piece starts ``overlap_lines`` whole lines
before the cut where these fit.

Defined results: rows of null content or of a category without limits aren't
oversized; the same id delivered again counts once (the latest ``indexed_at``);
empty tables give empty tables; other columns are ignored. A character is never cut,
a line only where it alone exceeds the limit, and then its pieces share no line text.
A null ``start_line`` counts as 1; a limit below 4 bytes, which no
character may fit, isn't one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_DECLARES = re.compile(
    r"\s*(?:#{1,6}\s|@\w|//|/\*|#\s|\"\"\"|export\b|import\b|def\b|async\b|class\b|func\b|function\b|type\b|interface\b|enum\b"
    r"|public\b|private\b|protected\b|static\b|package\b|create\b|CREATE\b|alter\b|ALTER\b|- |\* |\d+\. )"
)
_CONTINUES = re.compile(r"\s*(?:[)\]}]|else\b|elif\b|except\b|finally\b|catch\b|case\b|\.|\+|\|\||&&|\?|:)")
_CLOSES = re.compile(r"\s*[)\]}]+[;,]?\s*$")
_WORDS = re.compile(r"\S+\s*|\s+")
#: Characters of a run without white space that stay together, at most.
RUN = 32


def line_strength(before: str, after: str) -> float:
    """Strength of the border between two lines: blank lines, outer levels and new declarations attract the cut."""
    if not after.strip():
        return 0.0
    lead = after[: len(after) - len(after.lstrip())].expandtabs(4)
    s = 20.0 - min(len(lead), 60) / 4
    if not before.strip():
        s += 6
    elif _CLOSES.match(before):
        s += 2
    elif before.rstrip()[-1] in ".!?。;":
        s += 1
    if _CONTINUES.match(after):
        s -= 4
    elif _DECLARES.match(after):
        s += 4
    return max(s, 0.5)


def sparse_table(strength: np.ndarray) -> list[np.ndarray]:
    """Level k holds, for each position, the place of the maximum of the next 2**k values, the rightmost of equals."""
    levels = [np.arange(len(strength))]
    width = 1
    while 2 * width <= len(strength):
        last = levels[-1]
        left, right = last[: len(last) - width], last[width:]
        levels.append(np.where(strength[right] >= strength[left], right, left))
        width *= 2
    return levels


def strongest(levels: list[np.ndarray], strength: np.ndarray, low: int, high: int) -> int:
    """Place of the greatest strength in ``low..high`` (both included), the rightmost of equals."""
    k = (high - low + 1).bit_length() - 1
    a, b = levels[k][low], levels[k][high - (1 << k) + 1]
    if strength[a] == strength[b]:
        return int(max(a, b))
    return int(a if strength[a] > strength[b] else b)


def atoms_of(text: str, max_bytes: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Atoms, the line (from 0) of each, and the strength of the border before each."""
    atoms, lines, strength = [], [], []
    rows = text.split("\n")
    run = max(1, min(RUN, max_bytes // 4))
    for n, row in enumerate(rows):
        whole = row + "\n" if n + 1 < len(rows) else row
        before = line_strength(rows[n - 1], row) if n else 0.0
        if len(row.encode()) <= max_bytes:
            atoms.append(whole)
            lines.append(n)
            strength.append(before)
            continue
        for word in _WORDS.findall(whole):
            for at in range(0, len(word), run):
                atoms.append(word[at : at + run])
                lines.append(n)
                prior = atoms[-2][-1:] if len(atoms) > 1 and lines[-2] == n else ""
                strength.append(before if not prior else -10.0 if prior.isspace() else -15.0 if prior in ",;)]}>" else -20.0)
    return atoms, np.array(lines), np.array(strength)


def split_text(text: str, max_bytes: int, min_bytes: int = 0, overlap_lines: int = 0) -> list[tuple[int, int, int, str]]:
    """Pieces as (first line, last line, lines shared with the piece before, text), lines counted from 0."""
    atoms, line, strength = atoms_of(text, max_bytes)
    n = len(atoms)
    end = np.concatenate([[0], np.cumsum([len(a.encode()) for a in atoms])])
    #: bytes of a piece that ends before atom c, without its last line break
    shut = end.copy()
    shut[1:] -= np.array([a.endswith("\n") for a in atoms], dtype=end.dtype)
    first = np.concatenate([[True], line[1:] != line[:-1]])
    levels = sparse_table(strength)
    out, start, cut, shared = [], 0, 0, 0
    while True:
        if shut[n] - end[start] <= max_bytes:
            out.append((int(line[start]), int(line[-1]), shared, "".join(atoms[start:])))
            return out
        # an atom is at most max_bytes long, so a border beyond ``cut`` is always in reach
        high = int(np.searchsorted(shut, end[start] + max_bytes, side="right")) - 1
        high = max(min(high, n - 1), cut + 1)
        low = min(max(int(np.searchsorted(shut, end[start] + min_bytes, side="left")), cut + 1), high)
        new = strongest(levels, strength, low, high)
        piece = "".join(atoms[start:new])
        out.append((int(line[start]), int(line[new - 1]), shared, piece[:-1] if piece.endswith("\n") else piece))
        back, shared = new, 0
        if first[new]:
            for k in range(1, overlap_lines + 1):
                s = int(np.searchsorted(line, line[new] - k, side="left"))
                if s <= start or line[s] != line[new] - k or shut[new + 1] - end[s] > max_bytes or (new - s) != k:
                    break
                back, shared = s, k
        start, cut = back, new


def oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows above the limit of their category, each id once, with the limits beside them."""
    limits = limits.filter("max_bytes >= 4 and category is not null").groupBy("category").agg(
        F.min("max_bytes").alias("max_bytes"), F.coalesce(F.min("min_bytes"), F.lit(0)).alias("min_bytes"), F.coalesce(F.min("overlap_lines"), F.lit(0)).alias("overlap_lines")
    )
    rows = chunks.select("id", "category", "start_line", "content", "indexed_at").filter("id is not null and content is not null")
    large = rows.join(limits, "category").filter(F.octet_length("content") > F.col("max_bytes"))
    latest = large.groupBy("id").agg(F.max_by(F.struct("start_line", "content", "max_bytes", "min_bytes", "overlap_lines"), F.struct(F.coalesce("indexed_at", F.lit("")), "content")).alias("r"))
    return latest.select("id", "r.*")


def split_oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """``id, piece, start_line, end_line, shared_lines, content`` of every oversized chunk; pieces count from 0.

    A ``min_bytes`` above half of ``max_bytes`` counts as that half, so that a window of permitted lengths always exists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for r in batch.to_pylist():
                base = 1 if r["start_line"] is None else r["start_line"]
                for k, (a, b, shared, text) in enumerate(split_text(r["content"], r["max_bytes"], min(r["min_bytes"], r["max_bytes"] // 2), r["overlap_lines"])):
                    for column, value in zip(out, (r["id"], k, base + a, base + b, shared, text)):
                        column.append(value)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["id", "piece", "start_line", "end_line", "shared_lines", "content"])

    return oversized(chunks, limits).mapInArrow(run, "id string, piece int, start_line int, end_line int, shared_lines int, content string")


def coverage(pieces: DataFrame, limits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``id, first_line, last_line, too_long, gaps``: lines that the pieces of a chunk reach over, pieces above the limit, and lines between neighbours that none holds."""
    limit = oversized(chunks, limits).select("id", "max_bytes")
    before = F.lag("end_line").over(Window.partitionBy("id").orderBy("piece"))
    rows = pieces.join(limit, "id").withColumn("gap", F.coalesce(F.col("start_line") > before + 1, F.lit(False)))
    return rows.groupBy("id").agg(F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"), F.count_if(F.octet_length("content") > F.col("max_bytes")).alias("too_long"), F.count_if("gap").alias("gaps"))
