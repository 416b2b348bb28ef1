"""Cutting texts into retrieval units: character windows, Markdown sections, paragraphs and line windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import units

HEADING = r"^(#{1,6})[ \t]+(\S.*?)\s*$"


def character_windows(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """``id, start, chunk``: windows of ``size`` characters, each starting ``size - overlap`` further; empty texts have none."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text"), F.lit(1)) - 1, F.lit(size - overlap))
    return docs.filter("text is not null and text <> ''").select("id", "text", F.explode(starts).alias("start")).select("id", "start", F.substring("text", F.col("start") + 1, F.lit(size)).alias("chunk"))


def markdown_sections(docs: DataFrame) -> DataFrame:
    """``id, section, depth, heading, first_line, last_line``: one row per ATX heading and one for what stands before the first.

    Headings inside code fences count, as in the engine this follows. Only heading lines pass through the window, partitioned by document.
    """
    lines = docs.filter("text is not null").select("id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"), F.size(F.split("text", "\n", -1)).alias("n_lines"))
    heads = lines.filter(F.col("line").rlike(HEADING) | (F.col("at") == 0))
    w = Window.partitionBy("id").orderBy("at")
    return heads.select(
        "id", F.row_number().over(w).alias("section"), F.length(F.regexp_extract("line", HEADING, 1)).alias("depth"), F.regexp_extract("line", HEADING, 2).alias("heading"), (F.col("at") + 1).alias("first_line"),
        F.coalesce(F.lead("at").over(w), F.col("n_lines")).alias("last_line"),
    )


def section_trails(docs: DataFrame) -> DataFrame:
    """``id, first_line, trail``: each heading with those above it, outermost first, joined by `` > ``; one pass over a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, first, trail = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                path: list[str] = []
                for n, line in enumerate(text.split("\n"), 1):
                    m = units.HEADING.match(line) if line[:1] == "#" else None
                    if m:
                        del path[len(m[1]) - 1 :]
                        path.append(m[2])
                        rows.append(i)
                        first.append(n)
                        trail.append(" > ".join(path))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(first, pa.int32()), pa.array(trail, pa.string())], names=["id", "first_line", "trail"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.filter("text is not null").select("id", "text").mapInArrow(run, f"id {kind}, first_line int, trail string")


def _cut(docs: DataFrame, cut: Callable[[list[str]], Iterator[tuple[int, int]]]) -> DataFrame:
    """``id, part, first_line, last_line, chunk`` of the spans of lines that ``cut`` finds in each text that isn't blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, part, first, last, chunk = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                lines = text.split("\n")
                for n, (s, e) in enumerate(cut(lines)):
                    rows.append(i)
                    part.append(n)
                    first.append(s + 1)
                    last.append(e)
                    chunk.append("\n".join(lines[s:e]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(part, pa.int32()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(chunk, pa.string())], names=["id", "part", "first_line", "last_line", "chunk"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.filter(F.col("text").rlike(r"\S")).select("id", "text").mapInArrow(run, f"id {kind}, part int, first_line int, last_line int, chunk string")


def line_windows(docs: DataFrame, most: int = 2000) -> DataFrame:
    """``id, part, first_line, last_line, chunk``: whole lines up to ``most`` bytes, longer windows sharing three lines; a longer line stands alone."""
    return _cut(docs, lambda lines: ((w.first, w.end) for w in units.line_windows(lines, units.Piece(0, len(lines)), most)))


def paragraphs(docs: DataFrame, least: int = 200, most: int = 2000) -> DataFrame:
    """``id, part, first_line, last_line, chunk``: paragraphs packed up to ``most`` bytes; a longer one is cut at lines. Blank lines at the beginning belong to no chunk."""
    return _cut(docs, lambda lines: ((g[0].first, g[-1].end) for g, _, _ in units.packed(lines, units.paragraph_pieces(lines), most, least, True)))
