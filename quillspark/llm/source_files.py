"""Source files that do not parse (problem 1), and the putting together of files from their chunks.

Each file's chunks are brought together by (repo, path), laid out by line number, cut into
tokens and run through the table-driven parser of its extension's language; the result
names the first token that no continuation can make valid.

Defined results: chunks of null content, repo or path take no part; the same chunk
delivered again counts once; where chunks share lines the later one holds; lines that no
chunk covers are blank; a chunk without a line number follows the one before. Extensions
count in any case. Files of other extensions don't appear. An empty text (blank lines) is
valid but for JSON. Empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.syntax.check import LANGUAGES, first_error


def extension(path: str | Column = "path") -> Column:
    """Lower-case extension of a path, with its dot."""
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def gathered(chunks: DataFrame, *also: Column) -> DataFrame:
    """``repo_id, path, parts`` and ``also``: the distinct chunks of each file (a file is as long as its longest delivery)."""
    rows = chunks.filter("repo_id is not null and path is not null and content is not null")
    part = F.struct(F.coalesce("start_line", F.lit(0)).alias("s"), F.coalesce("ordinal", F.lit(0)).alias("o"), F.col("content").alias("c"))
    return rows.groupBy("repo_id", "path").agg(F.collect_set(part).alias("parts"), *also)


def file_text(parts: list[dict]) -> str:
    """The text of a file from its chunks (``s`` first line, ``o`` ordinal, ``c`` content)."""
    lines: list[str] = []
    for p in sorted(parts, key=lambda p: (p["s"] or p["o"], p["o"], p["c"])):
        at = p["s"] - 1 if p["s"] > 0 else len(lines)
        if at > len(lines):
            lines += [""] * (at - len(lines))
        new = p["c"].split("\n")
        lines[at : at + len(new)] = new
    return "\n".join(lines)


def syntax_errors(chunks: DataFrame) -> DataFrame:
    """``repo_id, path, lang, valid, error_line, error_token`` of each file of a known extension."""
    own = F.lower(F.trim(F.col("lang")))
    known = chunks.filter(extension().isin(list(LANGUAGES)))
    # the longest spelling, so that abbreviations and missing values don't hide the language
    files = gathered(known, F.max_by(own, F.struct(F.length(own), own)).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            valid, line, token, langs = [], [], [], []
            for path, lang, parts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                language = LANGUAGES[path[path.rindex(".") :].lower()]
                e = first_error(file_text(parts), language)
                valid.append(e is None)
                line.append(e and e[0])
                token.append(e and e[1])
                langs.append(lang or language)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(valid, pa.bool_()), pa.array(line, pa.int32()), pa.array(token, pa.string())],
                names=["repo_id", "path", "lang", "valid", "error_line", "error_token"],
            )

    return files.select("repo_id", "path", "lang", "parts").mapInArrow(run, "repo_id string, path string, lang string, valid boolean, error_line int, error_token string")


def error_rates(errors: DataFrame) -> DataFrame:
    """``repo_id, lang, n_files, n_invalid, rate``."""
    by = errors.groupBy("repo_id", "lang").agg(F.count("*").alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid"))
    return by.withColumn("rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
