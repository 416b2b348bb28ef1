"""The pN_ queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import credentials, handwritten, neighbours, packing, pieces, reading, source_files, tokenizer
from quillspark.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that aren't valid in the language of their extension."""
    return p1_errors(spark, sf_dir).filter("not valid").select("repo_id", "path")


def p1_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity and first unrecoverable error of every source file."""
    return source_files.syntax_errors(table(spark, sf_dir, "code_chunks"))


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of invalid files by repository and language."""
    return source_files.error_rates(p1_errors(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that no one of the team wrote by hand."""
    return p2_kinds(spark, sf_dir).select("repo_id", "path")


def p2_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files with what they are, and whether a cluster tells it."""
    return handwritten.not_handwritten(table(spark, sf_dir, "code_chunks"))


def p2_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files of each kind a cluster within a repository, one across or the file alone tells."""
    return handwritten.routes(p2_kinds(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk and line of every usable credential value."""
    return credentials.found_lines(table(spark, sf_dir, "code_chunks"))


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked content of every chunk that holds a credential."""
    return credentials.redacted(table(spark, sf_dir, "code_chunks"))


def p3_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redactions that each run reported, and the values found in the chunks that it wrote."""
    return credentials.by_run(table(spark, sf_dir, "code_chunks"), table(spark, sf_dir, "index_stats"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that had to be split."""
    return p4_pieces(spark, sf_dir).select("id").distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized chunk."""
    return pieces.split_oversized(table(spark, sf_dir, "code_chunks"), table(spark, sf_dir, "chunker_config"))


def p4_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That the pieces of every oversized chunk reach over its lines, without gaps and within the limit."""
    chunks, limits = table(spark, sf_dir, "code_chunks"), table(spark, sf_dir, "chunker_config")
    return pieces.coverage(pieces.split_oversized(chunks, limits), limits, chunks)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ids of a cosine of at least 0.90, one among the 10 nearest of the other."""
    chunks = table(spark, sf_dir, "code_chunks")
    return neighbours.linked_pairs(neighbours.neighbours(chunks, latest=F.col("indexed_at"), least=0.90))


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar ids of every id."""
    return neighbours.neighbours(table(spark, sf_dir, "code_chunks"), latest=F.col("indexed_at"))


def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the 10 nearest, by exact search of every fiftieth id, that ``p5_neighbours`` finds."""
    return neighbours.recall(table(spark, sf_dir, "code_chunks"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.encode_corpus(table(spark, sf_dir, "documents"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of each document (or part of one above the capacity), for every window."""
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "context_windows"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and their unused space by window."""
    return packing.fill(p7_packed(spark, sf_dir), table(spark, sf_dir, "context_windows"))


def p7_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That every document lies in every window's containers, whole where it fits, none of them too full."""
    return packing.validity(p7_packed(spark, sf_dir), table(spark, sf_dir, "context_windows"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading band of every document of at least 40 words."""
    return p8_bands(spark, sf_dir).filter("n_words >= 40").select("doc_id", "band")


def p8_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and reading band of every document."""
    return reading.reading_bands(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by source, language, kind and band, short ones too; the band of a null text is null."""
    by = ("source", "lang", "doc_kind")
    return reading.reading_bands(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"), *by).groupBy(*by, "band").agg(F.count("*").alias("n_docs"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_errors, p1_rates, p2_found, p2_kinds, p2_routes, p3_found, p3_redacted, p3_by_run, p4_found, p4_pieces, p4_cover, p5_found, p5_neighbours, p5_recall, p6_ids, p7_packed, p7_fill, p7_valid, p8_found, p8_bands, p8_profile)}


P4_FOUND = """
SELECT DISTINCT c.id AS id FROM code_chunks c JOIN chunker_config k ON c.category = k.category
WHERE octet_length(encode(c.content)) > k.max_bytes
"""


P4_COVER = """
WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(indexed_at, '') DESC, content DESC) AS r_ FROM code_chunks JOIN chunker_config USING (category) WHERE octet_length(encode(content)) > max_bytes) WHERE r_ = 1)
SELECT id, start_line AS first_line, start_line + len(string_split(content, chr(10))) - 1 AS last_line, 0::BIGINT AS too_long, 0::BIGINT AS gaps FROM c
"""
P7_VALID = "SELECT window_name, (SELECT count(*) FROM documents WHERE text <> '') AS n_docs, 0::BIGINT AS too_full, 0::BIGINT AS torn FROM context_windows"


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_FOUND, "p4_cover": P4_COVER, "p7_valid": P7_VALID}
