import pytest
from pyspark.sql import functions as F

from quillspark.operators import answers, evaluation
from quillspark.plans.engine import Engine, Settings


@pytest.fixture(scope="module")
def engine(spark, sf):
    read = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    return Engine(spark, read("code_chunks"), read("files"), read("repos"), Settings(min_dense_score=0.2, weak_dense_score=0.3))


def test_modes_and_filters(spark, engine):
    some = engine.chunks.filter("dense is not null and symbol <> '' and exists(dense, x -> x <> 0)").orderBy("id").select("id", "symbol", "dense").limit(1).first()
    queries = spark.createDataFrame([(1, some["symbol"] + "_x", some["dense"], "bm25"), (2, "what happens on a late commit", some["dense"], "auto"), (3, some["symbol"], some["dense"], "hybrid")], "query_id bigint, query string, vector array<float>, mode string")
    rows = engine.search(queries).collect()
    assert all(r["dense"] is None for r in rows if r["query_id"] == 1)
    second = sorted((r for r in rows if r["query_id"] == 2), key=lambda r: r["rank"])
    assert second and second[0]["dense"] == pytest.approx(1, abs=1e-4) and all(r["bm25"] is None for r in second)
    assert any(r["bm25"] is not None for r in rows if r["query_id"] == 3)
    assert {r["rank"] for r in second} == set(range(1, len(second) + 1))
    only = engine.search(queries, lang="go").select("lang").distinct().collect()
    assert [r[0] for r in only] in ([], ["go"])


def test_rerank_and_prompts(spark, engine):
    queries = spark.createDataFrame([(1, "late commit ignored", None, "bm25")], "query_id bigint, query string, vector array<float>, mode string")
    hits = engine.search(queries, rerank=_by_length)
    lengths = [len(r["text"]) for r in hits.orderBy("rank").collect()]
    assert lengths == sorted(lengths, reverse=True) and len(lengths) == 8
    prompt = engine.prompts(queries, hits).first()["prompt"]
    assert prompt.startswith("CODE CHUNKS (most relevant first):\n\n[1] ") and prompt.endswith("\n\nQuestion: late commit ignored")
    said = engine.ask(queries, _echo).first()
    assert said["answer"].startswith("CODE") and said["prompt_chars"] == len(said["answer"]) and [x["n"] for x in said["sources"]] == list(range(1, len(said["sources"]) + 1))


def _echo(prompts):
    return prompts


def _by_length(query, text):
    return text.str.len().astype(float)


def test_sync_and_slices(spark, engine):
    known = engine.totals().agg(F.sum("file_count")).first()[0]
    files = engine.manifest.groupBy("repo_id", "path").agg(F.max("sha").alias("sha")).withColumn("sha", F.lit("changed"))
    after, counters = engine.sync(files, engine.chunks)
    assert counters.agg(F.sum("modified")).first()[0] == known
    assert after.count() == engine.chunks.count()


def test_settings_are_checked():
    with pytest.raises(ValueError):
        Settings(min_dense_score=0.9)


def test_prompts_hold_whole_texts(spark):
    row = lambda q, rank, path, text, kind, weak: (q, rank, "r", path, "f", "function", "py", kind, 1, 2, text, "", weak)
    hits = spark.createDataFrame([row(1, 1, "a.py", "x" * 5000, "code", False), row(1, 2, "b.md", "y" * 3000, "doc", False), row(2, 1, "c.py", "z", "code", True)], "query_id int, rank int, repo_id string, path string, symbol string, kind string, lang string, category string, start_line int, end_line int, content string, context string, weak boolean")
    queries = spark.createDataFrame([(1, "how"), (2, "why"), (3, "what")], "query_id int, query string")
    got = {r["query_id"]: r["prompt"] for r in answers.prompts(queries, hits).collect()}
    assert got[1] == "CODE CHUNKS (most relevant first):\n\n[1] a.py:1-2 — function f (repo: r)\n```py\n" + "x" * 5000 + "\n```\n\n[2] b.md:1-2 — DOCUMENT — function f (repo: r)\n```py\n" + "y" * 3000 + "\n```\n\nQuestion: how"
    assert answers.WEAK_NOTE in got[2] and got[3] == "(no code chunks were found)\n\nQuestion: what"
    assert all(len(r["text"]) < 5400 + len(answers.WEAK_NOTE) for r in answers.rendered(hits).collect())


def test_written_once(spark, engine):
    again = engine.written("chunks_by_id", 4)
    assert again.chunks.count() == engine.chunks.count()
    plan = again.chunks.select("id", "path").join(again.chunks.select("id", "symbol").hint("merge"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("drop table chunks_by_id")


def test_removal_and_health(spark, engine):
    whole = engine.health().first()
    gone = engine.repos.orderBy("id").first()["id"]
    rest = engine.without(gone)
    assert rest.health().first()["repos"] == whole["repos"] - 1 and rest.chunks.filter(F.col("repo_id") == gone).count() == 0
    assert rest.chunks.count() == engine.chunks.filter(F.col("repo_id") != gone).count()


def test_evaluation_of_searches(spark, engine, tmp_path):
    some = engine.chunks.filter("symbol <> ''").orderBy("id").limit(4).select("id", "path", "symbol")
    queries = some.select(F.col("id").alias("query_id"), F.col("symbol").alias("query"), F.lit(None).cast("array<float>").alias("vector"), F.lit("bm25").alias("mode"))
    cases = some.select(F.col("id").alias("query_id"), F.lit("symbol").alias("kind"), F.lit("any").alias("mode"))
    expected = some.select(F.col("id").alias("query_id"), F.concat_ws("::", "path", "symbol").alias("expect"))
    # a query has the id of its own chunk, which isn't a hit then: other ids for the queries
    rename = lambda df: df.withColumn("query_id", F.concat(F.lit("q:"), "query_id"))
    hits = engine.search(rename(queries))
    report = engine.evaluate(rename(cases), hits, rename(expected))
    row = report.first()
    assert row["n"] == 4 and row["recall"] > 0.5 and row["abstain_rate"] is None
    path = evaluation.save(report, str(tmp_path), "symbols", "2025-01-31_1200")
    assert spark.read.json(path).first()["n"] == 4 and path.endswith("2025-01-31_1200_symbols.json")
