import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import chunking, dense, evaluation, events, fusion, incremental, jobs, lexical, state


def test_dense_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id bigint, vector array<float>, label int")
    got = dense.dense_topk(rows.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), rows, 5).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    for q in range(0, 300, 50):
        s = u @ u[q]
        s[q] = -2
        want = sorted(range(300), key=lambda i: (-round(s[i], 9), i))[:5]
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_dense_of_nothing(spark):
    empty = spark.createDataFrame([], "query_id bigint, vector array<float>")
    assert dense.dense_topk(empty, empty.withColumnRenamed("query_id", "id")).collect() == []


def test_bm25_against_brute_force(spark):
    docs = {1: "red red fish", 2: "blue fish swims", 3: "a red house", 4: "", 5: "nothing here"}
    df = spark.createDataFrame(list(docs.items()), "id bigint, text string")
    got = {r["id"]: r["score"] for r in lexical.bm25_topk(spark.createDataFrame([(100, "red fish")], "query_id bigint, text string"), df).collect()}
    toks = {i: re.findall(r"\w+", t) for i, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    for i, t in toks.items():
        c, score = Counter(t), 0.0
        for w in ("red", "fish"):
            df_ = sum(w in x for x in toks.values())
            score += math.log(1 + (n - df_ + 0.5) / (df_ + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(t) / avg)) if c[w] else 0
        assert got.get(i, 0) == pytest.approx(score)


def test_bm25_of_many_queries(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    queries = docs.filter("id % 10 = 0").withColumnRenamed("id", "query_id")
    run = lambda: sorted((r["query_id"], r["id"], r["rank"], round(r["score"], 6)) for r in lexical.bm25_topk(queries, docs).collect())
    few = run()
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 0)
    assert run() == few and few


def test_fusion_by_ranks_and_ties(spark):
    d = spark.createDataFrame([(1, 10, 1, 0.9), (1, 20, 2, 0.8), (1, 30, 3, 0.2)], "query_id bigint, id bigint, rank int, score double")
    b = spark.createDataFrame([(1, 30, 1, 5.0), (1, 10, 2, 4.0), (1, 40, 3, 3.0)], "query_id bigint, id bigint, rank int, score double")
    rows = fusion.fuse(d, b).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [10, 30, 20, 40]
    assert rows[0]["rrf"] == pytest.approx(1 / 61 + 1 / 62)
    kept = fusion.floor(fusion.fuse(d, b), 0.45).orderBy("rank").collect()
    assert [(r["id"], r["rank"]) for r in kept] == [(10, 1), (20, 2), (40, 3)]
    s = fusion.signals(fusion.fuse(d, b), 0.45, 0.95).first()
    assert (s["n_hits"], s["dropped"], s["weak"]) == (3, 1, True)


def test_rerank(spark):
    hits = spark.createDataFrame([(1, 10, 1, "q", "aa"), (1, 20, 2, "q", "aaaa"), (1, 30, 3, "q", "aaaa")], "query_id bigint, id bigint, rank int, query string, text string")
    out = fusion.rerank(hits, _length, 2).orderBy("rank").collect()
    assert [r["id"] for r in out] == [20, 30]


def _length(q, t):
    return t.str.len().astype(float)


def test_chunking_invariants(spark):
    text = "# A\n\nfirst\n\n## B\nline one\nline two\n\n" + "\n".join(f"row {i} " + "x" * 60 for i in range(80)) + "\n\n# C\nend"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "   ")], "id bigint, text string")
    chunks = chunking.paragraphs(df).filter("id = 1").orderBy("part").collect()
    assert "\n".join(r["chunk"] for r in chunks) == text and all(len(r["chunk"].encode()) <= 2000 for r in chunks)
    windows = chunking.line_windows(df, 500).filter("id = 1").orderBy("part").collect()
    assert all(len(w["chunk"].encode()) <= 500 for w in windows)
    assert windows[0]["first_line"] == 1 and windows[-1]["last_line"] == text.count("\n") + 1
    assert all(b["first_line"] == a["last_line"] - 2 for a, b in zip(windows, windows[1:]))
    s = chunking.markdown_sections(df).filter("id = 1").orderBy("section").collect()
    assert [(r["depth"], r["heading"]) for r in s] == [(1, "A"), (2, "B"), (1, "C")]
    c = chunking.character_windows(df, 100, 20).filter("id = 1").orderBy("start").collect()
    assert [r["start"] for r in c][:3] == [0, 80, 160] and c[0]["chunk"] == text[:100]


def test_sync_scenario(spark):
    f = lambda rows: spark.createDataFrame(rows, "repo_id string, path string, sha string")
    diff = incremental.manifest_diff(f([("r", "a", "1"), ("r", "b", "9"), ("r", "d", "4")]), f([("r", "a", "1"), ("r", "b", "2"), ("r", "c", "3")]))
    c = incremental.counters(diff).first()
    assert (c["files_seen"], c["added"], c["modified"], c["deleted"], c["unchanged"]) == (3, 1, 1, 1, 1)
    chunks = spark.createDataFrame([("r", "a", 0), ("r", "b", 0), ("r", "c", 0)], "repo_id string, path string, n int")
    fresh = spark.createDataFrame([("r", "b", 1), ("r", "d", 1)], "repo_id string, path string, n int")
    assert sorted((r["path"], r["n"]) for r in incremental.rewritten(chunks, diff, fresh).collect()) == [("a", 0), ("b", 1), ("d", 1)]


def test_latest_wins_whatever_the_order(spark):
    rows = [("k", "2024-01-01", "old"), ("k", "2024-02-01", "new"), ("k", None, "none"), ("l", None, "only")]
    df = spark.createDataFrame(rows, "key string, at string, v string")
    assert sorted((r["key"], r["v"]) for r in incremental.latest(df, ["key"], "at").collect()) == [("k", "new"), ("l", "only")]
    up = state.upserted(df, spark.createDataFrame([("l", "2024-03-01", "more")], df.schema), "key", "at")
    assert sorted((r["key"], r["v"]) for r in up.collect()) == [("k", "new"), ("l", "more")]


def test_partitions_are_replaced_and_dropped(spark, tmp_path):
    path = str(tmp_path / "chunks")
    state.write_chunks(spark.createDataFrame([("a", 1), ("b", 1)], "repo_id string, n int"), path)
    state.replace_repos(spark.createDataFrame([("a", 2)], "n_repo string, n int").withColumnRenamed("n_repo", "repo_id"), path)
    assert sorted((r["repo_id"], r["n"]) for r in spark.read.parquet(path).collect()) == [("a", 2), ("b", 1)]
    state.drop_repo(spark, path, "b")
    spark.catalog.refreshByPath(path)
    assert [r["repo_id"] for r in spark.read.parquet(path).collect()] == ["a"]


def test_evaluation(spark):
    """Worked out by hand: two positives (one found in full), two negatives (one weak, one that looks strong)."""
    cases = spark.createDataFrame([(1, "p", "all"), (2, "p", "any"), (3, "n", "all"), (4, "n", "all"), (5, "e", "all")], "query_id bigint, kind string, mode string")
    hit = lambda q, rank, path, symbol, parent, dense, weak: (q, rank, path, symbol, parent, dense, weak)
    hits = spark.createDataFrame(
        [hit(1, 1, "a.py", "x", "", 0.66, False), hit(1, 2, "b.py", "m", "pkg.K", 0.6, False), hit(2, 1, "z.py", "", "", 0.5, True), hit(2, 3, "c.py", "f", "", 0.5, True), hit(3, 1, "q.py", "", "", 0.5, True), hit(4, 1, "q.py", "s", "", 0.65, False)],
        "query_id bigint, rank int, path string, symbol string, parent_symbol string, dense double, weak boolean",
    )
    expected = spark.createDataFrame([(1, "b.py::K"), (1, "a.py::y"), (2, "c.py"), (2, "d.py"), (5, "a.py")], "query_id bigint, expect string")
    scored = evaluation.scored_cases(cases, hits, expected)
    rows = {r["query_id"]: r for r in scored.collect()}
    assert (rows[1]["recall"], rows[1]["rr"], rows[1]["abstained"]) == (0.5, 0.5, False) and (rows[2]["recall"], rows[2]["weak"]) == (1.0, True) and rows[2]["rr"] == pytest.approx(1 / 3)
    assert (rows[3]["recall"], rows[4]["recall"], rows[5]["recall"], rows[5]["abstained"]) == (1.0, 0.0, 0.0, True) and rows[3]["negative"] and not rows[5]["negative"]
    whole = evaluation.report(scored).first()
    assert (whole["n"], whole["recall"], whole["abstain_rate"], whole["misses"]) == (5, 0.5, 0.5, 3) and whole["false_weak_rate"] == pytest.approx(1 / 3, abs=1e-6) and whole["mrr"] == pytest.approx((1 / 2 + 1 / 3) / 3, abs=1e-6)
    kinds = {r["kind"]: tuple(r)[1:] for r in evaluation.by_kind(scored).collect()}
    assert kinds["n"] == (2, None, None, 0.5) and kinds["p"][:2] == (2, 0.75) and kinds["p"][3] is None
    assert tuple(evaluation.calibration(scored).first()) == (0.5, 0.5, 0.65, 0.575)
    assert {r["query_id"]: r["top"] for r in evaluation.misses(scored, hits).collect()} == {1: ["a.py::x", "b.py::m"], 4: ["q.py::s"], 5: []}
    p = evaluation.nearest_percentiles(spark.createDataFrame([("a", float(i)) for i in range(10)], "k string, v double"), "k", "v").first()
    assert (p["p50"], p["p95"]) == (5.0, 9.0)


def test_bm25_of_the_last_delivery(spark):
    docs = spark.createDataFrame([("a", "red fish", "1"), ("a", "blue", "2"), ("b", "red", "1"), ("b", "red", "1"), ("c", "Şişe öğrenci", None)], "id string, text string, at string")
    queries = spark.createDataFrame([("q", "red blue öğrenci")], "query_id string, text string")
    once = spark.createDataFrame([("a", "blue"), ("b", "red"), ("c", "Şişe öğrenci")], "id string, text string")
    rows = lambda df: sorted((r["id"], round(r["score"], 9)) for r in df.collect())
    assert rows(lexical.bm25_topk(queries, docs, latest="at")) == rows(lexical.bm25_topk(queries, once)) and len(rows(lexical.bm25_topk(queries, once))) == 3


def test_push_parsing(spark):
    azure = [
        '{"eventType":"git.push","resource":{"refUpdates":[{"name":"refs/heads/main","oldObjectId":"1","newObjectId":"2"},{"name":"refs/tags/v1","oldObjectId":"1","newObjectId":"2"},{"name":"refs/heads/dev"}],"repository":{"id":"r","name":"n","project":{"name":"p"}}}}',
        '{"resource":{"refUpdates":[{"name":"refs/heads/x"}],"repository":{"id":""}}}', '{"eventType":"other","resource":{"refUpdates":[{"name":"refs/heads/x"}],"repository":{"id":"r"}}}', "{}",
    ]
    github = ['{"ref":"refs/heads/dev","before":"1","after":"2","repository":{"id":7,"name":"n","owner":{"name":"o"}}}', '{"ref":"refs/heads/dev","before":"1","after":"2","deleted":true,"repository":{"id":7}}', '{"ref":"refs/heads/dev","repository":{}}', '{"ref":"refs/tags/x"}', "not json"]
    rows = lambda bodies: spark.createDataFrame([(b,) for b in bodies], "body string")
    assert [tuple(r) for r in events.azure_pushes(rows(azure)).collect()] == [("azure", "r", "n", "p", "main", "1", "2"), ("azure", "r", "n", "p", "dev", "", "")]
    assert [tuple(r) for r in events.github_pushes(rows(github)).collect()] == [("github", "7", "n", "o", "dev", "1", "2")]


def test_events_find_their_branch_and_provider(spark):
    repos = spark.createDataFrame([("a", "9", "main", "azure"), ("b", "9", "dev", "azure"), ("c", "9", "dev", "github"), ("d", "", "main", "azure")], "id string, external_id string, branch string, provider string")
    rows = [(1, "9", "dev", "x", 2, "github"), (2, "9", "dev", "x", 1, "github"), (3, "9", "main", "x", 3, "azure"), (4, "9", "other", "y", 4, "azure"), (5, "", "main", "z", 5, "azure"), (6, "9", "main", "", 6, "azure"), (7, "9", "main", None, 7, "azure"), (8, "9", "dev", "x", 8, "azure")]
    df = spark.createDataFrame(rows, "event_no bigint, external_id string, branch string, new_commit string, received_at int, provider string")
    got = {r["event_no"]: (r["repo_id"], r["outcome"]) for r in events.matched(df, repos).collect()}
    assert got[1] == ("c", events.HANDLED) and got[2] == ("c", events.ENQUEUED) and got[3] == ("a", events.ENQUEUED) and got[8] == ("b", events.ENQUEUED)
    assert got[4] == (None, events.UNKNOWN) and got[5] == (None, events.UNKNOWN) and got[6][1] == got[7][1] == events.ENQUEUED
    without = {r["event_no"]: r["repo_id"] for r in events.matched(df.drop("provider"), repos).collect()}
    assert without[1] == without[8] == "b"


def test_job_states(spark):
    import datetime as dt

    at = lambda h: dt.datetime(2025, 1, 1, h)
    none = spark.createDataFrame([], jobs.SCHEMA)
    one = jobs.enqueued(none, spark.createDataFrame([("r", "webhook", False, at(2)), ("r", "manual", None, at(1)), ("s", "poll", True, at(3))], "repo_id string, trigger string, force boolean, at timestamp_ntz"))
    assert sorted((r["repo_id"], r["trigger"], r["status"], r["force"], r["created_at"].hour) for r in one.collect()) == [("r", "manual", "queued", False, 1), ("s", "poll", "queued", True, 3)]
    two = jobs.enqueued(one, spark.createDataFrame([("r", "webhook", True, at(4))], "repo_id string, trigger string, force boolean, at timestamp_ntz"))
    assert sorted((r["repo_id"], r["force"]) for r in two.collect()) == [("r", True), ("s", True)]
    ids = {r["repo_id"]: r["id"] for r in two.collect()}
    run = jobs.changed(two, spark.createDataFrame([(ids["r"], "running", at(5), None), (ids["s"], "done", at(5), None)], "id string, to string, at timestamp_ntz, message string"))
    assert {r["repo_id"]: r["status"] for r in run.collect()} == {"r": "running", "s": "queued"}
    three = jobs.enqueued(run, spark.createDataFrame([("r", "webhook", False, at(6))], "repo_id string, trigger string, force boolean, at timestamp_ntz"))
    assert three.filter("repo_id = 'r'").count() == 2 and {r["repo_id"]: r["status"] for r in jobs.active(three).collect()} == {"r": "running", "s": "queued"}
    late = jobs.recovered(three, "cut short", "2025-01-02 00:00:00")
    assert sorted((r["repo_id"], r["status"], r["error"]) for r in late.collect()) == [("r", "failed", "cut short"), ("r", "queued", None), ("s", "queued", None)]
    assert [r["created_at"].hour for r in jobs.newest(late, 1).filter("repo_id = 'r'").collect()] == [6]


@pytest.fixture
def three_files(spark, sf, tmp_path):
    """The push events in three files by time of receipt, and the events in three by their time."""
    for name, by in (("push_events", "received_at"), ("events", "ts")):
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        cuts = [r[0] for r in df.select(by).orderBy(by).collect()]
        a, b = cuts[len(cuts) // 3], cuts[2 * len(cuts) // 3]
        for i, part in enumerate((df.filter(F.col(by) < a), df.filter((F.col(by) >= a) & (F.col(by) < b)), df.filter(F.col(by) >= b))):
            part.coalesce(1).write.mode("append" if i else "overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_streams_don_t_depend_on_their_batches(spark, sf, three_files):
    from quillspark.plans import events as plans

    want = sorted(map(tuple, plans.push_dedupe(spark, sf).select("external_id", "new_commit", "event_no", "deliveries").collect()))
    assert sorted(map(tuple, plans.stream_push_dedupe(spark, three_files).select("external_id", "new_commit", "event_no", "deliveries").collect())) == want
    whole = sorted(map(tuple, plans.stream_tumbling(spark, sf).collect()))
    assert sorted(map(tuple, plans.stream_tumbling(spark, three_files).collect())) == whole and whole


def test_replayed_batches_add_nothing(spark, sf, tmp_path):
    from quillspark.streaming import pushes

    for n in (1, 2):
        pushes.keep_first_deliveries(pushes.table_stream(spark, sf, "push_events"), str(tmp_path / "t"), str(tmp_path / f"c{n}")).awaitTermination()
    assert pushes.first_of_all(spark, str(tmp_path / "t")).agg(F.sum("deliveries")).first()[0] == spark.read.parquet(f"{sf}/push_events.parquet").filter("external_id is not null and new_commit is not null").count()


def test_stream_of_outcomes_and_sessions(spark, sf, tmp_path):
    from quillspark.streaming import pushes

    pushes.closed_windows(pushes.sessions(pushes.table_stream(spark, sf, "events")), str(tmp_path / "s"), str(tmp_path / "cs")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "s"))
    batch = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("w")).agg(F.count("*").alias("n_events")).select("user_id", F.col("w.start").alias("start"), "n_events")
    assert got.count() > 0 and got.exceptAll(batch).count() == 0
    d = pushes.deduplicated_within(pushes.table_stream(spark, sf, "push_events"), "3650 days")
    d.select("external_id", "new_commit").writeStream.format("parquet").option("path", str(tmp_path / "d")).option("checkpointLocation", str(tmp_path / "cd")).trigger(availableNow=True).start().awaitTermination()
    once = spark.read.parquet(str(tmp_path / "d"))
    assert once.count() == once.distinct().count() == events.first_deliveries(spark.read.parquet(f"{sf}/push_events.parquet")).count()
