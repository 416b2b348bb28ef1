import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import neighbours as N


def frame(spark, x, ids=None):
    ids = ids or [f"v{i:05d}" for i in range(len(x))]
    return spark.createDataFrame([(i, v.tolist(), "2024") for i, v in zip(ids, x.astype(np.float32))], "id string, dense array<float>, at string")


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((n // 4, 32))
    return np.repeat(centre, 4, 0) + 0.12 * rng.standard_normal((n // 4 * 4, 32))


def truth(x, k=10):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return s, np.argsort(-s, axis=1, kind="stable")[:, :k]


def test_recall_of_close_pairs(spark):
    x = clustered(1600)
    s, near = truth(x)
    want = {tuple(sorted((f"v{i:05d}", f"v{j:05d}"))) for i in range(len(x)) for j in near[i] if s[i, j] >= 0.9}
    got = {tuple(r) for r in N.linked_pairs(N.neighbours(frame(spark, x), latest=F.col("at"), least=0.9)).collect()}
    assert len(want & got) / len(want) > 0.95
    assert len(got - want) <= 0.02 * len(got)


def test_far_neighbours(spark):
    x = np.random.default_rng(8).standard_normal((1500, 24))
    _, near = truth(x)
    got = {}
    for r in N.neighbours(frame(spark, x)).collect():
        got.setdefault(r["id"], set()).add(int(r["neighbour"][1:]))
    recall = np.mean([len(got[f"v{i:05d}"] & set(near[i])) / 10 for i in range(len(x))])
    assert recall >= 0.9


def test_recall_of_the_registered_search(spark, sf):
    from quillspark.llm import queries

    row = queries.p5_recall(spark, "/root/testdata/sf0.01").first()
    assert row["n_queries"] > 30 and row["recall"] >= 0.9


def test_copies_share_links(spark):
    x = clustered(400)
    x = np.concatenate([x, x[:1], x[:1], x[5:6]])
    ids = [f"v{i:05d}" for i in range(400)] + ["w1", "w2", "w3"]
    got = {tuple(r) for r in N.linked_pairs(N.neighbours(frame(spark, x, ids), least=0.9)).collect()}
    assert {("v00000", "w1"), ("v00000", "w2"), ("w1", "w2"), ("v00005", "w3")} <= got
    s, _ = truth(x)
    close = [f"v{j:05d}" for j in range(1, 400) if s[0, j] >= 0.9]
    assert all((min("w1", c), max("w1", c)) in got for c in close)


def test_a_third_of_all_rows_alike(spark):
    x = clustered(900)
    x = np.concatenate([x, np.repeat(x[:1], 450, 0)])
    rows = N.neighbours(frame(spark, x), least=0.9).groupBy("id").count()
    assert rows.agg(F.max("count")).first()[0] <= 10
    alike = rows.filter("id >= 'v00900'")
    assert alike.count() == 450 and alike.agg(F.min("count")).first()[0] == 10


@pytest.mark.parametrize("block", [40, 50_000])
@pytest.mark.parametrize("least", [0.9, None])
def test_close_unequal_vectors_of_a_hot_group(spark, monkeypatch, block, least):
    monkeypatch.setattr(N, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((1, 16)) + 0.1 * rng.standard_normal((700, 16)), clustered(1200)[:, :16]])
    s, near = truth(x)
    rows = N.neighbours(frame(spark, x), least=least).filter("id < 'v00700'").collect()
    got = {(int(r["id"][1:]), int(r["neighbour"][1:])) for r in rows}
    want = {(i, j) for i in range(700) for j in near[i] if s[i, j] >= 0.9}
    assert len(want & got) / len(want) > 0.95 and len(got) <= 7000


def test_blocks_of_a_large_file_lose_nothing(spark, monkeypatch):
    x = clustered(800)
    whole = {tuple(r)[:2] for r in N.neighbours(frame(spark, x)).collect()}
    monkeypatch.setattr(N, "BLOCK_ROWS", 30)
    assert {tuple(r)[:2] for r in N.neighbours(frame(spark, x)).collect()} == whole


def test_files_of_a_hot_group_stay_level():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((1, 64)) + 0.3 * rng.standard_normal((3000, 64)), rng.standard_normal((6000, 64))]).astype(np.float32)
    x = rng.permutation(x / np.linalg.norm(x, axis=1)[:, None])
    index = N.Index(x, N.pivot_count(len(x)))
    sizes = np.bincount(index.order(x).ravel(), minlength=len(index.pivots))
    assert sizes.max() < 3 * sizes.mean()


def test_many_copies_are_matched_apart(spark, monkeypatch):
    x = clustered(120)
    df = frame(spark, np.concatenate([x, np.repeat(x[:1], 60, 0)]))
    whole = sorted(N.neighbours(df, least=0.9).collect())
    monkeypatch.setattr(N, "HOT_COPIES", 10)
    assert sorted(N.neighbours(df, least=0.9).collect()) == whole


def test_odd_vectors(spark):
    good = clustered(80)
    bad = [("n", None), ("z", [0.0] * 32), ("nan", [float("nan")] * 32), ("short", [1.0, 2.0]), ("null", [None] + [1.0] * 31), ("empty", [])]
    df = frame(spark, good).unionByName(spark.createDataFrame([(i, v, "2024") for i, v in bad], "id string, dense array<float>, at string"))
    df = df.unionByName(df).withColumn("count", F.lit(1)).withColumn("vec", F.lit("x")).withColumn("n", F.lit(2))
    near = N.neighbours(df, latest=F.col("at"))
    rows = near.collect()
    assert {r["id"] for r in rows} <= {f"v{i:05d}" for i in range(80)} and all(r["id"] != r["neighbour"] for r in rows)
    assert len(rows) == len({(r["id"], r["neighbour"]) for r in rows})
    one = rows[0]
    u = good / np.linalg.norm(good, axis=1)[:, None]
    assert one["cosine"] == pytest.approx(float(u[int(one["id"][1:])] @ u[int(one["neighbour"][1:])]), abs=1e-5)


def test_nothing(spark):
    assert N.neighbours(frame(spark, np.zeros((0, 4)))).collect() == []
    assert N.neighbours(frame(spark, np.ones((1, 4)))).collect() == []
