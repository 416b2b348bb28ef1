"""Tokenizer, packing, pieces and reading bands."""

import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import packing, pieces, reading, tokenizer

tiktoken = pytest.importorskip("tiktoken")
ODD = ["", " ", "\n\n  x", "it's we'll\tdon't", "naïve café 順序を変えない 🙂👩‍👩‍👧", "a" * 3000, "\x00\x1c\x85 \u3000", "<|endoftext|>", "price 1,234.50€ ١٢٣", "  lead  and trail  ", "e\u0301\u0327", "\r\n\r\n"]


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=tokenizer.PRETOKEN, mergeable_ranks=tokenizer.read_ranks(), special_tokens={})


def test_ids_and_round_trip(oracle):
    e = tokenizer.encoder()
    for t in ODD:
        assert e.ids(t) == oracle.encode_ordinary(t)
        assert tokenizer.decode(e.ids(t)) == t
        assert e.length(t) == len(e.ids(t))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    own = tiktoken.Encoding("own2", pat_str=tokenizer.PRETOKEN, mergeable_ranks=_ranks(), special_tokens={})
    assert tokenizer.encoder().ids(text) == own.encode_ordinary(text)


def _ranks(kept={}):  # noqa: B006
    if not kept:
        kept.update(tokenizer.read_ranks())
    return kept


def test_corpus_encoding(spark, sf, oracle):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r["ids"] for r in tokenizer.encode_corpus(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert set(got) == set(rows)
    assert all(got[k] == (oracle.encode_ordinary(t) if t else []) for k, t in rows.items())


def test_hilbert_key_visits_every_cell_and_neighbours():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert_key(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_packing_is_valid_and_full(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.read.parquet(f"{sf}/documents.parquet").limit(3))
    windows = spark.createDataFrame([("s", 512), ("l", 8192), ("none", 0), (None, 5)], "window_name string, capacity_tokens int")
    rows = packing.pack(docs, windows).collect()
    texts = [r for r in docs.filter("text is not null and text <> ''").select("doc_id", "text").collect()]
    e = tokenizer.encoder()
    for name, capacity in (("s", 512), ("l", 8192)):
        mine = [r for r in rows if r["window_name"] == name]
        load = {}
        for r in mine:
            load[r["container"]] = load.get(r["container"], 0) + r["n_tokens"]
        assert max(load.values()) <= capacity
        assert sum(load.values()) == sum(e.length(t["text"]) for t in texts)
        for r in mine:
            assert r["n_tokens"] == capacity or r["part"] == 0 or r["first_token"] == r["part"] * capacity
        assert sum(1 for r in mine if r["part"] == 0) == len(texts)
    assert {r["window_name"] for r in rows} == {"s", "l"}


def test_members_of_a_container_lie_closer_than_random_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    windows = spark.createDataFrame([("m", 2048), ("l", 8192)], "window_name string, capacity_tokens int")
    place = {r["doc_id"]: i for i, r in enumerate(packing.placed(docs).orderBy("place", "doc_id").collect())}
    containers = {}
    for r in packing.pack(docs, windows).collect():
        containers.setdefault((r["window_name"], r["container"]), []).append(place[r["doc_id"]])
    for name in ("m", "l"):
        spread = [np.abs(np.subtract.outer(c, c)).sum() / (len(c) * (len(c) - 1)) for (w, _), c in containers.items() if w == name and len(c) > 1]
        assert np.mean(spread) < 0.25 * len(place) / 3  # a third of all is the mean distance in a random order


def test_validity_tells_faults(spark):
    windows = spark.createDataFrame([("s", 10)], "window_name string, capacity_tokens int")
    rows = [("s", "a", 1, 0, 0, 6), ("s", "a", 2, 0, 0, 5), ("s", "b", 3, 0, 0, 4), ("s", "c", 3, 1, 4, 4), ("s", "d", 4, 0, 0, 10), ("s", "e", 4, 1, 10, 3)]
    packed = spark.createDataFrame(rows, "window_name string, container string, doc_id bigint, part int, first_token bigint, n_tokens bigint")
    assert tuple(packing.validity(packed, windows).first()) == ("s", 4, 1, 1)


def test_pack_block_beats_no_bin():
    rng = random.Random(1)
    sizes = [rng.randint(1, 500) for _ in range(3000)]
    bins = packing.pack_block(sizes, 1000)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert all(sum(sizes[i] for i in b) <= 1000 for b in bins)
    assert len(bins) <= 1.02 * sum(sizes) / 1000 + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab {}é順🙂\t", max_size=60), max_size=40), st.integers(8, 80), st.integers(0, 30), st.integers(0, 3))
def test_pieces_cover_the_text(lines, most, least, overlap):
    text = "\n".join(lines)
    out = pieces.split_text(text, most, min(least, most // 2), overlap)
    assert all(len(p[3].encode()) <= most for p in out)
    whole, last = "", -1
    for first, end, shared, piece in out:
        assert first <= end
        body = piece.split("\n", shared)[shared] if shared else piece
        if whole and first - last >= 0 and not shared and first > last:
            whole += "\n" if not whole.endswith("\n") or True else ""
        whole += ("\n" if shared else "") + body if shared else body
        last = end
    assert whole.replace("\n", "") == text.replace("\n", "")
    assert out[0][0] == 0 and out[-1][1] == text.count("\n")


def test_pieces_prefer_the_strongest_and_rightmost_border():
    levels = pieces.sparse_table(np.array([1.0, 5.0, 2.0, 5.0, 3.0]))
    s = np.array([1.0, 5.0, 2.0, 5.0, 3.0])
    assert [pieces.strongest(levels, s, a, b) for a, b in ((0, 4), (0, 2), (2, 2), (3, 4))] == [3, 1, 2, 3]
    text = "\n".join(["def a():"] + ["    x = 1"] * 8 + ["", "def b():"] + ["    y = 2"] * 8)
    out = pieces.split_text(text, 130, 20, 0)
    assert any(p[3].startswith("def b()") for p in out)


def test_pieces_of_the_tables(spark, sf):
    rows = pieces.split_oversized(spark.read.parquet(f"{sf}/code_chunks.parquet"), spark.read.parquet(f"{sf}/chunker_config.parquet")).collect()
    want = {r[0] for r in duckdb.sql(f"select distinct c.id from '{sf}/code_chunks.parquet' c join '{sf}/chunker_config.parquet' k using (category) where octet_length(encode(content)) > max_bytes").fetchall()}
    assert {r["id"] for r in rows} == want


def test_prose_words_leave_code_out():
    text = "We read it.\n```py\nfoo_bar = 1\n```\n| a | b |\n# Title\nSee https://x.example/y and `code` in src/a.py.\nTraceback (most recent call last):\n"
    assert reading.prose_words(text) == ["we", "read", "it", "see", "and", "in"]


def test_reading_on_held_out_labels(spark):
    rng = random.Random(3)
    words = {b: [f"{b}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] for b in ("bas", "sta", "dem")}
    docs, labels = [], []
    for i in range(400):
        b = rng.randrange(3)
        names = list(words)
        text = " ".join(rng.choice(words[names[b]] if rng.random() < 0.8 else words[rng.choice(names)]) for _ in range(60))
        docs.append((i, text))
        if i < 250:
            labels.append((i, "r1", reading.BANDS[b].upper() if i % 7 else reading.BANDS[b], None))
    truth = {}
    rng = random.Random(3)
    for i in range(400):
        truth[i] = reading.BANDS[rng.randrange(3)]
        for _ in range(60):
            if rng.random() < 0.8:
                rng.choice(words["bas"])
            else:
                rng.choice(list(words))
                rng.choice(words["bas"])
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    lab = spark.createDataFrame(labels + [(1, "r2", None, None), (2, "r2", "nonsense", None)], "doc_id bigint, rater string, band string, rated_at timestamp")
    got = {r["doc_id"]: r["band"] for r in reading.reading_bands(d, lab).collect()}
    assert np.mean([got[i] == truth[i] for i in range(250, 400)]) > 0.95


def test_labels_are_cleaned(spark):
    rows = [(1, "a", " Basic ", "2024-01-01"), (1, "a", "standard", "2024-01-02"), (2, "a", "basic", None), (2, "b", "demanding", None), (3, "a", None, None), (4, "a", "basic", None), (4, "b", "basic", None), (4, "c", "demanding", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, rater string, band string, rated_at string").withColumn("rated_at", F.to_timestamp("rated_at"))
    assert sorted((r["doc_id"], r["grade"]) for r in reading.doc_bands(df).collect()) == [(1, 1), (4, 0)]


def test_profile_counts_every_document(spark, sf):
    from quillspark.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    by = ["source", "lang", "doc_kind"]
    want = {tuple(r) for r in docs.groupBy(*by).count().collect()}
    profile = queries.p8_profile(spark, sf)
    assert {tuple(r) for r in profile.groupBy(*by).sum("n_docs").collect()} == want
    assert (profile.filter("band is null").groupBy().sum("n_docs").first()[0] or 0) == docs.filter("text is null").count()


def test_registered_sql(spark, sf):
    from quillspark.llm import queries

    con = duckdb.connect()
    for name in ("code_chunks", "documents", "chunker_config", "context_windows"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        result = con.execute(sql)
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(map(repr, result.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()), name
