"""Descriptions, embeddings and small expressions against values worked out by hand or by the standard library."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from quillspark.functions import signing, text
from quillspark.operators import enrichment, units


def _model(prompts):
    """Answers for every chunk but the last of a file: the second too short, the third in another script."""
    import re

    def answer(p):
        said = ["Explains what this part of the file does.", "short", "Делает что-то очень полезное здесь."]
        items = [f'{{"n": {n}, "description": "{said[(int(n) - 1) % 3]}"}}' for n in re.findall(r"### Chunk (\d+)", p)]
        return "<think>hm</think> Here: {\"chunks\": [" + ", ".join(items[:3] + ['{"n": null}']) + "]} done" if items else "none"

    return prompts.map(answer)


def test_descriptions(spark):
    files = spark.createDataFrame([("r", "a.py", "\n\n".join(f"def function_{i}(x):\n    return x + {i}" for i in range(8)))], "repo_id string, path string, text string")
    cut = units.chunk_files(files, 60, 10)
    assert cut.count() == 8
    first = cut.filter("ordinal = 0").select(enrichment.chunk_hash(F.col("header"), F.col("text")).alias("chunk_hash"))
    cache = first.withColumn("model", F.lit("m:English")).withColumn("context", F.lit("From the cache, word for word."))
    rows = {r["ordinal"]: (r["status"], r["description"]) for r in enrichment.described(cut, files, cache, "m:English", _model).collect()}
    assert rows[0] == ("cached", "From the cache, word for word.") and rows[1][0] == "generated" and rows[1][1].startswith("Explains")
    assert [rows[i][0] for i in range(2, 8)] == ["rejected", "rejected", "failed", "failed", "failed", "generated"] and rows[3][1] == ""
    counts = enrichment.counters(enrichment.described(cut, files, cache, "m:English", _model)).first()
    assert tuple(counts) == (2, 1, 2, 3)
    other = enrichment.described(cut, files, cache, "m:Turkish", _model).filter("status = 'cached'")
    assert other.count() == 0


@pytest.mark.parametrize("answer, want", [(None, []), ("", []), ("no json", []), ('{"chunks": 3}', []), ('x {"chunks": [{"n": 2, "description": "d"}, {"description": "e"}, {"n": "3", "description": "f"}]} y', [(2, "d"), (3, "f")])])
def test_answers_are_parsed(spark, answer, want):
    row = spark.createDataFrame([(answer,)], "a string").select(enrichment.parsed(F.col("a")).alias("p")).first()
    assert [(x["n"], x["description"]) for x in row["p"]] == want


def _load():
    return lambda texts: [[float(len(t)), float(t.count("a")), 1.0] for t in texts]


def test_embedded(spark):
    rows = enrichment.embedded(spark.createDataFrame([(1, "banana"), (2, None), (3, "")], "i int, t string"), "t", _load).orderBy("i").collect()
    assert rows[0]["dense"] == pytest.approx([6 / 46**0.5, 3 / 46**0.5, 1 / 46**0.5]) and rows[1]["dense"] == rows[2]["dense"] == [0.0, 0.0, 1.0]


@pytest.mark.parametrize("secret", ["k", "a shared secret", "long " * 40])
def test_signatures(spark, secret):
    bodies = ["", "payload", "ödeme 🙂", "x" * 5000]
    rows = spark.createDataFrame([(b,) for b in bodies], "b string").select("b", signing.signed(secret, F.col("b")).alias("s"))
    for r in rows.collect():
        assert r["s"] == "sha256=" + hmac.new(secret.encode(), r["b"].encode(), hashlib.sha256).hexdigest()
    told = rows.select(signing.verified(secret, F.col("b"), F.col("s")).alias("a"), signing.verified(secret + "x", F.col("b"), F.col("s")).alias("c"), signing.verified(None, F.col("b"), F.col("s")).alias("d"), signing.verified(secret, F.col("b"), F.lit(None).cast("string")).alias("e"))
    assert all((r["a"], r["c"], r["d"], r["e"]) == (True, False, False, False) for r in told.collect())


def test_small_expressions(spark):
    df = spark.createDataFrame([("2025-01-31T12:05:09+02:00",), ("2025-01-31T12:05:09Z",), ("2025-01-31 12:05:09",), ("soon",), ("",)], "t string")
    assert [r[0] for r in df.select(text.short_stamp(F.col("t"))).collect()] == ["2025-01-31 10:05 UTC", "2025-01-31 12:05 UTC", "2025-01-31 12:05", "soon", ""]
    one = spark.createDataFrame([("a\nb\nc", "<think>x\ny</think> ok ", "fatal: Authorization: Basic abc123== and bearer x.y")], "a string, b string, c string")
    row = one.select(text.line_of(F.col("a"), F.lit(0)), text.line_of(F.col("a"), F.lit(2)), text.line_of(F.col("a"), F.lit(4)), text.without_thinking(F.col("b")), text.without_authorization(F.col("c"))).first()
    assert tuple(row) == (1, 2, 3, "ok", "fatal: Authorization: Basic [REDACTED] and bearer [REDACTED].y")
