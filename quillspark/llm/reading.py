"""Reading level of documents (problem 8).

Every word gets an acquisition grade from the bands of the labelled texts that use
it: the mean grade of those texts, bands weighed to equal shares, drawn to the middle
while the word is rare. A document's level is predicted from quantiles of the grades
of its known words by an ordinal model calibrated on labelled documents whose words
were graded on the other half of the labels.

Bound: the fit takes at most ``MAX_LABELLED`` labelled documents (those of the lowest hash of
their id) and every word that at least ``MIN_TEXTS`` of them use. Corpus rows are never sampled.

Defined results: only running prose counts (code, tables, traces, links and headings
don't); a text without known words gets the most frequent band; null texts have no
words and a null band; labels that are null or no band are left out, the last label
of a rater holds, raters who differ evenly leave the document out. Without any label
every band is null. One row per input row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut_lineage

BANDS = ("basic", "standard", "demanding")
MAX_LABELLED = 20_000
#: Labelled texts that must use a word, at least, and the weight of the middle grade.
MIN_TEXTS, SHRINK = 3, 1.0
#: Grades are kept as whole steps.
STEPS = 64
QUANTILES = np.array([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
_SPANS = re.compile(r"`[^`\n]*`|!?\[[^\]\n]*\]\([^)\n]*\)")
#: Runs without white space that hold a slash, an underscore or an at sign: links, paths, addresses, names from code.
_RUNS = re.compile(r"(?<!\S)[^\s/\\_@]*+[/\\_@]\S*")
_LINES = re.compile(
    r"^(?:[ \t]*\|.*|[ \t]*#{1,6}[ \t].*|(?: {4,}|\t).*|Traceback .*|[ \t]*File \".*|[ \t]*at [\w.$<>]+\(.*|[\w.]*(?:Error|Exception)\b:.*|.*[{};][ \t]*|.*[=<>]{2,}.*)$", re.M
)
_WORD = re.compile(r"[^\W\d_]+")


def prose_words(text: str) -> list[str]:
    """Lower-case words of the running prose."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    return _WORD.findall(_RUNS.sub(" ", _SPANS.sub(" ", _LINES.sub("", text))).lower())


def doc_bands(labels: DataFrame) -> DataFrame:
    """``doc_id, grade`` (0, 1 or 2): the band that most raters gave, their last word each."""
    grade = F.array_position(F.array(*map(F.lit, BANDS)), F.lower(F.trim("band"))).cast("int") - 1
    votes = labels.select("doc_id", "rater", grade.alias("grade"), "rated_at").filter("doc_id is not null and grade >= 0")
    last = votes.groupBy("doc_id", "rater").agg(F.max_by("grade", F.struct(F.coalesce("rated_at", F.lit("0001-01-01").cast("timestamp")), "grade")).alias("grade"))
    tally = last.groupBy("doc_id").agg(*[F.count_if(F.col("grade") == g).alias(f"n{g}") for g in range(3)])
    best = F.greatest("n0", "n1", "n2")
    return tally.filter(sum((F.col(f"n{g}") == best).cast("int") for g in range(3)) == 1).select("doc_id", F.when(F.col("n0") == best, 0).when(F.col("n1") == best, 1).otherwise(2).alias("grade"))


def word_grades(rows: DataFrame) -> DataFrame:
    """``word, half, n0, n1, n2``: labelled texts of each band and half that use the word."""
    return rows.groupBy("word", "half").agg(*[F.count_if(F.col("grade") == g).alias(f"n{g}") for g in range(3)])


def _grades(counts: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Whole-step grades from counts by band (n x 3) and the number of texts by band."""
    rate = counts / np.maximum(texts, 1)
    share = counts.sum(1)
    weight = rate.sum(1)
    mean = np.where(weight > 0, (rate @ np.array([0.0, 0.5, 1.0])) / np.maximum(weight, 1e-12), 0.5)
    mean = (mean * share + 0.5 * SHRINK) / (share + SHRINK)
    return np.minimum((mean * STEPS).astype(np.int64), STEPS - 1)


def features(texts: list[list[str]], grades: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of the known words' grades and their mean (0 to 1), and the number of known words, of each text."""
    hist = np.zeros((len(texts), STEPS))
    for i, words in enumerate(texts):
        known = [grades[w] for w in words if w in grades]
        if known:
            hist[i] = np.bincount(known, minlength=STEPS)
    n = hist.sum(1)
    cum = hist.cumsum(1) / np.maximum(n, 1)[:, None]
    q = [(cum < p - 1e-9).sum(1) / STEPS for p in QUANTILES]
    mean = hist @ (np.arange(STEPS) / STEPS) / np.maximum(n, 1)
    return np.column_stack([*q, mean]), n


def _logistic(x: np.ndarray, y: np.ndarray, classes: int = 3, rounds: int = 400, decay: float = 1e-3) -> np.ndarray:
    """Softmax regression by gradient steps with momentum; weights of (features + 1) x classes."""
    x = np.column_stack([x, np.ones(len(x))])
    w, v = np.zeros((x.shape[1], classes)), np.zeros((x.shape[1], classes))
    hot = np.eye(classes)[y]
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        v = 0.9 * v - 0.5 * (x.T @ (p - hot) / len(x) + decay * w)
        w = w + v
    return w


class Model:
    """Word grades and the calibrated weights on their quantiles."""

    def __init__(self, grades: dict[str, int], centre: np.ndarray, scale: np.ndarray, weights: np.ndarray, usual: int) -> None:
        self.grades, self.centre, self.scale, self.weights, self.usual = grades, centre, scale, weights, usual

    def bands(self, texts: list[list[str]]) -> np.ndarray:
        x, n = features(texts, self.grades)
        z = np.column_stack([(x - self.centre) / self.scale, np.ones(len(x))]) @ self.weights
        return np.where(n > 0, z.argmax(1), self.usual)


def labelled_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, grade, half, words`` of the labelled documents within the bound."""
    banded = doc_bands(labels).withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 33))
    share = min(1.0, 1.2 * (MAX_LABELLED + 1000) / max(1, banded.count()))
    bounded = banded.filter(F.col("h") < int(share * 2**31)).orderBy("h", "doc_id").limit(MAX_LABELLED).drop("h")
    rows = docs.select("doc_id", "text").filter("text is not null").join(bounded, "doc_id")
    rows = rows.select("doc_id", "grade", (F.xxhash64("doc_id", F.lit(7)) % 2).alias("half"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = pa.array([prose_words(t) for t in b.column(3).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), words], names=["doc_id", "grade", "half", "words"])

    return rows.mapInArrow(run, "doc_id bigint, grade int, half bigint, words array<string>")


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model, or None without labels. Word counts are a Spark job; the weights are fitted on the bounded sample."""
    rows = cut_lineage(labelled_words(docs, labels))
    each = rows.select("grade", "half", F.explode(F.array_distinct("words")).alias("word"))
    counts = word_grades(each).groupBy("word").agg(
        *[F.coalesce(F.sum(F.when(F.col("half") == h, F.col(f"n{g}"))), F.lit(0)).alias(f"h{h}_{g}") for h in (-1, 0, 1) for g in range(3)]
    )
    total = sum(F.col(f"h{h}_{g}") for h in (-1, 0, 1) for g in range(3))
    kept = counts.withColumn("total", total).filter(F.col("total") >= MIN_TEXTS).orderBy("word").toArrow()
    if not kept.num_rows:
        return None
    words = kept.column("word").to_pylist()
    c = np.array([[kept.column(f"h{h}_{g}").to_numpy() for g in range(3)] for h in (-1, 0, 1)], dtype=float).transpose(2, 0, 1)
    by_half = np.stack([c[:, 1], c[:, 0] + c[:, 2]], 1)
    n = rows.groupBy("half", "grade").count().collect()
    texts = np.zeros((2, 3))
    for r in n:
        texts[abs(r["half"]), r["grade"]] += r["count"]
    other = [dict(zip(words, _grades(by_half[:, 1 - h], texts[1 - h]).tolist())) for h in (0, 1)]
    for h in (0, 1):
        seen = by_half[:, 1 - h].sum(1) > 0
        other[h] = {w: g for (w, g), s in zip(other[h].items(), seen) if s}
    grades = dict(zip(words, _grades(by_half.sum(1), texts.sum(0)).tolist()))
    tables = other

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            halves, lists = np.abs(b.column(2).to_numpy()), b.column(3).to_pylist()
            x = np.zeros((b.num_rows, len(QUANTILES) + 2))
            for h in (0, 1):
                at = np.flatnonzero(halves == h)
                if len(at):
                    f, k = features([lists[i] for i in at], tables[h])
                    x[at] = np.column_stack([f, k])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["grade", "x"])

    sample = rows.select("doc_id", "grade", "half", "words").mapInArrow(measure, "grade int, x array<double>").toArrow()
    y = sample.column("grade").to_numpy().astype(int)
    x = np.array(sample.column("x").to_pylist(), dtype=float).reshape(len(y), -1)
    known = x[:, -1] > 0
    usual = int(np.bincount(y, minlength=3).argmax())
    x, y = x[known, :-1], y[known]
    if not len(y):
        return None
    order = np.lexsort(x.T)
    x, y = x[order], y[order]
    centre, scale = x.mean(0), x.std(0) + 1e-6
    return Model(grades, centre, scale, _logistic((x - centre) / scale, y), usual)


def reading_bands(docs: DataFrame, labels: DataFrame, *also: str) -> DataFrame:
    """``doc_id, n_words, band`` of every document, with the columns ``also``; words as split at white space."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words of MAX_LABELLED documents at most, each in MIN_TEXTS of them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [len(t.split()) if t else 0 for t in texts]
            if m is None:
                bands = [None] * len(texts)
            else:
                found = m.bands([prose_words(t) if t else [] for t in texts])
                bands = [None if t is None else BANDS[k] for t, k in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(bands, pa.string()), *b.columns[2:]], names=["doc_id", "n_words", "band", *also])

    rows = docs.select("doc_id", "text", *also)
    return rows.mapInArrow(run, ", ".join(["doc_id bigint, n_words bigint, band string", *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in also)]))
