"""Files that no one of the team wrote by hand (problem 2).

Each file becomes a token stream without comments; identifiers, numbers and strings are
masked. Five-token shingles of the masked and of the plain stream get MinHash signatures,
banded, whatever the file's size; candidates are verified on the exact shingle
sets (Jaccard 0.8). What the clusters mean: a masked family within a repository is tool output
where its files repeat their shingles, as one across repositories is where they repeat them
more; plain clusters across repositories are copies of third-party source; streams of hardly
anything but literals are data dumps, short identifiers tell minified files: these two show in
a single file too, so that one without a twin is found (``route`` tells which have one). Lock
files show in their names and keys.

The members of a band's bucket are first compared with two representatives (the least and
the greatest file), as many pairs as members. Those that no verified link covers then are
compared with every member of their buckets whose number of shingles allows the similarity.

Defined results: chunks of null repo, path or content take no part; repeated chunks count
once; documents, configuration and declarations (``.md .yaml .json .sql`` ...) are judged
as lock files only; pages of markup under a source extension are no copies. Empty tables
give empty tables; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.source_files import extension, file_text, gathered
from quillspark.session import cut_lineage

SHINGLE, SIMILARITY = 5, 0.8
#: Bands, hashes of each, and bands that a pair must share: a pair of similarity 0.8 does in 9,996 of 10,000 cases.
BANDS, ROWS, SHARED = 20, 4, 2
#: Tool output: so often each masked shingle occurs on average in a family of one repository, in one across repositories, in a file alone.
WITHIN, REPEATS, ALONE = 5.0, 6.0, 8.0
#: Data dumps: share of literals among the tokens, and distinct masked shingles at most.
LITERALS, PLAIN = 0.38, 60
#: Minified: share of identifiers of up to two characters.
SHORT = 0.5

SOURCE = (".py", ".ts", ".tsx", ".js", ".mjs", ".cjs", ".jsx", ".go", ".java", ".kt", ".scala", ".c", ".h", ".cc", ".cpp", ".hpp", ".cs", ".rb", ".php", ".rs", ".swift", ".css")
LOCK_NAMES = (
    "package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml bun.lock deno.lock poetry.lock pdm.lock uv.lock pipfile.lock cargo.lock gemfile.lock composer.lock go.sum packages.lock.json mix.lock podfile.lock pubspec.lock flake.lock gradle.lockfile"
).split()

_STRINGS = r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\[\s\S])*+`"
_SLASHES = re.compile(rf"(?:\s|//[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z))*+({_STRINGS}|[^\W\d]\w*+(?:\$\w*)*|\$[\w$]*+|\d[\w.]*+|\Z|[^\s\w])")
_HASHES = re.compile(rf"(?:\s|#[^\n]*)*+(\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''|{_STRINGS}|[^\W\d]\w*+|\d[\w.]*+|\Z|[^\s\w])")
_KEYWORDS = frozenset(
    "if else for while do return const let var function class import export from async await new type interface enum def with try catch except finally case switch match public private protected static final extends implements throw throws func go defer"
    " struct map chan package as of in is not and or lambda yield default get set break continue void int long double float boolean bool char string String null nil None true false True False this self raise assert pass elif select range any use fn pub mod impl".split()
)
_LOCK_KEY = re.compile(r"\"lockfileVersion\"\s*:|\"integrity\"\s*:\s*\"sha\d+-|^# yarn lockfile|^\[metadata\.files\]|^content-hash = ", re.M)


class Hashes(dict):
    """Hash of each token text, plain and masked, worked out once."""

    def __missing__(self, token: str) -> tuple[int, int, int]:
        c = token[0]
        kind = 0
        masked = token
        if c in "\"'`":
            masked, kind = "S", 1
        elif c.isdigit():
            masked, kind = "N", 1
        elif (c.isalpha() or c in "_$") and token not in _KEYWORDS:
            masked, kind = "I", 3 if len(token) <= 2 else 2
        got = (zlib.crc32(token.encode("utf-8", "surrogatepass")), zlib.crc32(masked.encode()), kind)
        if len(self) < 300_000:
            self[token] = got
        return got


@functools.cache
def permutations() -> tuple[np.ndarray, np.ndarray]:
    """Odd 64-bit factors and shifts: products must wrap, or all would order the hashes alike."""
    rng = np.random.default_rng(2)
    return rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def shingles(tokens: np.ndarray) -> np.ndarray:
    """Distinct 32-bit hashes of the runs of five token hashes."""
    if len(tokens) < SHINGLE:
        return np.zeros(0, np.uint32)
    n = len(tokens) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        h = (h ^ tokens[i : i + n]) * _MIX[i]
        h ^= h >> np.uint64(29)
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


def bands(sets: np.ndarray) -> list[int]:
    """The band keys of a set of shingles."""
    if not len(sets):
        return []
    a, b = permutations()
    least = np.full(len(a), 1 << 32, np.uint64)
    for at in range(0, len(sets), 4096):
        part = sets[at : at + 4096].astype(np.uint64)
        least = np.minimum(least, ((a[:, None] * part[None, :] + b[:, None]) >> np.uint64(32)).min(1))
    key = least.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        out = (out ^ key[:, r]) * _MIX[r]
        out ^= out >> np.uint64(31)
    return out.astype(np.int64).tolist()


def describe(path: str, text: str, seen: Hashes) -> tuple[str, np.ndarray, np.ndarray, float]:
    """What a file shows by itself (``kind`` or ''), its masked and plain shingles, and repeats of a masked shingle."""
    name = path.rsplit("/", 1)[-1].lower()
    nothing = np.zeros(0, np.uint32)
    if name in LOCK_NAMES or not name.endswith(SOURCE) and len(_LOCK_KEY.findall(text)) >= 3:
        return "lock", nothing, nothing, 0.0
    if not name.endswith(SOURCE):
        return "", nothing, nothing, 0.0
    tokens = [t for t in (_HASHES if name.endswith((".py", ".rb")) else _SLASHES).findall(text) if t]
    if not tokens or tokens[0] == "<":
        return "", nothing, nothing, 0.0
    h = np.array([seen[t] for t in tokens], dtype=np.uint64)
    masked, plain, kinds = shingles(h[:, 1]), shingles(h[:, 0]), h[:, 2]
    identifiers = int((kinds >= 2).sum())
    repeats = len(tokens) / max(1, len(masked))
    if len(tokens) >= 80 and identifiers >= 20 and (kinds == 3).sum() > SHORT * identifiers:
        return "minified", masked, plain, repeats
    if len(tokens) >= 60 and (kinds == 1).sum() > LITERALS * len(tokens) and len(masked) <= PLAIN:
        return "data", masked, plain, repeats
    return "", masked, plain, repeats


def described(chunks: DataFrame) -> DataFrame:
    """``repo_id, path, kind, masked, plain, repeats, masked_bands, plain_bands`` of each file; bands only of what a cluster could decide, by shares, never by size."""
    columns = ["repo_id", "path", "kind", "masked", "plain", "repeats", "masked_bands", "plain_bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Hashes()
        for b in batches:
            rows: list[tuple] = []
            for path, parts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                kind, masked, plain, repeats = describe(path, file_text(parts), seen)
                family, copy = bool(kind) or repeats >= WITHIN, not kind
                rows.append((kind, masked.tobytes() if family else b"", plain.tobytes() if copy else b"", repeats, bands(masked) if family else [], bands(plain) if copy else []))
            kinds = (pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))] if rows else [b.column(0), b.column(1), *(pa.array([], k) for k in kinds)], names=columns)

    schema = "repo_id string, path string, kind string, masked binary, plain binary, repeats double, masked_bands array<bigint>, plain_bands array<bigint>"
    wanted = chunks.filter(extension().isin(list(SOURCE)) | F.lower(F.element_at(F.split("path", "/"), -1)).isin(LOCK_NAMES) | extension().isin(".json", ".yaml", ".yml", ".toml", ".lock", ".sum"))
    return gathered(wanted).select("repo_id", "path", "parts").mapInArrow(run, schema)


def verified(files: DataFrame, keys: str, sets: str, across: bool, least: int = SHARED) -> DataFrame:
    """``no, partners``: files (told by ``no``) with a verified partner that shares ``least`` of their bands (in another repository where ``across``).

    Only buckets of several files, and only the sets of their members, go further than the first count of keys.
    """
    posted = files.select("no", F.xxhash64("repo_id").alias("r"), F.length(sets).alias("n"), F.explode(keys).alias("key"))
    several = posted.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    kept = cut_lineage(posted.join(several, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            alike = []
            for a, b in zip(t.column(1).to_pylist(), t.column(2).to_pylist()):
                a, b = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
                common = len(np.intersect1d(a, b, assume_unique=True))
                alike.append(common >= SIMILARITY * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array(alike, pa.bool_())], names=["no", "alike"])

    def alike(pairs: DataFrame) -> DataFrame:
        """Of pairs (``no, r, n`` and ``g, gr, m``, once for each bucket) the files whose sets are similar."""
        pairs = pairs.filter((F.col("no") != F.col("g")) & (F.least("n", "m") >= SIMILARITY * F.greatest("n", "m")))
        pairs = (pairs.filter("r <> gr") if across else pairs).groupBy("no", "g").agg(F.count("*").alias("c"))
        pairs = cut_lineage(pairs.filter(F.col("c") >= least).select("no", "g"))
        busy = pairs.select(F.explode(F.array("no", "g")).alias("no")).distinct()
        held = cut_lineage(files.select("no", F.col(sets).alias("s")).join(busy, "no", "left_semi"))
        both = pairs.join(held.withColumnRenamed("s", "a"), "no").join(held.select(F.col("no").alias("g"), F.col("s").alias("b")), "g")
        return both.select("no", "a", "b").mapInArrow(run, "no bigint, alike boolean").filter("alike").select("no")

    file = F.struct("no", "r", "n")
    ends = kept.groupBy("key").agg(F.min(file).alias("low"), F.max(file).alias("high"))
    to_ends = kept.join(ends, "key").select("no", "r", "n", F.explode(F.array("low", "high")).alias("e")).select("no", "r", "n", F.col("e.no").alias("g"), F.col("e.r").alias("gr"), F.col("e.n").alias("m"))
    covered = cut_lineage(alike(to_ends))
    # the ends of a bucket say nothing of the links among its other members
    open_ = kept.join(covered.distinct(), "no", "left_anti")
    others = kept.select("key", F.col("no").alias("g"), F.col("r").alias("gr"), F.col("n").alias("m"))
    return covered.union(alike(open_.join(others, "key"))).groupBy("no").agg(F.count("*").alias("partners"))


def not_handwritten(chunks: DataFrame) -> DataFrame:
    """``repo_id, path, kind, route``: ``lock``, ``minified``, ``data``, ``generated`` or ``copied``, and how the clusters tell it.

    ``route``: ``repository`` (a masked twin in the repository), ``across`` (a twin in another one), ``alone`` or ``name``.
    """
    files = cut_lineage(described(chunks).withColumn("no", F.monotonically_increasing_id()))
    sources = files.filter("length(masked) > 0")
    in_repo = sources.withColumn("masked_bands", F.transform("masked_bands", lambda x: F.xxhash64(x, F.col("repo_id"))))
    within = verified(in_repo, "masked_bands", "masked", False).select("no", F.lit(True).alias("within"))
    across = verified(sources.filter((F.col("repeats") >= REPEATS) | (F.col("kind") != "")), "masked_bands", "masked", True).select("no", F.lit(True).alias("across"))
    copied = verified(files.filter("kind = '' and length(plain) > 0"), "plain_bands", "plain", True).select("no", F.lit(True).alias("copied"))
    told = files.select("no", "repo_id", "path", "kind", "repeats")
    for cluster in (within, across, copied):
        told = told.join(cluster, "no", "left")
    told = told.fillna(False, ["within", "across", "copied"])
    r = F.col("repeats")
    made = F.col("within") & (r >= WITHIN) | F.col("across") & (r >= REPEATS) | (r >= ALONE)
    kind = F.when(F.col("kind") != "", F.col("kind")).when(made, "generated").when(F.col("copied"), "copied")
    route = F.when(F.col("kind") == "lock", "name").when(F.col("kind") == "copied", "across").when(F.col("within"), "repository").when(F.col("across"), "across").otherwise("alone")
    return told.withColumn("kind", kind).filter("kind is not null").select("repo_id", "path", "kind", route.alias("route"))


def routes(found: DataFrame) -> DataFrame:
    """``kind, route, n_files``."""
    return found.groupBy("kind", "route").agg(F.count("*").alias("n_files"))
