"""Encoding of texts with a public byte-level BPE vocabulary (problem 6).

A sentencepiece BPE model is serialised straight from the vocabulary file: each
token becomes a piece (its bytes mapped to printable characters) whose score is
its negative rank, under the identity normaliser. Pre-tokens are encoded by that
model; decoding maps the pieces back to bytes.

Defined results: null and empty texts give an empty list; white space alone is
encoded like any other text; special-token strings inside a text are ordinary
text; a row occurs as often in the result as in the input; an empty table gives
an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public tokenizers lie; a parameter of every function below.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens of the vocabulary's own splitter.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same classes where a text holds ASCII only.
ASCII_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Python counts these four controls as white space, the splitter doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")
CACHE_ENTRIES = 200_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> dict[bytes, int]:
    ranks = {}
    with open(f"{folder}/{name}", "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, kind: int, payload: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(payload)) if kind == 2 else b"") + payload


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model in protobuf's wire format; piece number = token id, one unknown piece behind the last."""
    import struct

    chars = byte_characters()
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        text = "".join(chars[b] for b in token).encode()
        pieces[rank] = _field(1, 2, text) + _field(2, 5, struct.pack("<f", -float(rank)))
    unknown = _field(1, 2, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, _varint(2))
    model = b"".join(_field(1, 2, p) for p in [*pieces, unknown])
    off = _varint(0)
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(len(pieces) + 1)) + _field(40, 0, _varint(len(pieces)))
    normaliser = _field(1, 2, b"identity") + _field(3, 0, off) + _field(4, 0, off) + _field(5, 0, off)
    return model + _field(2, 2, trainer) + _field(3, 2, normaliser)


class Encoder:
    """Ids of texts; remembers the ids of pre-tokens it has met, up to ``CACHE_ENTRIES``."""

    def __init__(self, folder: str = TOKENIZER_DIR) -> None:
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(read_ranks(folder)))
        self.split_any = regex.compile(PRETOKEN).findall
        self.to_chars = {b: c for b, c in enumerate(byte_characters())}
        self.known: dict[str, list[int]] = {}

    def split(self, text: str) -> list[str]:
        if text.isascii() and not ODD_SPACE.search(text):
            return ASCII_PRETOKEN.findall(text)
        return self.split_any(text)

    def learn(self, tokens: set[str]) -> None:
        """Encode the pre-tokens not met before, all in one call."""
        new = [t for t in tokens if t not in self.known]
        if new:
            mapped = [t.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_chars) for t in new]
            self.known.update(zip(new, self.model.encode(mapped, num_threads=1)))

    def ids(self, text: str) -> list[int]:
        tokens = self.split(text)
        self.learn(set(tokens))
        known, out = self.known, []
        for t in tokens:
            out += known[t]
        return out

    def length(self, text: str) -> int:
        tokens = self.split(text)
        self.learn(set(tokens))
        known = self.known
        return sum([len(known[t]) for t in tokens])

    def tidy(self) -> None:
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()


@functools.lru_cache(maxsize=2)
def encoder(folder: str = TOKENIZER_DIR) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(folder)


def decode(ids: list[int], folder: str = TOKENIZER_DIR) -> str:
    """The text of a list of ids."""
    e = encoder(folder)
    back = {c: b for b, c in e.to_chars.items()}
    raw = bytes(back[c] for i in ids for c in e.model.id_to_piece(i))
    return raw.decode("utf-8", "replace")


def encode_corpus(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``id_column`` and ``ids`` (list of integers) of each row; no shuffle, each partition by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder)
        for batch in batches:
            flat, ends = [], [0]
            for text in batch.column(1).to_pylist():
                if text:
                    flat += e.ids(text)
                ends.append(len(flat))
            e.tidy()
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_column, "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, id_column: str, text_column: str, keep: list[str] = (), folder: str = TOKENIZER_DIR) -> DataFrame:
    """``n_tokens`` beside the id (and the columns of ``keep``), null texts counted as 0."""
    columns = [id_column, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder)
        for batch in batches:
            counts = [e.length(t) if t else 0 for t in batch.column(len(columns)).to_pylist()]
            e.tidy()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(counts, pa.int64())], names=[*columns, "n_tokens"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, F.col(text_column)).mapInArrow(run, f"{schema}, n_tokens bigint")
