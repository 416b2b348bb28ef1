"""Credentials in source code, configuration and documents (problem 3).

A value stands out when a public tokenizer needs many subwords for it: its characters per
subword fall below those of words and names. Such strings count together with the rules
of their context: the name they are given to, a vendor's format, a URL, connection string
or header around them, a private key block. Literals joined by ``+`` are read as one value.
Redaction puts a mask of the same length over the value, so every other offset stays and
quotes and brackets remain as they were.

Defined results: null contents hold nothing; a null ``start_line`` counts as 1; the same
row delivered again gives the same lines once; a value over several lines counts at its
first; placeholders, references to environment or vault, hashes, ids, public keys and
masked values don't count. Empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.tokenizer import TOKENIZER_DIR, encoder
from quillspark.session import cut_lineage

#: Below this many characters per subword a string is no word or name.
NATURAL = 3.3
#: Below this, letters of both cases alone are random too.
RANDOM = 2.3
MASK = "x"

# Names of credentials, in several languages, as parts of identifiers (lower case).
_NAME = (
    r"pass(?:word|wd|wort|phrase|code)?|pwd|secret(?:_?access)?(?:_?key)?|token|api[_.-]?key|access[_.-]?key|private[_.-]?key|signing[_.-]?key|encryption[_.-]?key|account[_.-]?key|shared[_.-]?key|master[_.-]?key|license[_.-]?key|auth(?:[_.-]?key)?"
    r"|service[_.-]?key|credential|cred|pat|parola|sifre|şifre|wachtwoord|mot[_.-]?de[_.-]?passe|contrase[nñ]a|clave|senha|kennwort|geheimnis|heslo|haslo|lozinka"
)
#: Everything that a value can stand behind or begin with, looked for in one pass over the lower-case text.
_SIGNS = re.compile(
    rf"(?P<name>{_NAME})|(?P<vendor>gh[pousr]_|github_pat_|glpat-|xox[abeoprs]-|[sr]k_(?:live|test)_|sk-|pk-|rk-|npm_|sg\.|aiza|akia|asia|hf_|pypi-|dop_v1_|eyj)|(?P<url>://)"
    r"|(?P<bearer>bearer[ \t])|(?P<basic>basic[ \t])|(?P<user>(?:-u|--user)[ =])|(?P<block>-----begin )|(?P<call>(?:login|connect|sign_?in|basic_?auth|open_?session)\()"
)
_HEAD = re.compile(r"[\w.-]*$")
_LITERAL = r"(?:\"(?P<v1>[^\"\n]{4,}+)\"|'(?P<v2>[^'\n]{4,}+)'|`(?P<v3>[^`\n]{4,}+)`)"
# Behind the name: its end, the type, the sign of assignment (or the comma of a call), a fallback's call, and the literal.
_QUOTED = re.compile(
    rf"(?P<tail>\w*+)[\"'\]]*+(?:\s*:\s*[\w<>\[\]?.]+(?=\s*=))?\s*+(?:=>|:=|\?\?=|=|:|,|is\b)[\s(\\>|-]*+(?:[\w.]+(?:\[[^\]\n]*\]|\([^()\n]*\))?\s*(?:\|\||\?\?|or\b)\s*)?"
    rf"(?:[\w.]+\(\s*[\"'][^\"'\n]*[\"']\s*,\s*)?[rbuRBU]?{_LITERAL}"
)
_BARE = re.compile(r"(?P<tail>\w*+)[ \t]*+(?:=|:|is\b)[ \t]*+(?P<v>[^\s\"'`,;<>(){}\[\]][^\s\"'`;<>]{5,}+)")
_CALL = re.compile(rf"(?i)(?:login|authenticate|auth|connect|sign_?in|basic_?auth|open_?session|credentials?)\(\s*[\"'][^\"'\n]*[\"']\s*,\s*{_LITERAL}")
_VENDOR = re.compile(
    r"(?:gh[pousr]_[A-Za-z0-9]{20,}+|github_pat_[A-Za-z0-9_]{20,}+|glpat-[A-Za-z0-9_-]{16,}+|xox[abeoprs]-[A-Za-z0-9-]{10,}+|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+"
    r"|(?:sk|pk|rk)-(?:[a-z]+-)?[A-Za-z0-9_-]{20,}+|npm_[A-Za-z0-9]{30,}+|SG\.[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{16,}+|AIza[A-Za-z0-9_-]{30,}+|(?:AKIA|ASIA)[A-Z0-9]{12,}+|hf_[A-Za-z0-9]{30,}+"
    r"|pypi-[A-Za-z0-9_-]{40,}+|dop_v1_[a-f0-9]{40,}+|eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{16,}+)"
)
_IN_WORD = re.compile(r"[A-Za-z0-9_/+]")
_ONE = r"[rbuRBU]?(?:\"[^\"\n]++\"|'[^'\n]++'|`[^`\n]++`)"
# Literals that stand for one value: put together by a sign or by nothing, or listed for a join.
_JOIN = re.compile(r"[\"'`]\s*\+?\s*[rbuRBU]?[\"'`]|[\"'`]\s*,\s*[\"'`]")
_JOINED = re.compile(rf"{_ONE}(?:\s*+\+?\s*+{_ONE})+")
_LISTED = re.compile(rf"(?P<open>(?:[\"'][\"']\s*\.\s*|strings\.|String\.)?[jJ]oin\(\s*(?:[\"'][\"']\s*,\s*)?(?:[\[(]|\[\]string\{{)?|\[)\s*(?P<list>{_ONE}(?:\s*+,\s*+{_ONE})+)\s*,?\s*(?P<close>[\])}}]*\s*(?:\.\s*join\()?)")
_BEFORE_JOINED = re.compile(r"(?P<tail>\w*+)[\"'\]]*+(?:\s*:\s*[\w<>\[\]]+)?\s*(?::=|=|:|,)[\s(]*(?:new\s+\w+\(|[\w.]+\()?\s*$")
_PARTS = re.compile(r"\"([^\"\n]*)\"|'([^'\n]*)'|`([^`\n]*)`")
# What opens a list that is joined, left out before the sign of assignment is looked for.
_OPENS = re.compile(r"(?:[\"'][\"']\s*\.\s*|strings\.|String\.)?[jJ]oin\(\s*(?:[\"'][\"']\s*,\s*)?(?:\[\]string\{|[\[(])?\s*$|\[\s*$")
_USERINFO = re.compile(r"://[^\s/:@\"'`<>]*+:(?P<v>[^\s/@\"'`<>]{3,}+)@[\w\[]")
_CONNECTION = re.compile(r"(?P<tail>\s*)=\s*(?P<v>[^;\"'`\s]{4,}+)[;\"'`]")
_HEADER = re.compile(r"\w+[ \t]+(?P<v>[A-Za-z0-9._~+/=-]{12,}+)")
_BASIC = re.compile(r"\w+[ \t]+(?P<v>[A-Za-z0-9+/]{8,}+={0,2})")
_CURL = re.compile(r"-+\w+[ =]+[\"']?[\w.@-]+:(?P<v>[^\s\"']{4,}+)")
_KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<body>[\s\S]*?)(?:-----END|\Z)")
_CUT_BODY = re.compile(r"[\sA-Za-z0-9+/=]*")
_KEY_BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")

_PLACEHOLDER = re.compile(
    r"(?i)^(?:[x*.#_-]+|.*\b(?:change[_-]?me|changeit|example|placeholder|dummy|sample|redacted|masked|removed|your[_-].*|todo|fixme|insert|fill[_-]?in|set[_-]in|set[_-]me|not[_-]?set|none|null|undefined|secret|password|passwd|test|foo|bar)\b.*"
    r"|.*(?:changeme|your[_-]|todo|redacted|placeholder|example[_-]?|set[_-]me).*|<.*>|\[.*\]|\{.*\}|\$.*|%.*%|@.*@|.*\$\{.*\}.*|.*\{\{.*\}\}.*|.*<[a-z_ -]+>.*|.*x{6,}.*|.*\*{4,}.*|process\.env.*|os\.environ.*|vault:.*|env:.*|secret:.*|arn:.*|ref\+.*)$"
)
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")
_HASH = re.compile(r"^(?:sha\d+[-:=]|md5[-:]|\$2[aby]\$|\$argon2|pbkdf2|data:|ssh-(?:rsa|ed25519) |https?:)")


class Judge:
    """Decides whether a string is a usable value; remembers subword counts through the encoder."""

    def __init__(self, folder: str = TOKENIZER_DIR) -> None:
        self.encoder = encoder(folder)

    def characters_per_subword(self, value: str) -> float:
        return len(value) / max(1, self.encoder.length(value))

    def unnatural(self, value: str) -> bool:
        return self.characters_per_subword(value) < NATURAL

    def usable(self, value: str, least: int = 8) -> bool:
        """No placeholder, reference, hash or id, and unnatural for a text of letters, digits and signs."""
        if len(value) < least or any(c.isspace() for c in value) or _PLACEHOLDER.match(value) or _UUID.match(value) or _HASH.match(value):
            return False
        letters, digits = any(c.isalpha() for c in value), any(c.isdigit() for c in value)
        signs = any(not c.isalnum() for c in value)
        mixed = any(c.islower() for c in value) and any(c.isupper() for c in value)
        if not letters or not (digits or signs and mixed or mixed and self.characters_per_subword(value) < RANDOM) or re.search(r"\w\(|\)\.|^[\w.]+\[|^/|^\./", value):
            return False
        return self.unnatural(value)


def _good_name(head: str, name: str, tail: str) -> bool:
    """Whether an identifier of these parts holds a value rather than a hint, a path or a hash of one."""
    if tail and not re.fullmatch(r"(?i)(?:_?(?:value|key|prod|production|staging|dev|live|old|new|default|current|primary|secondary|plain|raw|str|string|\d+)|s)*", tail):
        return False
    if re.search(r"(?i)(?:public|verify)[_-]?$", head):
        return False
    if head and name.lower() in ("pat", "pass", "auth", "clave", "token", "pwd", "cred", "parola", "senha"):
        # inside an identifier the word must begin at a border
        return head[-1] in "._-" or name[0].isupper() and (head[-1].islower() or head[-1].isdigit())
    return True


def _value(m: re.Match) -> str:
    return next(g for g in ("v1", "v2", "v3") if m[g] is not None)


def find(text: str, judge: Judge) -> list[tuple[int, int]]:
    """Spans (start, end) of credential values in a text, in order and apart."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    spans: list[tuple[int, int]] = []
    names: list[tuple[int, int]] = []

    def take(m: re.Match | None, g: str, least: int) -> None:
        if m and judge.usable(m[g].rstrip(".,") if g == "v" else m[g], least):
            spans.append((m.start(g), m.start(g) + len(m[g].rstrip(".,")) if g == "v" else m.end(g)))

    for sign in _SIGNS.finditer(low):
        kind, at, end = sign.lastgroup, sign.start(), sign.end()
        if kind == "name":
            m = _QUOTED.match(text, end)
            bare = None if m else _BARE.match(text, end)
            names.append((at, end))
            if not m and not bare:
                m = _CALL.match(text, at) if sign[0] == "auth" or sign[0] == "credential" else None
                if m:
                    take(m, _value(m), 8)
                continue
            head = _HEAD.search(text, max(0, at - 60), at)[0]
            if _good_name(head, text[at:end], (m or bare)["tail"]):
                if m:
                    take(m, _value(m), 8)
                else:
                    take(bare, "v", 8)
            if sign[0] in ("pwd", "password", "accountkey") and at and text[at - 1] in ";\"'` ":
                take(_CONNECTION.match(text, end), "v", 6)
        elif kind == "vendor":
            m = _VENDOR.match(text, at)
            if m and not (at and _IN_WORD.match(text, at - 1) and text[at - 1] != "n") and not _PLACEHOLDER.match(m[0]) and any(c.isdigit() for c in m[0]) and judge.unnatural(m[0]):
                spans.append(m.span())
        elif kind == "url":
            take(_USERINFO.match(text, at), "v", 6)
        elif kind == "bearer":
            take(_HEADER.match(text, at), "v", 12)
        elif kind == "basic":
            m = _BASIC.match(text, at)
            try:
                user, _, secret = base64.b64decode(m["v"], validate=True).decode("utf-8").partition(":") if m else ("", "", "")
            except (binascii.Error, ValueError):
                continue
            if user.isprintable() and judge.usable(secret, 6):
                spans.append(m.span("v"))
        elif kind == "user":
            take(_CURL.match(text, at), "v", 6)
        elif kind == "call":
            m = _CALL.match(text, at)
            if m:
                take(m, _value(m), 8)
        elif kind == "block":
            m = _KEY_BLOCK.match(text, at)
            body = m["body"].replace("\\n", "\n") if m else ""
            runs = [x for x in _KEY_BODY.findall(body) if set(x) != {MASK}]
            # a block that the chunk's end cuts off may have lost its body
            if m and (sum(map(len, runs)) >= 32 or m.end() == len(text) and _CUT_BODY.fullmatch(body) and set(body.split()) <= set(runs)):
                spans.append((m.start(), m.end("body")))
    if _JOIN.search(text):
        lists = [(m.span("list"), m["list"]) for m in _LISTED.finditer(text) if "oin(" in m["open"] or "join" in m["close"]]
        for (start, end), literals in lists + [(m.span(), m[0]) for m in _JOINED.finditer(text)]:
            value = "".join(a or b or c for a, b, c in _PARTS.findall(literals))
            if not _VENDOR.fullmatch(value):
                near = [n for n in names if start - 120 <= n[1] <= start]
                head = text[near[-1][1] : start] if near else ""
                before = near and _BEFORE_JOINED.match(_OPENS.sub("", head))
                if not before or not _good_name(_HEAD.search(text, max(0, near[-1][0] - 60), near[-1][0])[0], text[slice(*near[-1])], before["tail"]) or not judge.usable(value):
                    continue
            elif _PLACEHOLDER.match(value):
                continue
            spans.append((start, end))
    spans.sort()
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each value masked by as many signs, so that every offset stays and code and configuration parse as before.

    Quotes, what joins literals, line breaks with the indentation and comment signs behind them, and the opening line of
    a key block stay; a whole escape is masked, and the mask is a plain scalar in every configuration format.
    """
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        out.append(_COVER.sub(lambda m: m[0] if m[1] else MASK * len(m[0]), text[a:b]))
        at = b
    out.append(text[at:])
    return "".join(out)


_COVER = re.compile(
    r"(-----BEGIN [A-Z0-9 ]+-----|[\"'`]\s*[+,.&|]*\s*(?:\\\s*)?[rbuRBU]?[\"'`]|\\?[\r\n]+[ \t]*(?:#+|//+|\*(?!/)|--(?!-)|;|>)?[ \t]*|[\"'`])"
    r"|\\(?:u\{[^}]*\}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2}|N\{[^}]*\}|[0-7]{1,3}|[^\r\n])|[^\\\r\n\"'`]"
)


def findings(chunks: DataFrame, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``id, repo_id, indexed_at, line, start, length`` of each value of each row (rows delivered again included)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(folder)
        for b in batches:
            rows, line, start, length = [], [], [], []
            for i, (first, text) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist())):
                for a, e in find(text, judge):
                    rows.append(i)
                    line.append((1 if first is None else first) + text.count("\n", 0, a))
                    start.append(a)
                    length.append(e - a)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(at) for c in range(3)), pa.array(line, pa.int32()), pa.array(start, pa.int32()), pa.array(length, pa.int32())], names=["id", "repo_id", "indexed_at", "line", "start", "length"]
            )
            judge.encoder.tidy()

    rows = chunks.filter("id is not null and content is not null").select("id", "repo_id", "indexed_at", "start_line", "content")
    return rows.mapInArrow(run, "id string, repo_id string, indexed_at string, line int, start int, length int")


def redacted(chunks: DataFrame, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``id, indexed_at, content, redactions`` of each row that holds a credential; a row delivered again unchanged comes out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(folder)
        for b in batches:
            rows, texts, counts = [], [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                spans = find(text, judge)
                if spans:
                    rows.append(i)
                    texts.append(redact(text, spans))
                    counts.append(len(spans))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["id", "indexed_at", "content", "redactions"])
            judge.encoder.tidy()

    rows = chunks.filter("content is not null").select("id", "indexed_at", "content")
    return rows.mapInArrow(run, "id string, indexed_at string, content string, redactions int").distinct()


def found_lines(chunks: DataFrame) -> DataFrame:
    """``id, line``: one row for each chunk and line on which a value starts."""
    return findings(chunks).select("id", "line").distinct()


def by_run(chunks: DataFrame, stats: DataFrame) -> DataFrame:
    """``repo_id, run_id, finished_at, reported, found``: what each run reported against the values in the chunks that it wrote.

    A chunk belongs to the first run of its repository that finished at or after its ``indexed_at``. Runs and chunk rows
    delivered again count once. Values of chunks without a run (indexed after the last one, at no known time, or in a
    repository without runs) stand in one row of their repository with a null run.
    """
    values = findings(chunks).select("repo_id", "id", "indexed_at", "start", "length").distinct().withColumn("at", F.expr("try_cast(indexed_at as timestamp)"))
    found = values.groupBy("repo_id", "at").agg(F.count("*").alias("found"))
    latest = F.max(F.struct("finished_at", "redactions")).alias("r")
    runs = cut_lineage(stats.groupBy("repo_id", "run_id").agg(latest).select("repo_id", "run_id", "r.finished_at", F.col("r.redactions").alias("reported")))
    ended = runs.filter("finished_at is not null and run_id is not null").select("repo_id", F.col("finished_at").cast("timestamp").alias("at"), "run_id", F.lit(0).cast("bigint").alias("found"))
    both = ended.union(found.select("repo_id", "at", F.lit(None).cast("string").alias("run_id"), "found"))
    # from the latest time back: the last run seen is the first that finished afterwards; rows of no time come before all runs
    later = Window.partitionBy("repo_id").orderBy(F.desc_nulls_first("at"), F.desc_nulls_last("run_id")).rowsBetween(Window.unboundedPreceding, 0)
    owned = both.withColumn("run_id", F.last("run_id", True).over(later)).groupBy("repo_id", "run_id").agg(F.sum("found").alias("found"))
    mine = owned.filter("run_id is not null").withColumnsRenamed({"repo_id": "repo", "run_id": "run"})
    each = runs.join(mine, runs.repo_id.eqNullSafe(mine.repo) & (runs.run_id == mine.run), "left").drop("repo", "run").fillna(0, ["found"])
    none = owned.filter("run_id is null and found > 0")
    return each.unionByName(none, allowMissingColumns=True)
