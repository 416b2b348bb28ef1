"""Files as retrieval units: code by its declarations, Markdown by its headings, all else by paragraphs.

Spark brings the files together and cuts them in parallel; within a file one pass over its lines finds where top-level
statements begin (by indentation, brackets, strings and comments), large containers are opened into their members, and
neighbouring pieces are packed up to ``max_bytes``. What is longer is cut into windows of lines that share three lines.

Defined results: blank files have no units; every line that isn't blank lies in a unit; a line longer than ``max_bytes``
stands alone; offsets are lines, so units end at line ends; null texts and paths take no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import paths as P

HASH_COMMENTS = {"python", "ruby", "bash", "yaml", "toml", "r", "perl", "make", "dockerfile", "elixir", "julia", "powershell", "terraform", "starlark"}
BY_INDENTATION = {"python", "starlark", "nim"}
MAX_IMPORTS, OVERLAP = 10, 3
SCHEMA = (
    "repo_id string, path string, ordinal int, kind string, symbol string, parent_symbol string, start_line int, end_line int, part int, parts int, header string, symbols array<string>, text string"
)


@dataclass(frozen=True)
class Piece:
    """Lines ``first`` to ``end`` (exclusive, from 0) of a file; ``unit``: a declaration rather than filler."""

    first: int
    end: int
    symbol: str = ""
    kind: str = ""
    parent: str = ""
    unit: bool = False


_KINDS = {"func": "function", "fn": "function", "fun": "function", "def": "function", "sub": "function", "mod": "module", "let": "const", "val": "const", "static": "const"}
_CONTAINERS = {"class", "interface", "enum", "record", "struct", "trait", "namespace", "module", "object", "impl", "union", "protocol", "extension"}
_LEAD = re.compile(r"(?:\s|//[^\n]*|#(?!\w+\s*[<\"])[^\n]*|/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|@[\w.]+(?:\([^)]*\))?)*")
_DECLARED = re.compile(
    r"(?P<before>(?:[\w<>\[\],?&*:.@]+\s+)*?)(?P<word>class|interface|enum|record|struct|trait|namespace|module|object|impl|union|protocol|extension|function|func|fn|fun|def|sub|type|const|let|val|var|static|mod)\b\s*\*?\s*(?:\([^)]*\)\s*)?(?:mut\s+|\(\s*)?(?P<name>[\w$.:]+)"
)
_CALLABLE = re.compile(r"(?:[\w<>\[\],?&*:.$#]+\s+)*?(?P<name>[\w$#~]+)\s*(?:<[^<>]*>)?\s*\(")
_FIELD = re.compile(r"(?:[\w<>\[\],?&*:.$#]+\s+)*?(?P<name>[\w$#]+)\s*(?::[^=;]+)?(?:=(?!=)|;|$)")
_CONTROL = {"if", "for", "while", "switch", "return", "catch", "else", "do", "try", "with", "new", "throw", "import", "package", "using", "use", "from", "case", "elif", "except", "finally", "assert", "raise", "print", "super", "await", "require"}


def declared(text: str, parent: str) -> tuple[str, str]:
    """Kind and name of what a statement declares, ``''`` for filler."""
    head = text[_LEAD.match(text).end() :][:400]
    first = re.match(r"[\w$]*", head)[0]
    m = _DECLARED.match(head.split("{")[0].split("=")[0] or head)
    if m and first not in _CONTROL:
        kind = _KINDS.get(m["word"], m["word"])
        receiver = m["word"] == "func" and re.match(r"func\s*\(", head)
        return ("method" if kind == "function" and (parent or receiver) else kind), m["name"].rstrip(":.")
    if first in _CONTROL or not first:
        return "", ""
    m = _CALLABLE.match(head)
    if m and m["name"] not in _CONTROL and ("{" in head[m.end() :] or parent) and "=" not in head[: m.end()]:
        return ("method" if parent else "function"), m["name"]
    m = _FIELD.match(head.split("\n")[0])
    if m and m["name"] not in _CONTROL and (parent or "=" in head.split("\n")[0]):
        return ("field" if parent and "=" not in head else "const"), m["name"]
    return "", ""


_TOKEN = re.compile(
    r"\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\[\s\S])*`?|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|#[^\n]*|[()\[\]{}]|[^\"'`/#()\[\]{}]+|[\s\S]"
)


def depths(text: str, hashes: bool) -> list[int]:
    """For each line the bracket depth at its beginning, -1 where it begins inside a string or comment."""
    out, depth, n = [0], 0, 0
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t in "([{":
            depth += 1
        elif t in ")]}":
            depth = max(0, depth - 1)
        elif t[0] == "#" and not hashes and len(t) > 1:
            t = "#"
        lines = t.count("\n")
        if lines:
            code = t[0] not in "\"'`/#" or t[:2] == "//"
            out += [depth if code else -1] * lines
    return out


_GOES_ON = re.compile(r"\s*(?:[)\]}.,:?&|+*/=<>]|else\b|elif\b|except\b|finally\b|catch\b|while\b\s*\(.*;\s*$|\{)")


def statements(lines: list[str], depth: list[int], first: int, end: int, level: int, by_indentation: bool, indent: int) -> list[tuple[int, int]]:
    """Spans of lines of the statements between ``first`` and ``end`` at one level; blank lines between them belong to none."""
    starts: list[int] = []
    hold = False
    for i in range(first, end):
        line = lines[i]
        if not line.strip() or depth[i] != level:
            continue
        if by_indentation and len(line) - len(line.lstrip()) > indent:
            continue
        if hold or starts and _GOES_ON.match(line):
            hold = hold and line.lstrip().startswith("@")
            continue
        starts.append(i)
        # what a decorator or an annotation stands before is one statement with it
        hold = line.lstrip().startswith("@") and not re.search(r"[;{]\s*$", line)
    out = []
    for i, s in enumerate(starts):
        e = starts[i + 1] if i + 1 < len(starts) else end
        while e > s + 1 and not lines[e - 1].strip():
            e -= 1
        out.append((s, e))
    lead = next((i for i in range(first, end) if lines[i].strip()), end)
    if (not out or lead < out[0][0]) and lead < end:
        stop = out[0][0] if out else end
        while stop > lead + 1 and not lines[stop - 1].strip():
            stop -= 1
        out.insert(0, (lead, stop))
    return out


def size(lines: list[str], first: int, end: int) -> int:
    return sum(len(x.encode("utf-8", "surrogatepass")) + 1 for x in lines[first:end]) - 1 if end > first else 0


def code_pieces(lines: list[str], depth: list[int], first: int, end: int, level: int, by_indentation: bool, indent: int, parent: str, most: int) -> list[Piece]:
    """Pieces of the statements in order; containers larger than ``most`` are opened into head, members and rest."""
    out: list[Piece] = []
    for s, e in statements(lines, depth, first, end, level, by_indentation, indent):
        kind, symbol = declared("\n".join(lines[s:e][:60]), parent)
        piece = Piece(s, e, symbol, kind, parent, bool(symbol))
        if kind in _CONTAINERS and e - s > 2 and size(lines, s, e) > most:
            head = next((i for i in range(s + 1, e) if lines[i].strip() and (depth[i] == level + 1 if not by_indentation else depth[i] == level and len(lines[i]) - len(lines[i].lstrip()) > indent)), e)
            stop = e if by_indentation else next((i for i in range(e - 1, head, -1) if depth[i] <= level + 1 and lines[i].lstrip().startswith("}")), e)
            if head < stop:
                inner = len(lines[head]) - len(lines[head].lstrip())
                name = f"{parent}.{symbol}" if parent else symbol
                out.append(replace(piece, end=head))
                out += code_pieces(lines, depth, head, stop, level if by_indentation else level + 1, by_indentation, inner, name, most)
                if stop < e:
                    out.append(Piece(stop, e, parent=parent))
                continue
        out.append(piece)
    return out


def line_windows(lines: list[str], piece: Piece, most: int) -> list[Piece]:
    """Windows of whole lines of a piece, sharing ``OVERLAP`` lines where they are longer than that."""
    out, at = [], piece.first
    while at < piece.end:
        stop, total = at + 1, len(lines[at].encode("utf-8", "surrogatepass")) + 1
        while stop < piece.end and (n := len(lines[stop].encode("utf-8", "surrogatepass")) + 1) + total <= most + 1:
            total, stop = total + n, stop + 1
        out.append(replace(piece, first=at, end=stop))
        at = stop - OVERLAP if stop < piece.end and stop - at > OVERLAP else stop
    return out


def packed(lines: list[str], pieces: list[Piece], most: int, least: int, prose: bool = False) -> list[tuple[list[Piece], int, int]]:
    """Groups of neighbouring pieces within ``most`` bytes, with part and number of parts of what had to be cut; a unit closes a group of ``least`` bytes."""
    out: list[tuple[list[Piece], int, int]] = []
    held: list[Piece] = []

    def close() -> None:
        if held:
            out.append((list(held), 1, 1))
            held.clear()

    for p in pieces:
        if size(lines, p.first, p.end) > most:
            close()
            windows = paragraph_windows(lines, p, most) if prose else line_windows(lines, p, most)
            out += [([w], i, len(windows)) for i, w in enumerate(windows, 1)]
            continue
        if held and size(lines, held[0].first, p.end) > most:
            close()
        held.append(p)
        if p.unit and size(lines, held[0].first, p.end) >= least:
            close()
    close()
    return out


def paragraph_windows(lines: list[str], piece: Piece, most: int) -> list[Piece]:
    """A long piece of prose as paragraphs packed up to ``most`` bytes; a longer paragraph is cut at lines, none shared."""
    out: list[Piece] = []
    for q in paragraph_pieces(lines[piece.first : piece.end]):
        first, end = piece.first + q.first, piece.first + q.end
        if out and size(lines, out[-1].first, end) <= most:
            out[-1] = replace(out[-1], end=end)
        elif size(lines, first, end) <= most:
            out.append(replace(piece, first=first, end=end))
        else:
            at = first
            while at < end:
                stop, total = at + 1, len(lines[at].encode("utf-8", "surrogatepass"))
                while stop < end and total + 1 + (n := len(lines[stop].encode("utf-8", "surrogatepass"))) <= most:
                    total, stop = total + 1 + n, stop + 1
                out.append(replace(piece, first=at, end=stop))
                at = stop
    return out


HEADING = re.compile(r"^(#{1,6})[ \t]+(\S.*?)\s*$")


def section_pieces(lines: list[str]) -> list[Piece]:
    """A piece for each heading and for what stands before the first; ``parent`` holds the headings above, outermost first."""
    out, path, first, title = [], [], 0, ""
    for i, line in enumerate([*lines, "# end"]):
        m = HEADING.match(line)
        if m and (i > first or title or i == len(lines)):
            if any(x.strip() for x in lines[first:i]):
                out.append(Piece(first, i, title, "section", " > ".join(path[:-1]) if title else "", bool(title)))
            first = i
        if m and i < len(lines):
            del path[len(m[1]) - 1 :]
            path.append(m[2])
            first, title = i, m[2]
    return out


def paragraph_pieces(lines: list[str]) -> list[Piece]:
    """Paragraphs, with the blank lines behind them."""
    out, first = [], 0
    for i in range(1, len(lines) + 1):
        if i == len(lines) or not lines[i - 1].strip() and lines[i].strip():
            if any(x.strip() for x in lines[first:i]):
                out.append(Piece(first, i, kind="block"))
            first = i
    return out


_IMPORT = re.compile(r"\s*(?:import\b(?!\()|from\s+[\w.]+\s+import\b|using\s+[\w.]+\s*;|use\s+[\w:]+|require\b|#include\b|(?:const|let|var)\s+.*=\s*require\(|export\s+.*\bfrom\b)")
_SOURCE = re.compile(r"[\"'<]([^\"'>]+)[\"'>]")


def imports(lines: list[str]) -> list[str]:
    """What a file imports, at most ``MAX_IMPORTS`` names of 60 characters."""
    found: list[str] = []
    block = False
    for line in lines:
        if block and line.strip().startswith(")"):
            block = False
        if block or _IMPORT.match(line):
            block = block or bool(re.match(r"\s*import\s*\(\s*$", line))
            m = _SOURCE.search(line)
            name = m[1] if m else re.sub(r"^\s*(?:import(?:\s+static)?|from|using|use|require)?\s*", "", line).split(" import ")[0].strip().strip(";()").strip()
            if name and name[:60] not in found:
                found.append(name[:60])
        if len(found) >= MAX_IMPORTS:
            break
    return found


def cut(path: str, text: str, category: str, language: str | None, most: int, least: int) -> Iterator[tuple]:
    """The units of one file: kind, symbol, parent, first and last line, part, parts, header, symbols, text."""
    lines = text.split("\n")
    mark = "#" if category == "doc" or language in HASH_COMMENTS or not language else "//"
    used: list[str] = []
    if category == "doc":
        pieces = section_pieces(lines)
    elif language:
        by_indentation = language in BY_INDENTATION
        used = imports(lines)
        pieces = code_pieces(lines, depths(text, language in HASH_COMMENTS), 0, len(lines), 0, by_indentation, 0, "", most)
    else:
        pieces = paragraph_pieces(lines)
    for group, part, parts in packed(lines, pieces, most, least, category == "doc" or not language):
        first, end = group[0].first, group[-1].end
        if not any(x.strip() for x in lines[first:end]):
            continue
        while end > first + 1 and not lines[end - 1].strip():
            end -= 1
        lead = next((p for p in group if p.symbol), None)
        symbol, parent = (lead.symbol, lead.parent) if lead else ("", group[0].parent)
        kind = (lead.kind or "symbol") if lead else "section" if category == "doc" else "block"
        suffix = f" [part {part}/{parts}]" if parts > 1 else ""
        head = [f"{mark} file: {path}"]
        if category == "doc":
            if symbol:
                head.append(f"{mark} section: {' > '.join(filter(None, (parent, symbol)))}{suffix}")
        elif symbol:
            head.append(f"{mark} {kind}: {symbol}{f' (in {parent})' if parent else ''}{suffix}")
        elif parent:
            head.append(f"{mark} in: {parent}")
        if used:
            head.append(f"{mark} imports: {', '.join(used)}")
        yield kind, symbol, parent, first + 1, end, part, parts, "\n".join(head), list(dict.fromkeys(p.symbol for p in group if p.symbol)), "\n".join(lines[first:end])


def whole_files(chunks: DataFrame) -> DataFrame:
    """``repo_id, path, text`` of the files that chunk rows make up: laid out by line number, later chunks over earlier ones, lines in between blank."""
    part = F.struct(F.coalesce("start_line", F.lit(1)).alias("s"), F.coalesce("ordinal", F.lit(0)).alias("o"), F.col("content").alias("c"))
    rows = chunks.filter("repo_id is not null and path is not null and content is not null").groupBy("repo_id", "path").agg(F.sort_array(F.collect_set(part)).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for parts in b.column(2).to_pylist():
                lines: list[str] = []
                for p in parts:
                    new, at = p["c"].split("\n"), max(p["s"], 1) - 1
                    lines += [""] * (at - len(lines))
                    lines[at : at + len(new)] = new
                texts.append("\n".join(lines))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["repo_id", "path", "text"])

    return rows.mapInArrow(run, "repo_id string, path string, text string")


def chunk_files(files: DataFrame, max_bytes: int = 2000, min_bytes: int = 200) -> DataFrame:
    """The units of each file (``repo_id, path, text``), by the category and the language of its path; see ``SCHEMA``."""
    typed = files.filter("text is not null and path is not null").select("repo_id", "path", "text", P.category(F.col("path")).alias("category"), P.language(F.col("path")).alias("language"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string()]
        names = ["repo_id", "path", "ordinal", "kind", "symbol", "parent_symbol", "start_line", "end_line", "part", "parts", "header", "symbols", "text"]
        for b in batches:
            rows, out = [], []
            for i, (path, text, category, language) in enumerate(zip(*(b.column(c).to_pylist() for c in range(1, 5)))):
                for n, unit in enumerate(cut(path, text, category, language, max_bytes, min_bytes)):
                    rows.append(i)
                    out.append((n, *unit))
            at = pa.array(rows, pa.int64())
            columns = zip(*out) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=names)

    return typed.mapInArrow(run, SCHEMA)
