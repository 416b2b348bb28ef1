"""Validity of a text in the language of its path."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from quillspark.llm.syntax import grammars, lexers, second
from quillspark.llm.syntax.tables import Tables

#: Language of each file extension.
LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".mjs": "javascript", ".go": "go", ".java": "java", ".json": "json"}


@functools.cache
def tables(language: str) -> Tables:
    """The tables of a language, built once for each Python worker."""
    return Tables(
        {"python": grammars.PYTHON, "go": grammars.GO, "java": grammars.JAVA, "json": grammars.JSON}.get(language) or grammars.script(language == "typescript")
    )


_TOKENS: dict[str, tuple[Callable, re.Pattern]] = {
    "python": (lexers.python_tokens, lexers._PYTHON),
    "go": (lexers.go_tokens, lexers._GO),
    "java": (lexers.java_tokens, lexers._JAVA),
    "json": (lexers.json_tokens, lexers._JSON),
    "javascript": (lambda t: lexers.script_tokens(t, False), lexers._SCRIPT),
    "typescript": (lambda t: lexers.script_tokens(t, True), lexers._SCRIPT),
}


def first_error(text: str, language: str) -> tuple[int, str] | None:
    """Line (from 1) and token of the first error that no continuation can mend, or None where the text is valid."""
    if language == "tsx":
        return _first_error_beside_elements(text)
    cutter, pattern = _TOKENS[language]
    classes, inserts, where = cutter(text)
    at = tables(language).parse(classes, inserts=inserts)
    if at < 0:
        at = _second(text, language, classes, inserts, where, pattern)
    if at < 0 and language in ("javascript", "typescript") and "${" in text:
        at = _templates(text, language, classes)
    if at < 0:
        return None
    raw = where[at] if where and at < len(where) else at
    shift = 1 if language == "python" else 0
    source = "\n" * shift + text
    for n, m in enumerate(pattern.finditer(source)):
        if n == raw:
            return source.count("\n", 0, m.start(1)) + 1 - shift, m[1][:80]
    return text.count("\n") + 1, ""


def _second(text: str, language: str, classes: list[str], inserts: frozenset[int], where: list[int], pattern: re.Pattern) -> int:
    if language == "python":
        tokens = lexers.cut(pattern, "\n" + text)
        return second.python_error(classes, [tokens[w] for w in where])
    if language == "java":
        return second.java_error(classes)
    return second.script_error(classes, inserts) if language in ("javascript", "typescript") else -1


def _is_expression(text: str) -> bool:
    """Whether a text is one Python expression, as the fields of f-strings hold it."""
    classes, inserts, where = lexers.python_tokens(f"({text}\n)\n")
    if tables("python").parse(classes, inserts=inserts) >= 0:
        return False
    tokens = lexers.cut(lexers._PYTHON, f"\n({text}\n)\n")
    return second.python_error(classes, [tokens[w] for w in where]) < 0


second.use(_is_expression)


def _first_error_beside_elements(text: str) -> tuple[int, str] | None:
    """As ``first_error`` for TypeScript with elements: these must be well formed, and what stands in their braces valid."""
    if "/>" not in text and "</" not in text:
        return first_error(text, "typescript")
    got = lexers.without_elements(text)
    if got is None:
        return first_error(text, "typescript") or (text.count("\n") + 1, "<")
    plain, inside = got
    error = first_error(plain, "typescript")
    if error:
        return error
    for part in inside:
        if part and _first_error_beside_elements(f"({part}\n);") and not _COMMENTS.fullmatch(part):
            return text.count("\n", 0, text.find(part)) + 1, part.strip()[:80]
    return None


_COMMENTS = re.compile(r"(?:\s|//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/)*")


@functools.lru_cache(maxsize=50_000)
def _template_is_valid(template: str, language: str) -> bool:
    """Whether all expressions inside a template literal are valid."""
    i = 1
    while True:
        i = template.find("${", i)
        if i < 0:
            return True
        if template[i - 1] == "\\":
            i += 2
            continue
        depth, j = 1, i + 2
        while j < len(template) and depth:
            m = _INSIDE.match(template, j)
            depth += {"{": 1, "}": -1}.get(m[0], 0)
            j = m.end()
        inner = template[i + 2 : j - 1]
        classes, inserts, _ = _TOKENS[language][0](inner)
        if tables(language).parse(["(", *classes[:-1], ")", ";", "END"]) >= 0 or any(not _template_is_valid(t, language) for t in lexers.cut(lexers._SCRIPT, inner) if t[:1] == "`" and "${" in t):
            return False
        i = j


_INSIDE = re.compile(rf"{lexers._JS_STRING}|{lexers._TEMPLATE}|[\s\S]")


def _templates(text: str, language: str, classes: list[str]) -> int:
    """Place of the first template literal with an invalid expression, or -1."""
    if "TEMPLATE" not in classes:
        return -1
    tokens = [t for t in lexers.cut(lexers._SCRIPT, text) if t[:1] != "\n"]
    for i, c in enumerate(classes):
        if c == "TEMPLATE" and "${" in tokens[i] and not _template_is_valid(tokens[i], language):
            return i
    return -1
