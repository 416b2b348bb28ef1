"""What one token ahead can't tell: a pass over a token stream that the tables accept.

Python: what may be assigned to, the order of parameters and arguments, displays that mix
entries, adjacent literals, fields of f-strings. Scripts: ``throw`` before a line end,
constants without a value, assignment to an updated operand. Java: values as statements.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

OPEN = {"(", "[", "{"}
CLOSE = {")", "]", "}"}


def pieces(c: list[str], begin: int, end: int, at: str) -> list[tuple[int, int]]:
    """Spans of the tokens from ``begin`` to ``end``, parted at the class ``at`` outside of brackets, lambdas and comprehensions' targets."""
    out, depth, first, lambdas, targets = [], 0, begin, 0, False
    for i in range(begin, end):
        x = c[i]
        if x in OPEN:
            depth += 1
        elif x in CLOSE:
            depth -= 1
        elif depth == 0 and (x == "for" or targets and x == "in"):
            targets = x == "for"
        elif depth == 0 and x == "lambda":
            lambdas += 1
        elif depth == 0 and x == ":" and lambdas:
            lambdas -= 1
        elif depth == 0 and x == at and not lambdas and not targets:
            out.append((first, i))
            first = i + 1
    out.append((first, end))
    return out


class Python:
    """Finds the first token that the second pass refuses; ``c`` classes, ``t`` texts of the same places."""

    def __init__(self, c: list[str], t: list[str]) -> None:
        self.c, self.t = c, t
        self.pair: dict[int, int] = {}
        self.opens: dict[int, int] = {}
        self.pattern: list[bool] = []
        stack: list[int] = []
        case = False
        for i, x in enumerate(c):
            if x in OPEN:
                stack.append(i)
            elif x in CLOSE and stack:
                self.opens[i] = stack[-1]
                self.pair[stack.pop()] = i
            case = x == "CASE" or case and x not in ("NEWLINE", "INDENT", "DEDENT")
            self.pattern.append(case)

    def target(self, begin: int, end: int, one: bool = False, starred: bool = True) -> int:
        """Place of what can't be assigned to, or -1; ``one``: a name, an attribute or a subscript only."""
        c = self.c
        parts = pieces(c, begin, end, ",")
        if len(parts) > 1 and one:
            return begin
        for a, b in parts:
            if a >= b:
                continue
            if c[a] == "*" and starred and not one:
                a += 1
                if a >= b:
                    return a - 1
            if c[a] in ("(", "[") and self.pair.get(a) == b - 1:
                if one and c[a] == "[":
                    return a
                if b - a > 2:
                    bad = self.target(a + 1, b - 1, one)
                    if bad >= 0:
                        return bad
                elif one:
                    return a
                continue
            if any(x in ("for", "if", "else", "lambda", "not", "await", "in", "is", ":=", "yield") or x in ("BINOP", "-", "*", "**", "@", "/", "|", "~") for x in self._flat(a, b)):
                return a
            last = c[b - 1]
            if last == "NAME":
                if b - a == 1 and self.t[a] in ("None", "True", "False") or b - a > 1 and c[b - 2] != ".":
                    return a
            elif last == "]":
                if b - a == 1 or self.opens.get(b - 1) == a:
                    return a
            else:
                return a
        return -1

    def _flat(self, a: int, b: int) -> list[str]:
        out, i = [], a
        while i < b:
            out.append(self.c[i])
            i = self.pair.get(i, i) + 1 if self.c[i] in OPEN else i + 1
        return out

    def statement(self, begin: int, end: int) -> int:
        """A simple statement from ``begin`` to ``end``."""
        c = self.c
        if begin >= end:
            return -1
        if c[begin] == "del":
            return self.target(begin + 1, end, starred=False)
        if c[begin] == "for" or c[begin] in ("return", "raise", "assert", "import", "from", "global", "nonlocal", "TYPE"):
            return -1
        sides = pieces(c, begin, end, "=")
        noted = pieces(c, begin, sides[0][1], ":")
        if len(noted) > 1:
            a, b = noted[0]
            return self.target(a, b, True) if c[a] != "(" or self.pair.get(a) != b - 1 else self.target(a + 1, b - 1, True)
        for a, b in sides[:-1]:
            if c[a] == "yield":
                return a
            bad = self.target(a, b)
            if bad >= 0:
                return bad
        added = pieces(c, begin, end, "AUG")
        if len(added) > 1:
            return self.target(*added[0], one=True)
        return -1

    def arguments(self, begin: int, end: int) -> int:
        named = doubled = False
        parts = [p for p in pieces(self.c, begin, end, ",") if p[0] < p[1]]
        for a, b in parts:
            if self.c[a] == "**":
                doubled = True
            elif self.c[a] == "*":
                if doubled:
                    return a
            elif b - a > 1 and self.c[a + 1] == "=":
                if self.c[a] != "NAME" or self.t[a] in ("None", "True", "False"):
                    return a
                named = True
            elif len(pieces(self.c, a, b, "=")) > 1:
                return a
            elif named or doubled:
                return a
            elif "for" in self._flat(a, b) and (len(parts) > 1 or self.c[end - 1] == ","):
                return a
        return -1

    def parameters(self, begin: int, end: int) -> int:
        default = star = closed = slash = False
        for a, b in pieces(self.c, begin, end, ","):
            if a >= b:
                continue
            if closed:
                return a
            x = self.c[a]
            if x == "/":
                if slash or star or a == begin:
                    return a
                slash = True
                continue
            if x == "**":
                closed, a = True, a + 1
            elif x == "*":
                if star or b - a == 1 and b == end:
                    return a
                star, a = True, a + 1
            elif len(pieces(self.c, a, b, "=")) > 1:
                default = True
            elif default and not star:
                return a
            if a < b and self.c[a] == "NAME":
                if self.t[a] in ("None", "True", "False"):
                    return a
        return -1

    def braces(self, begin: int, end: int) -> int:
        """A set or a dictionary, not both."""
        first = None
        for a, b in pieces(self.c, begin, end, ","):
            if a >= b:
                continue
            kind = self.c[a] == "**" or len(pieces(self.c, a, b, ":")) > 1
            if first is None:
                first = kind
            elif kind != first:
                return a
        return -1

    def first_error(self) -> int:
        c, t = self.c, self.t
        begin, bad, n = 0, [], len(c)
        header = False
        i = 0
        while i < n:
            x = c[i]
            if i == begin:
                header = x in ("if", "elif", "else", "while", "for", "with", "def", "class", "try", "except", "finally", "async", "@", "MATCH", "CASE")
            if x in ("NEWLINE", ";", "INDENT", "DEDENT", "END"):
                if not header:
                    bad.append(self.statement(begin, i))
                begin = i + 1
            elif x == ":" and header:
                # the end of a header; what follows on the line is a statement
                begin = i + 1
            elif x == "(":
                end = self.pair.get(i, n)
                if i and (c[i - 1] in ("NAME", ")", "]", "STRING") or c[i - 1] == "MATCHNAME") and not self.pattern[i]:
                    k = i - 1
                    while c[k] == "]" and k > 0:
                        k = self.opens.get(k, 0) - 1
                    bad.append(self.parameters(i + 1, end) if k > 0 and c[k] == "NAME" and c[k - 1] == "def" else self.arguments(i + 1, end))
            elif x == "{":
                if not self.pattern[i]:
                    bad.append(self.braces(i + 1, self.pair.get(i, n)))
            elif x == "for":
                k = i + 1
                while k < n and c[k] not in ("in", "NEWLINE", "END"):
                    k = self.pair.get(k, n) + 1 if c[k] in OPEN else k + 1
                bad.append(self.target(i + 1, min(k, n)))
            elif x == "STRING":
                k = i + 1
                while k < n and c[k] == "STRING":
                    if _is_bytes(t[k]) != _is_bytes(t[i]):
                        bad.append(k)
                    k += 1
                if not fields_are_valid(t[i]):
                    bad.append(i)
            if header and x in OPEN:
                # a colon within brackets doesn't end the header
                inner = self.pair.get(i, n)
                bad.extend(self._inside(i + 1, inner))
                i = inner
                continue
            i += 1
        found = [b for b in bad if b >= 0]
        return min(found) if found else -1

    def _inside(self, begin: int, end: int) -> list[int]:
        """What brackets of a header hold: the same tests but those of statements."""
        part = Python(self.c[begin:end], self.t[begin:end])
        at = part._expressions()
        return [begin + at] if at >= 0 else []

    def _expressions(self) -> int:
        self.c = ["NAME", *self.c, "END"]
        self.t = ["x", *self.t, ""]
        self.__init__(self.c, self.t)
        c = self.c
        bad: list[int] = []
        for i, x in enumerate(c):
            end = self.pair.get(i, len(c))
            if x == "(" and c[i - 1] in ("NAME", ")", "]", "STRING"):
                bad.append(self.arguments(i + 1, end))
            elif x == "{":
                bad.append(self.braces(i + 1, end))
            elif x == "STRING" and not fields_are_valid(self.t[i]):
                bad.append(i)
            elif x == "for":
                k = i + 1
                while k < len(c) and c[k] not in ("in", "END"):
                    k = self.pair.get(k, len(c)) + 1 if c[k] in OPEN else k + 1
                bad.append(self.target(i + 1, min(k, len(c))))
        found = [b for b in bad if b >= 0]
        return min(found) - 1 if found else -1


def _is_bytes(text: str) -> bool:
    return "b" in text[: min(x for x in (text.find('"'), text.find("'")) if x >= 0)].lower()


_PREFIX = re.compile(r"([A-Za-z]*)(\"\"\"|'''|\"|')")
_EXPRESSION: list[Callable[[str], bool]] = []


def use(valid: Callable[[str], bool]) -> None:
    """The test of an expression's text, set where the tables are."""
    _EXPRESSION[:] = [valid]


@functools.lru_cache(maxsize=50_000)
def fields_are_valid(token: str) -> bool:
    """Whether the fields of an f-string hold expressions; other strings are valid."""
    m = _PREFIX.match(token)
    if not m or "f" not in m[1].lower():
        return True
    return _spec_is_valid(token[m.end() : len(token) - len(m[2])], "r" in m[1].lower(), False)


def _spec_is_valid(text: str, raw: bool, spec: bool) -> bool:
    i = 0
    while i < len(text):
        x = text[i]
        if x == "\\" and not raw and text[i + 1 : i + 3] == "N{":
            i = text.find("}", i) + 1 or len(text)
        elif x == "{" and text[i + 1 : i + 2] == "{" and not spec:
            i += 2
        elif x == "}":
            if spec or text[i + 1 : i + 2] != "}":
                return False
            i += 2
        elif x == "{":
            end = _field_end(text, i + 1)
            if end < 0 or not _field_is_valid(text[i + 1 : end], raw):
                return False
            i = end + 1
        else:
            i += 1
    return True


_STRING = re.compile(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")


def _field_end(text: str, at: int) -> int:
    """Place of the brace that closes the field, or -1."""
    depth = 0
    while at < len(text):
        m = _STRING.match(text, at)
        if m:
            at = m.end()
            continue
        if text[at] in "([{":
            depth += 1
        elif text[at] in ")]}":
            if text[at] == "}" and depth == 0:
                return at
            depth -= 1
        at += 1
    return -1


def _field_is_valid(text: str, raw: bool) -> bool:
    depth, at, end, rest = 0, 0, len(text), ""
    while at < len(text):
        m = _STRING.match(text, at)
        if m:
            at = m.end()
            continue
        x = text[at]
        if x in "([{":
            depth += 1
        elif x in ")]}":
            depth -= 1
        elif depth == 0 and (x == ":" or x == "!" and text[at + 1 : at + 2] != "="):
            end, rest = at, text[at:]
            break
        at += 1
    expression = text[:end].rstrip()
    if expression.endswith("=") and expression[-2:-1] not in ("=", "!", "<", ">"):
        expression = expression[:-1]
    if rest.startswith("!"):
        if not re.match(r"![rsa]\s*(?::|$)", rest):
            return False
        rest = rest[rest.index(":") :] if ":" in rest else ""
    if not expression.strip() or expression.strip()[0] == "#" or not _EXPRESSION[0](expression.strip()):
        return False
    return not rest or _spec_is_valid(rest[1:], raw, True)


def python_error(c: list[str], t: list[str]) -> int:
    return Python(c, t).first_error()


def script_error(c: list[str], lines: frozenset[int]) -> int:
    """``throw`` at a line end, an updated operand that is assigned to, a constant without a value."""
    for i, x in enumerate(c[:-1]):
        after = c[i + 1]
        if x == "throw" and i + 1 in lines and (i == 0 or c[i - 1] in (";", "{", "}", ")", "else", ":") or i in lines):
            return i + 1
        if x in ("++", "--") and after in ("=", "AUG") and i + 1 not in lines:
            return i + 1
        if x == "const" and (i == 0 or c[i - 1] in (";", "}", "export") or i in lines) and after == "NAME" and i + 2 < len(c) and (c[i + 2] in (";", "END") or i + 2 in lines and c[i + 2] not in ("=", ":", "NAME", "of", "in")):
            return i + 2
    return -1


def java_error(c: list[str]) -> int:
    """A value as a statement of its own."""
    depth = 0
    for i, x in enumerate(c[:-1]):
        if x in ("(", "L(", "C(", "["):
            depth += 1
        elif x in (")", "]"):
            depth -= 1
        elif depth == 0 and x in ("NUMBER", "STRING", "LITERAL") and i and (c[i - 1] in (";", "}") or c[i - 1] == "{" and i > 1 and c[i - 2] in (")", "else", "do", "try")) and c[i + 1] not in (".", "->", ","):
            return i
    return -1
