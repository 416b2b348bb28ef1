"""Token streams of the languages, as lists of classes for the tables.

One pattern per language cuts the whole text; the class of each distinct token is looked
up once. What the grammars can't tell by one token ahead (the parentheses of an arrow
function or of a cast, angle brackets of type arguments, the brace that opens a block
behind a header) is marked here by looking for the matching bracket.
"""

from __future__ import annotations

import re

CLOSERS = {"(": ")", "[": "]", "{": "}"}


class Classes(dict):
    """Class of each token text; unknown ones are worked out once and kept, up to a bound."""

    def __init__(self, fixed: dict[str, str], work_out) -> None:
        super().__init__(fixed)
        self.work_out, self.room = work_out, 100_000

    def __missing__(self, token: str) -> str:
        c = self.work_out(token)
        if self.room > 0:
            self.room -= 1
            self[token] = c
        return c


def cut(pattern: re.Pattern, text: str) -> list[str]:
    """The tokens of the text; the last is the empty one at its end."""
    tokens = pattern.findall(text)
    while len(tokens) > 1 and tokens[-1] == "" and tokens[-2] == "":
        tokens.pop()
    return tokens


def matches(classes: list[str]) -> dict[int, int]:
    """Place of the closing bracket for each opening one, as far as they match."""
    out, open_ = {}, []
    for i, c in enumerate(classes):
        if c in CLOSERS:
            open_.append(i)
        elif c in ")]}" and open_ and CLOSERS[classes[open_[-1]]] == c:
            out[open_.pop()] = i
    return out


def words(text: str) -> dict[str, str]:
    return {w: w for w in text.split()}


# JSON

_JSON = re.compile(
    r"[ \t\r\n]*+(\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*+\"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|[{}\[\]:,]|\w+|\Z|[\s\S])"
)
_JSON_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", re.ASCII)
_JSON_CLASSES = Classes(words("{ } [ ] : , true false null") | {"": "END"}, lambda t: "STRING" if t[0] == '"' and len(t) > 1 else "NUMBER" if _JSON_NUMBER.fullmatch(t) else "ERR")


def json_tokens(text: str) -> tuple[list[str], frozenset[int], list[int]]:
    tokens = cut(_JSON, text)
    return [_JSON_CLASSES[t] for t in tokens], frozenset(), []


# Python

_PY_STRING = (
    r"(?:[rRbBuU]|[bB][rR]|[rR][bB])?(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''|\"(?!\"\")(?:[^\"\\\n]|\\\r?[\s\S])*+\"|'(?!'')(?:[^'\\\n]|\\\r?[\s\S])*+')"
)
_PY_FIELD = r"\{(?:[^{}\"'\n]|\"[^\"\n]*\"|'[^'\n]*'|\{(?:[^{}\"'\n]|\"[^\"\n]*\"|'[^'\n]*')*\})*\}"
_PY_FSTRING = (
    r"(?:[fF][rR]?|[rR][fF])(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''"
    rf"|\"(?:[^\"\\\n{{]|\\\r?[\s\S]|\{{\{{|{_PY_FIELD})*+\"|'(?:[^'\\\n{{]|\\\r?[\s\S]|\{{\{{|{_PY_FIELD})*+')"
)
_PY_NUMBER = r"(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"
_PYTHON = re.compile(
    rf"(?:[ \t\f﻿]|\\\r?\n|#[^\n]*)*+((?:\r?\n[ \t\f]*(?:#[^\n]*)?)++|{_PY_FSTRING}|{_PY_STRING}|[^\W\d]\w*+|{_PY_NUMBER}"
    r"|\.\.\.|:=|->|\*\*=|//=|>>=|<<=|[-+*/%@&|^]=|==|!=|<=|>=|\*\*|//|<<|>>|[-+*/%@&|^~<>()\[\]{},:.;=]|\Z|[\s\S])"
)


def _python_class(t: str) -> str:
    c = t[0]
    if c in "\"'" or t[-1] in "\"'" and len(t) > 2:
        return "STRING" if len(t) > 1 else "ERR"
    if c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
        return "ERR" if len(t) > 1 and c == "0" and t.replace("_", "").isdigit() and t.strip("0_") else "NUMBER"
    if c == "\n" or c == "\r" and "\n" in t:
        return "NL"
    return "NAME" if t.isidentifier() else "ERR"


_PYTHON_CLASSES = Classes(
    words(
        "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
        " ... := -> * ** - ~ @ | / ( ) [ ] { } , : . ; ="
    )
    | dict.fromkeys("False None True".split(), "NAME")
    | dict.fromkeys("and or // % & ^ << >> == != <= >= < >".split(), "BINOP")
    | dict.fromkeys("**= //= >>= <<= += -= *= /= %= @= &= |= ^=".split(), "AUG")
    | {"+": "-", "": "END"},
    _python_class,
)


def python_tokens(text: str) -> tuple[list[str], frozenset[int], list[int]]:
    tokens = cut(_PYTHON, "\n" + text)
    out: list[str] = []
    where: list[int] = []
    depth, levels, look = 0, [0], _PYTHON_CLASSES
    begin = 0
    soft = "match" in text or "type " in text
    for i, t in enumerate(tokens):
        c = look[t]
        if c == "NL":
            if depth:
                continue
            if out and out[-1] not in ("NEWLINE", "INDENT", "DEDENT"):
                out.append("NEWLINE")
                where.append(i)
                if soft:
                    _python_soft(tokens, out, where, begin)
            if i + 1 < len(tokens) and tokens[i + 1] != "":
                width = len(t[t.rindex("\n") + 1 :].replace("\f", "").expandtabs(8))
                if width > levels[-1]:
                    levels.append(width)
                    out.append("INDENT")
                    where.append(i + 1)
                while width < levels[-1]:
                    levels.pop()
                    out.append("DEDENT" if width <= levels[-1] else "ERR")
                    where.append(i + 1)
            begin = len(out)
            continue
        if c == "END":
            if depth == 0:
                if out and out[-1] not in ("NEWLINE", "INDENT", "DEDENT"):
                    out.append("NEWLINE")
                    where.append(i)
                    if soft:
                        _python_soft(tokens, out, where, begin)
                out += ["DEDENT"] * (len(levels) - 1)
                where += [i] * (len(levels) - 1)
            out.append("END")
            where.append(i)
            break
        if c in "([{":
            depth += 1
        elif c in ")]}" and depth:
            depth -= 1
        out.append(c)
        where.append(i)
    return out, frozenset(), where


def _python_soft(tokens: list[str], out: list[str], where: list[int], begin: int) -> None:
    """Mark ``match``, ``case`` and ``type`` where they head the logical line that has just ended."""
    if begin >= len(out) or out[begin] != "NAME":
        return
    word, after = tokens[where[begin]], out[begin + 1 : -1]
    if word in ("match", "case"):
        depth = 0
        for n, c in enumerate(after):
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
            elif c == ":" and depth == 0:
                if n and (word == "case" or n == len(after) - 1) and after[0] not in ("=", ".", ",", "AUG"):
                    out[begin] = "MATCH" if word == "match" else "CASE"
                return
    elif word == "type" and len(after) > 2 and after[0] == "NAME" and after[1] in ("=", "["):
        out[begin] = "TYPE"


# Go

_GO = re.compile(
    r"(?:[ \t\r﻿]|//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/)*+(\n|`[^`]*`|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\[^\n][^'\n]*)'|[^\W\d]\w*+|0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?i?|0[bB][01_]+|0[oO][0-7_]+"
    r"|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?|/\*|\[[ \t]*\]|\.\.\.|<-|:=|&\^=|<<=|>>=|&\^|[-+*/%&|^]=|\+\+|--|&&|\|\||==|!=|<=|>=|<<|>>|[-+*/%&|^<>=!()\[\]{},;.:~]|\Z|[\s\S])"
)


def _go_class(t: str) -> str:
    c = t[0]
    if c in "\"`":
        return "STRING" if len(t) > 1 else "ERR"
    if c == "'":
        return "LITERAL" if len(t) > 2 else "ERR"
    if c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
        return "NUMBER"
    if c == "[":
        return "[]"
    return "NAME" if t.isidentifier() else "ERR"


_GO_CLASSES = Classes(
    words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var ... <- := ++ -- = ! ( ) [ ] { } , ; . : ~ * |")
    | dict.fromkeys("/ % << >> &^ && || == != < <= > >=".split(), "BINOP")
    | dict.fromkeys("+= -= *= /= %= &= |= ^= <<= >>= &^=".split(), "AUG")
    | dict.fromkeys("+ - & ^".split(), "BINARY_OR_UNARY")
    | {"!": "UNARY", "": "END", "\n": "NL", "/*": "ERR"},
    _go_class,
)
_GO_ENDS = {"NAME", "NUMBER", "STRING", "LITERAL", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}


def go_tokens(text: str) -> tuple[list[str], frozenset[int], list[int]]:
    tokens = cut(_GO, text)
    out: list[str] = []
    where: list[int] = []
    last = ""
    look = _GO_CLASSES
    for i, t in enumerate(tokens):
        c = look[t]
        if c == "NL" or c == "END":
            if last in _GO_ENDS:
                out.append(";")
                where.append(i)
                last = ";"
            if c == "NL":
                continue
        out.append(c)
        where.append(i)
        last = c
    pair = matches(out)
    for i, c in enumerate(out):
        if c in ("if", "for", "switch", "select") and not (i and out[i - 1] == "."):
            j = i + 1
            while j < len(out):
                d = out[j]
                if d in ("(", "["):
                    j = pair.get(j, len(out))
                elif d in ("struct", "interface") and j + 1 < len(out) and out[j + 1] == "{":
                    j = pair.get(j + 1, len(out))
                elif d == "func":
                    while j < len(out) and out[j] != "{":
                        j = pair.get(j, len(out)) + 1 if out[j] == "(" else j + 1
                    j = pair.get(j, len(out))
                elif d == "{":
                    back = j - 1
                    while back > 1 and out[back] == "NAME" and out[back - 1] == "." and out[back - 2] == "NAME":
                        back -= 2
                    while out[back - 1] == "*":
                        back -= 1
                    if out[back] == "NAME" and out[back - 1] in ("[]", "]") and j - 1 >= back or out[back] in ("{", ",") and back == j - 1:
                        j = pair.get(j, len(out))
                    else:
                        out[j] = "BLOCK"
                        break
                elif d == "}" or d == "END":
                    break
                j += 1
    return out, frozenset(), where


# Java

_JAVA = re.compile(
    r"(?:\s|//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/|﻿)*+(\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|\"(?!\"\")(?:[^\"\\\n]|\\.)*+\"|\"\"(?!\")|'(?:[^'\\\n]|\\[^\n][^'\n]*)'|non-sealed\b|[^\W\d][\w$]*+|\$[\w$]*+"
    r"|0[xX][\da-fA-F_]+[lL]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[fFdDlL]?|/\*|\[\s*\]|@\s*interface\b"
    r"|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>>>?=|>=|<<=|<<|[-+*/%&|^]=|[-+*/%&|^<>=!?()\[\]{},;.:~@]|\Z|[\s\S])"
)


def _java_class(t: str) -> str:
    c = t[0]
    if c == '"':
        return "STRING" if len(t) > 1 else "ERR"
    if c == "'":
        return "LITERAL" if len(t) > 2 else "ERR"
    if c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
        return "NUMBER"
    if c == "[":
        return "[]"
    if c == "@":
        return "ANNOTATION_TYPE"
    return "NAME" if t.replace("$", "_").isidentifier() else "ERR"


_JAVA_CLASSES = Classes(
    words(
        "assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface new package return static super switch synchronized this throw throws try void while"
        " ... -> :: ++ -- = ! ? ( ) [ ] { } , ; . : ~ @ + - * & | < > >="
    )
    | dict.fromkeys("boolean byte char double float int long short".split(), "PRIMITIVE")
    | dict.fromkeys("public private protected abstract native transient volatile strictfp non-sealed".split(), "MODIFIER")
    | dict.fromkeys("true false null".split(), "LITERAL")
    | dict.fromkeys("/ % ^ && || == != <= <<".split(), "BINOP")
    | dict.fromkeys("+= -= *= /= %= &= |= ^= <<= >>= >>>=".split(), "AUG")
    | {"": "END", "/*": "ERR", "const": "ERR", "goto": "ERR"},
    _java_class,
)
_JAVA_IN_TYPES = {"NAME", "PRIMITIVE", ".", ",", "?", "extends", "super", "&", "[]", "@", "<", ">"}
_JAVA_AFTER_CAST = {"NAME", "LITERAL", "NUMBER", "STRING", "(", "L(", "C(", "!", "~", "this", "super", "new", "switch", "PRIMITIVE", "void"}
_JAVA_AFTER_TYPE = {"NAME", "(", ")", "[]", ",", "{", "::", ".", "&", "...", "extends", "implements", ">", "PRIMITIVE", "void", ";", "=", "?", "|", "END", "this", "MODIFIER", "static", "final", "class", "synchronized", "@"}


def _angles(out: list[str], i: int, inside: set[str], pair: dict[int, int]) -> int:
    """Place of the ``>`` that closes the ``<`` at ``i``, if all between may stand in types; else -1."""
    depth, j = 0, i
    while j < len(out):
        c = out[j]
        if c == "<" or c == "G<":
            depth += 1
        elif c == ">" or c == "G>":
            depth -= 1
            if depth == 0:
                return j
        elif c not in inside:
            return -1
        elif c in CLOSERS or c == "A(":
            j = pair.get(j, len(out))
        j += 1
    return -1


def java_tokens(text: str) -> tuple[list[str], frozenset[int], list[int]]:
    tokens = cut(_JAVA, text)
    out = [_JAVA_CLASSES[t] for t in tokens]
    pair = matches(out)
    n = len(out)
    for i, c in enumerate(out):
        if c == "<":
            j = _angles(out, i, _JAVA_IN_TYPES, pair)
            if j > 0 and out[j + 1] in _JAVA_AFTER_TYPE and (i == 0 or out[i - 1] not in (")", "NUMBER", "STRING", "LITERAL")):
                for k in range(i, j + 1):
                    if out[k] in "<>":
                        out[k] = "G" + out[k]
        elif c == "case":
            j = i + 1
            while j < n and out[j] not in (":", ";", "{", "}"):
                if out[j] == "->":
                    out[j] = "CASE_ARROW"
                    break
                j = pair.get(j, n) + 1 if out[j] in CLOSERS else j + 1
        elif c == "NAME":
            word, after = tokens[i], out[i + 1]
            if word == "record" and after == "NAME" and out[i + 2] in ("(", "<"):
                out[i] = "RECORD"
            elif word == "permits" and after == "NAME":
                out[i] = "PERMITS"
            elif word == "sealed" and after in ("class", "interface", "MODIFIER", "static"):
                out[i] = "MODIFIER"
            elif word == "yield" and after in ("NAME", "LITERAL", "NUMBER", "STRING", "new", "this", "switch", "!") and (i == 0 or out[i - 1] in (";", "{", "}", "->", "CASE_ARROW", ":")):
                out[i] = "YIELD"
    for i, c in enumerate(out):
        if c == "(" and i in pair:
            j = pair[i]
            after = out[j + 1]
            if after == "->":
                out[i] = "L("
            elif j > i + 1 and (i == 0 or out[i - 1] not in ("NAME", "G>", "if", "while", "for", "switch", "catch", "synchronized", "super", "this", ")", "]", "try")):
                inner = out[i + 1 : j]
                if "PRIMITIVE" == inner[0] and all(x in ("PRIMITIVE", "[]") for x in inner) or inner[0] == "NAME" and after in _JAVA_AFTER_CAST and all(x in ("NAME", ".", "[]", "&", "G<", "G>", ",", "?", "extends", "super") for x in inner):
                    out[i] = "C("
    return out, frozenset(), []


# ECMAScript and TypeScript

_TEMPLATE0 = r"`(?:[^`\\]|\\[\s\S])*+`"
_JS_STRING = r"\"(?:[^\"\\\n]|\\\r?[\s\S])*+\"|'(?:[^'\\\n]|\\\r?[\s\S])*+'"


def _template(inner: str) -> str:
    braces = rf"\{{(?:[^{{}}`\"']|{_JS_STRING}|\{{(?:[^{{}}`\"']|{_JS_STRING})*+\}})*+\}}"
    return rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\$\{{(?:[^`{{}}\"']|{_JS_STRING}|{braces}|{inner})*+\}})*+`"


_TEMPLATE = _template(_template(_TEMPLATE0))
_REGEX = r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[a-z]*"
_REGEX_BEFORE = r"(?:(?<=[=(,:\[!&|?{;+*%<>~^])|(?<=[=(,:\[!&|?{;+*%<>~^] )|(?<=\s\s)|(?<=\n)|(?<=return )|(?<=typeof )|(?<=case ))"
_SCRIPT = re.compile(
    rf"(?:[ \t\r\f\v\xa0﻿]|//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/)*+(\n(?:\s|//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/)*+|{_JS_STRING}|{_TEMPLATE}|#?(?:[^\W\d]|\$)[\w$‌‍]*+"
    r"|0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?"
    rf"|/\*|{_REGEX_BEFORE}{_REGEX}"
    r"|\.\.\.|=>|\?\.(?!\d)|\?\?=|\?\?|\*\*=|\*\*|&&=|&&|\|\|=|\|\||===|!==|==|!=|>>>?=|<<=|<<|<=|>=|\+\+|--|[-+*/%&|^]=|[-+*/%&|^<>=!?()\[\]{},;.:~@]|\Z|[\s\S])"
)


def _script_class(t: str) -> str:
    c = t[0]
    if c in "\"'":
        return "STRING" if len(t) > 1 else "ERR"
    if c == "`":
        return "TEMPLATE" if len(t) > 1 else "ERR"
    if c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
        return "NUMBER"
    if c == "/":
        return "REGEX" if len(t) > 2 else "ERR"
    if c == "\n":
        return "NL"
    if c == "#" and len(t) > 1:
        return "PRIVATE"
    return "NAME" if t.replace("$", "_").replace("‌", "").replace("‍", "").isidentifier() else "ERR"


_SCRIPT_WORDS = words(
    "break case catch class const continue debugger default delete do else enum export extends finally for function if import in new return super switch this throw try typeof var void while with yield let await"
    " as of from satisfies ... => ?. ++ -- = ! ? ( ) [ ] { } , ; . : ~ @ + - * < >"
) | dict.fromkeys("null true false".split(), "LITERAL") | dict.fromkeys("?? ** && || === !== == != << <= >= / % ^ instanceof".split(), "BINOP") | dict.fromkeys("??= **= &&= ||= >>= >>>= <<= += -= *= /= %= &= |= ^=".split(), "AUG")
_SCRIPT_END = {"": "END", "/*": "ERR"}
_JS_CLASSES = Classes(_SCRIPT_WORDS | dict.fromkeys("& |".split(), "BINOP") | _SCRIPT_END, _script_class)
_TS_CLASSES = Classes(_SCRIPT_WORDS | words("& | implements") | _SCRIPT_END, _script_class)
_OPERAND_ENDS = {"NAME", ")", "]", "}", "G>", "STRING", "NUMBER", "TEMPLATE", "this", "super", "PRIVATE", "as", "of", "from"}
_TS_IN_TYPES = {
    "NAME", "STRING", "NUMBER", "TEMPLATE", "LITERAL", ",", ".", "|", "&", "?", ":", "=>", "=", "(", "A(", "[", "{", "extends", "typeof", "void", "this", "const", "in", "new", "-", "<", ">", "as", "of", "from", "...", "import"
}
_TS_AFTER_TYPE = {"(", "A(", ")", ",", ";", "=", "{", "}", "[", "]", ">", "|", "&", ".", "?.", "TEMPLATE", ":", "=>", "extends", "implements", "?", "END", "as", "BINOP", "!"}
_CONTEXT = set("async get set static type interface namespace module declare abstract global readonly public private protected override accessor keyof unique infer is asserts".split())


def _skip_type(out: list[str], j: int, pair: dict[int, int]) -> int:
    """Place behind what may be one type that starts at ``j`` (for telling arrow functions apart)."""
    n = len(out)
    while j < n:
        c = out[j]
        if c in CLOSERS:
            j = pair.get(j, n) + 1
            if c == "(" and j < n and out[j] == "=>":
                j += 1
                continue
        elif c == "<":
            k = _angles(out, j, _TS_IN_TYPES, pair)
            if k < 0:
                return n
            j = k + 1
        elif c in ("NAME", "STRING", "NUMBER", "TEMPLATE", "LITERAL", "void", "this", "const", "typeof", "new", "as", "of", "from"):
            j += 1
        elif c in ("|", "&", "."):
            j += 1
        else:
            return j
    return n


_TAG = re.compile(r"<\s*([A-Za-z_$][\w$.:-]*)?\s*")
_ATTRIBUTE = re.compile(rf"[A-Za-z_$][\w$:-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|(?=[{{<])))?\s*")
_CLOSE_TAG = re.compile(r"</\s*([A-Za-z_$][\w$.:-]*)?\s*>")
_IN_BRACES = re.compile(rf"{_JS_STRING}|{_TEMPLATE}|//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/|[\s\S]")


def _braced(text: str, at: int) -> int:
    """Place behind the brace that closes the one at ``at``, or -1."""
    depth = 0
    while at < len(text):
        m = _IN_BRACES.match(text, at)
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        at = m.end()
        if depth == 0:
            return at
    return -1


def element_end(text: str, at: int, inside: list[str]) -> int:
    """Place behind the element (or fragment) that begins at ``at``, or -1 where it isn't well formed; ``inside`` gets the texts of its braces."""
    m = _TAG.match(text, at)
    name, at = m[1], m.end()
    while True:
        if text.startswith("/>", at) and name:
            return at + 2
        if text.startswith(">", at):
            at += 1
            break
        if text.startswith("{", at) and name:
            end = _braced(text, at)
            inside.append(text[at + 1 : end - 1].strip().removeprefix("..."))
        else:
            a = _ATTRIBUTE.match(text, at) if name else None
            if not a:
                return -1
            end = a.end()
            if text[end : end + 1] in ("{", "<") and text[: end].rstrip().endswith("="):
                begin = end
                end = _braced(text, end) if text[end] == "{" else element_end(text, end, inside)
                if end >= 0 and text[begin] == "{":
                    inside.append(text[begin + 1 : end - 1])
        if end < 0:
            return -1
        at = end
        while text[at : at + 1].isspace():
            at += 1
    while at < len(text):
        if text.startswith("</", at):
            m = _CLOSE_TAG.match(text, at)
            return m.end() if m and m[1] == name else -1
        if text[at] == "<":
            at = element_end(text, at, inside)
        elif text[at] == "{":
            end = _braced(text, at)
            inside.append(text[at + 1 : end - 1].strip().removeprefix("..."))
            at = end
        elif text[at] in ">}":
            return -1
        else:
            at += 1
        if at < 0:
            return -1
    return -1


def without_elements(text: str) -> tuple[str, list[str]] | None:
    """A ``.tsx`` text with each element replaced by a name of the same number of lines, and the texts of all braces in them; None where one is broken."""
    out, inside, at, done, before = [], [], 0, 0, ""
    while at < len(text):
        m = _SCRIPT.match(text, at)
        if m is None or m.end() == at:
            break
        token = m[1]
        if token == "<" and _opens_element(text, m.start(1), before):
            end = element_end(text, m.start(1), inside)
            if end < 0:
                return None
            out += [text[done : m.start(1)], "element_", "/*" + "\n" * text.count("\n", m.start(1), end) + "*/"]
            at = done = end
            before = "NAME"
            continue
        c = _TS_CLASSES[token]
        if c != "NL":
            before = c
        at = m.end()
    return "".join(out) + text[done:], inside


def _opens_element(text: str, at: int, before: str) -> bool:
    if before in _OPERAND_ENDS or before in ("LITERAL", "function", "class", "extends"):
        return False
    m = _TAG.match(text, at)
    rest = text[m.end() : m.end() + 8]
    return not rest.startswith((",", "extends ")) and (m[1] is not None or rest.startswith(">"))


def script_tokens(text: str, types: bool) -> tuple[list[str], frozenset[int], list[int]]:
    raw = cut(_SCRIPT, text)
    look = _TS_CLASSES if types else _JS_CLASSES
    out: list[str] = []
    tokens: list[str] = []
    where: list[int] = []
    lines: set[int] = set()
    for i, t in enumerate(raw):
        c = look[t]
        if c == "NL":
            lines.add(len(out))
            continue
        out.append(c)
        tokens.append(t)
        where.append(i)
    n = len(out)
    out.append("END")
    pair = matches(out)
    for i in range(n):
        c = out[i]
        if c in ("++", "--") and i in lines and i and out[i - 1] in _OPERAND_ENDS | {"LITERAL"}:
            out[i] = "-"  # behind a line end it belongs to the operand that follows
            continue
        if c == "." or c == "?.":
            t = tokens[i + 1] if i + 1 < n else ""
            if t and (t[0].isalpha() or t[0] in "_$"):
                out[i + 1] = "NAME"
            continue
        if c == "NAME" or c == "as" or c == "of" or c == "from":
            t, after = tokens[i], out[i + 1]
            if i and out[i - 1] in (".", "?."):
                continue
            if after == "=>" and (not types or i == 0 or out[i - 1] not in (":", "|", "&", "=>") or out[i - 1] == "=>"):
                out[i] = "ARROW_NAME"
            elif t in _CONTEXT:
                _context(tokens, out, i, lines, pair, types)
            if after == ":" and out[i] == "NAME" and out[i + 2 : i + 3] and out[i + 2] in ("for", "while", "do", "switch") and (i == 0 or out[i - 1] in (";", "{", "}", ")") or i in lines):
                out[i] = "LABEL"
        elif c == "(" and i in pair:
            j = pair[i] + 1
            if out[j] == "=>":
                out[i] = "A("
            elif types and out[j] == ":" and _may_begin_arrow(out, tokens, i):
                if out[_skip_type(out, j + 1, pair) if out[j + 1] != "NAME" or tokens[j + 1] != "asserts" else j] == "=>" or _predicate(tokens, out, j + 1, pair):
                    out[i] = "A("
        elif c == "<" and types:
            j = _angles(out, i, _TS_IN_TYPES, pair)
            if j > 0 and (out[j + 1] in _TS_AFTER_TYPE or j + 1 in lines or i and out[i - 1] not in _OPERAND_ENDS) and (i == 0 or out[i - 1] not in (")", "NUMBER", "STRING")):
                depth = 0
                for k in range(i, j + 1):
                    if out[k] == "<":
                        out[k] = "G<"
                    elif out[k] == ">":
                        out[k] = "G>"
    if n and out[n - 1] == "END":
        out.pop()
    ends = {i for i, c in enumerate(out) if c == "}"}
    return out, frozenset(lines | ends | {len(out) - 1}), where


def _may_begin_arrow(out: list[str], tokens: list[str], i: int) -> bool:
    """Whether the parenthesis at ``i`` doesn't follow an operand (its own type parameters aside)."""
    p = i - 1
    if p >= 0 and out[p] == "G>":
        depth = 0
        while p >= 0:
            depth += {"G>": 1, "G<": -1}.get(out[p], 0)
            p -= 1
            if depth == 0:
                break
    return p < 0 or (out[p] not in _OPERAND_ENDS or tokens[p] == "async") and out[p] != "?"


def _predicate(tokens: list[str], out: list[str], j: int, pair: dict[int, int]) -> bool:
    """Whether ``x is T =>`` starts at ``j``."""
    return out[j] == "NAME" and tokens[j + 1 : j + 2] == ["is"] and out[_skip_type(out, j + 2, pair)] == "=>"


def _context(tokens: list[str], out: list[str], i: int, lines: set[int], pair: dict[int, int], types: bool) -> None:
    """Class of a word that is a keyword in some places only."""
    word, after, same_line = tokens[i], out[i + 1], i + 1 not in lines
    begins = after in ("NAME", "STRING", "NUMBER", "[", "PRIVATE", "as", "of", "from") or after in _SCRIPT_WORDS and after[0].isalpha() and after not in ("in", "as")
    if word == "async":
        if same_line and (after in ("function", "*") or begins or after == "(" and out[pair.get(i + 1, i) + 1] in ("=>", ":") or after == "<" and types):
            if after != "(" or out[pair.get(i + 1, i) + 1] == "=>" or types and out[_skip_type(out, pair[i + 1] + 2, pair)] == "=>":
                out[i] = "async"
    elif word in ("get", "set"):
        if begins:
            out[i] = word
    elif word == "static":
        if begins or after in ("*", "{") or tokens[i + 1] in _CONTEXT:
            out[i] = "static"
    elif not types:
        return
    elif word == "type":
        nxt = out[i + 2] if i + 2 < len(out) else "END"
        if after == "NAME" and (nxt in ("=", "<") or i and out[i - 1] in ("{", ",") and nxt in (",", "}", "as") or nxt == "from" or nxt == ",") or after in ("{", "*") and i and out[i - 1] in ("import", "export"):
            out[i] = "type"
    elif word in ("interface", "namespace"):
        if after == "NAME" and same_line:
            out[i] = word
    elif word == "module":
        if after in ("NAME", "STRING") and same_line:
            out[i] = word
    elif word == "global":
        if after == "{" and i and tokens[i - 1] == "declare":
            out[i] = word
    elif word in ("declare", "abstract"):
        if same_line and begins:
            out[i] = word
    elif word in ("public", "private", "protected", "override", "accessor"):
        if begins or after in ("{", "*"):
            out[i] = "MODIFIER"
    elif word == "readonly":
        if begins or after in ("{", "("):
            out[i] = word
    elif word in ("keyof", "unique", "infer"):
        if begins or after == "(":
            out[i] = word
    elif word == "is":
        if i and out[i - 1] in ("NAME", "this") and (begins or after in ("{", "LITERAL")):
            out[i] = word
    elif word == "asserts":
        if after in ("NAME", "this"):
            out[i] = word
