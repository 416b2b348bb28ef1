"""Text expressions: identifiers, slugs, clips, routing, sizes. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a lower-case text for lexical search: letters with their marks, digits and underscores of any script (the usual ones named first, which is faster).
TERM = r"[a-z0-9_\p{L}\p{M}\p{N}]+"
#: Shape of a query that names a symbol.
SYMBOL = r"^[A-Za-z_][A-Za-z0-9_.\-/:]*$"


def terms(text: Column) -> Column:
    """Lower-case terms in order, repeats kept; the dotted capital I counts as a plain one, whatever the language."""
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("İ"), F.lit("I"))), F.lit(TERM), F.lit(0))


def subwords(text: Column) -> Column:
    """Distinct parts of the identifiers of three characters and more (camel, acronym and snake borders), sorted; single characters and numbers left out."""
    words = F.array_join(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)), " ")
    spaced = F.regexp_replace(F.regexp_replace(words, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    parts = F.split(F.lower(spaced), "[ _]+")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: (F.length(x) > 1) & ~x.rlike("^[0-9]+$"))))


def slug(name: Column) -> Column:
    """Lower-case ASCII name with dashes, at most 60 characters, ``repo`` where nothing is left."""
    plain = F.translate(name, "çğıöşüÇĞİÖŞÜ", "cgiosuCGIOSU")
    dashed = F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-")
    clipped = F.regexp_replace(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 60), "^-+|-+$", "")
    return F.when(clipped == "", "repo").otherwise(clipped)


def clip_bytes(text: Column, limit: int) -> Column:
    """The text cut to ``limit`` bytes of UTF-8, never inside a character."""
    raw = F.encode(text, "UTF-8")
    lead = lambda i: (F.conv(F.hex(F.substring(raw, i, 1)), 16, 10).cast("int").between(128, 191))
    cut = F.when(~lead(limit + 1), limit).when(~lead(limit), limit - 1).when(~lead(limit - 1), limit - 2).otherwise(limit - 3)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"))


def is_symbol(query: Column) -> Column:
    """One token of identifier characters with a border inside: camel case, a separator, or capitals throughout."""
    q = F.trim(query)
    inner = q.rlike("[a-z0-9][A-Z]") | q.rlike(r"[_\-./]|::") | (q.rlike("^[A-Z0-9_:]*[A-Z][A-Z0-9_:]*$") & (F.length(q) > 1))
    return q.rlike(SYMBOL) & inner


def search_mode(query: Column, asked: Column, prose_mode: str = "dense") -> Column:
    """The mode asked for; for ``auto`` lexical search of symbols and ``prose_mode`` of the rest."""
    return F.when(F.coalesce(asked, F.lit("auto")) != "auto", asked).when(is_symbol(query), "bm25").otherwise(prose_mode)


def line_slice(text: Column, start: int, count: int) -> Column:
    """``count`` lines from line ``start`` on (1-based)."""
    return F.array_join(F.slice(F.split(text, "\n", -1), start, count), "\n")


def snippet(text: Column, limit: int = 2400) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n[...]"))).otherwise(text)


def human_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.concat(F.format_number(n / 1024, 1), F.lit(" KB")))
        .otherwise(F.concat(F.format_number(n / 1024**2, 1), F.lit(" MB")))
    )


def citation(path: Column, symbol: Column) -> Column:
    return F.when(F.coalesce(symbol, F.lit("")) != "", F.concat_ws("::", path, symbol)).otherwise(path)


def unit_header(mark: Column, path: Column, kind: Column, symbol: Column, parent: Column) -> Column:
    """What a code unit is and where it stands, behind the comment sign of its language."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    what = F.concat(mark, F.lit(" "), F.coalesce(some(kind), F.lit("symbol")), F.lit(": "), some(symbol), F.coalesce(F.concat(F.lit(" (in "), some(parent), F.lit(")")), F.lit("")))
    return F.concat_ws("\n", F.concat(mark, F.lit(" file: "), path), F.coalesce(what, F.concat(mark, F.lit(" in: "), some(parent))))


def indexed_text(header: Column, context: Column, symbols: Column, content: Column) -> Column:
    """Header, description, symbols, text and subwords (of header and text) of a chunk, one under the other, empty parts left out."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    words = F.array_join(subwords(F.concat_ws("\n", F.coalesce(header, F.lit("")), F.coalesce(content, F.lit("")))), " ")
    return F.concat_ws("\n", some(header), some(context), some(symbols), some(content), some(words))


def line_of(text: Column, offset: Column) -> Column:
    """Line (from 1) on which the character at ``offset`` (from 0) stands."""
    return F.length(F.regexp_replace(F.substring(text, F.lit(1), offset), "[^\n]", "")) + 1


def without_thinking(text: Column) -> Column:
    """A model's answer without its block of thoughts."""
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>\s*", ""))


def without_authorization(text: Column) -> Column:
    """A message with the values of authorization headers left out."""
    return F.regexp_replace(text, r"(?i)(Basic|Bearer)\s+[A-Za-z0-9+/=_\-]+", "$1 [REDACTED]")


def short_stamp(iso: Column) -> Column:
    """``2025-01-31 12:00 UTC`` of an ISO time with an offset, without `` UTC`` of one without; other texts as they are."""
    zoned = iso.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    at = F.date_format(F.to_utc_timestamp(F.try_to_timestamp(iso), F.current_timezone()), "yyyy-MM-dd HH:mm")
    plain = F.concat_ws(" ", F.substring(iso, 1, 10), F.substring(iso, 12, 5))
    return F.when(zoned & at.isNotNull(), F.concat(at, F.lit(" UTC"))).when(F.try_to_timestamp(iso).isNotNull() & iso.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d"), plain).otherwise(iso)
