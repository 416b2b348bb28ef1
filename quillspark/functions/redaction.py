"""Redaction by ordered patterns, with the e-mail and assignment rules that decide by the value. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label and pattern, in the order in which they apply.
KEYS = [
    ("[API_KEY]", r"\b(?:sk|pk|rk)-[A-Za-z0-9_\-]{16,}\b"),
    ("[API_KEY]", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b"),
    ("[API_KEY]", r"\bxox[baprs]-[A-Za-z0-9\-]{10,}\b"),
    ("[API_KEY]", r"\bAKIA[0-9A-Z]{16}\b"),
    ("[API_KEY]", r"\b[a-z0-9]{52}\b"),
    ("[JWT]", r"\beyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\b"),
]
# Addresses, and the domains whose addresses stay.
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
RESERVED = r"(?i)@(?:example\.(?:com|net|org)|localhost|[\w.\-]+\.(?:test|invalid|example|local))$"
# Numbers.
PHONES = [
    ("[PHONE]", r"\+\d{1,3}[\s.\-]?\(?\d{2,4}\)?[\s.\-]?\d{3}[\s.\-]?\d{2,4}\b"),
    ("[PHONE]", r"\b\d{3}[.\-]\d{3}[.\-]\d{4}\b"),
]
# Assignments to names in capitals, and what no assigned secret looks like.
ASSIGNED = (
    r"\b(?:[A-Z][A-Z0-9]*_[A-Z0-9_]*(?:PASSWORD|SECRET|TOKEN|APIKEY|API_KEY|PRIVATE_KEY|PAT)[A-Z0-9_]*|(?:PASSWORD|SECRET|TOKEN|APIKEY|API_KEY|PRIVATE_KEY)[A-Z0-9_]*)"
    r"\s*[:=]\s*(?:\"[^\"\n]*\"|'[^'\n]*'|[^\s\"'#,;]+)"
)
NOT_SECRET = [
    r"(?i)\b(?:process\.env|import\.meta\.env|os\.environ|env|Environment)\b", r"^\$\{?", r"^(?:string|number|boolean|text|varchar|uuid|jsonb?|any|unknown)\b", r"[.(]\s*$", r"^[A-Za-z_][\w.]*\(", r"^(?:this|self)\.",
    r"^(?:https?|wss?|postgres(?:ql)?|redis|mongodb)://", r"(?i)(?:^<|your[-_]|change[-_]?me|placeholder|example|xxx+|\.\.\.)",
]
#: Labels in the order of the counts.
LABELS = ["[API_KEY]", "[JWT]", "[EMAIL]", "[PHONE]", "[SECRET]"]


def _per_match(text: Column, found: Column, pattern: str, replace) -> Column:
    """The text with each match replaced by an expression of it: what the pattern splits apart and the matches are interleaved again."""
    gaps = F.split(text, pattern, -1)
    return F.array_join(F.flatten(F.zip_with(gaps, found, lambda g, m: F.when(m.isNull(), F.array(g)).otherwise(F.array(g, replace(m))))), "")


def _secret(match: Column) -> Column:
    """Whether the value of an assignment is one: 12 characters at least, letters and digits, no white space, no reference."""
    value = F.trim(F.regexp_replace(F.trim(F.regexp_replace(match, r"^[A-Z0-9_]+\s*[:=]\s*", "")), "^[\"']+|[\"']+$", ""))
    ok = (F.length(value) >= 12) & ~value.rlike(r"\s") & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    for p in NOT_SECRET:
        ok = ok & ~value.rlike(p)
    return ok


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def redacted(rows: DataFrame, text: str) -> DataFrame:
    """The rows with keys, addresses, numbers and assigned secrets in the column ``text`` replaced by their labels, and ``redactions``: how many by label.

    One select for each rule, so that every rule runs once over what the one before left. A null text stays null.
    """
    others = [F.col(f"`{c}`") for c in rows.columns if c != text]
    counts = [f"_n{i}" for i in range(len(LABELS))]
    rows = rows.select(*others, F.col(text).alias("_t"), *[F.lit(0).alias(c) for c in counts])

    def step(rows: DataFrame, left: Column, label: str, n: Column) -> DataFrame:
        return rows.select(*others, left.alias("_t"), *[(F.col(c) + n if label == of else F.col(c)).alias(c) for c, of in zip(counts, LABELS)])

    def simple(rows: DataFrame, label: str, pattern: str) -> DataFrame:
        return step(rows, F.regexp_replace("_t", pattern, F.lit(label)), label, F.regexp_count("_t", F.lit(pattern)))

    for label, pattern in KEYS:
        rows = simple(rows, label, pattern)
    rows = rows.withColumn("_m", _all(F.col("_t"), EMAIL))
    mails = _per_match(F.col("_t"), F.col("_m"), EMAIL, lambda m: F.when(m.rlike(RESERVED), m).otherwise("[EMAIL]"))
    rows = step(rows, F.when(F.size("_m") > 0, mails).otherwise(F.col("_t")), "[EMAIL]", F.size(F.filter("_m", lambda m: ~m.rlike(RESERVED))))
    for label, pattern in PHONES:
        rows = simple(rows, label, pattern)
    rows = rows.withColumn("_m", _all(F.col("_t"), ASSIGNED))
    values = _per_match(F.col("_t"), F.col("_m"), ASSIGNED, lambda m: F.when(_secret(m), F.concat(F.regexp_extract(m, r"^([A-Z0-9_]+\s*[:=]\s*)", 1), F.lit("[SECRET]"))).otherwise(m))
    rows = step(rows, F.when(F.size("_m") > 0, values).otherwise(F.col("_t")), "[SECRET]", F.size(F.filter("_m", _secret)))
    found = F.create_map(*[x for c, label in zip(counts, LABELS) for x in (F.lit(label), F.col(c))])
    return rows.select(*others, F.col("_t").alias(text), F.map_filter(found, lambda _, n: n > 0).alias("redactions"))
