"""Column functions over text: identities, redaction, contracts, clamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The eleven separators that end a line for some reader.
LINE_BREAKS = "[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}]"

# Ordered redaction patterns; a later one never matches what an earlier one put in.
REDACTIONS: list[tuple[str, str]] = [
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----", "[private-key]"),
    (r"AKIA[0-9A-Z]{16}", "[access-key]"),
    (r"gh[pousr]_[A-Za-z0-9]{20,}", "[host-token]"),
    (r"xox[abprs]-[A-Za-z0-9-]{10,}", "[chat-token]"),
    (r"sk-[A-Za-z0-9_-]{16,}", "[model-key]"),
    (r"AIza[0-9A-Za-z_-]{30,}", "[cloud-key]"),
    (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}", "[web-token]"),
    (r"(?i)bearer +[A-Za-z0-9._~+/-]{12,}=*", "[bearer]"),
    (r"[a-z][a-z0-9+.-]*://[^/ :@]+:[^/ @]+@", "[login]@"),
    (r"(?i)(password|passwd|pwd)[\"']? *[:=] *[\"']?[^ \"'\n]+", "[password]"),
    (r"(?i)(secret|token|api[_-]?key)[\"']? *[:=] *[\"']?[^ \"'\n]+", "[secret]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[mail]"),
    (r"\b[0-9]{13,19}\b", "[number]"),
    (r"\b[0-9a-f]{32,}\b", "[hex]"),
]


#: No pattern matches a text without one of these: most texts are spared the passes.
_HINT = r"(?i)[0-9]{13}|[0-9a-f]{32}|@|:|=|akia|sk-|gh[a-z]_|xox|bearer|eyJ|-----BEGIN|AIza"


def redact(text: Column) -> Column:
    out = text
    for pattern, put in REDACTIONS:
        out = F.regexp_replace(out, pattern, put)
    return F.when(text.rlike(_HINT), out).otherwise(text)


def redact_sql(text: str) -> str:
    for pattern, put in REDACTIONS:
        pattern = pattern.replace("'", "''")
        text = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
    return text


def normal_space(text: Column) -> Column:
    """Trimmed, each run of white space one space."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def slug(text: Column) -> Column:
    """Lower case, everything but letters and digits one dash, 'x' if nothing is left."""
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit("x"))


def fact_key(source: Column, name: Column, kind: Column, text: Column) -> Column:
    """The content key of a fact: SHA-256 of its parts, the text by the digest of its normal form."""
    return F.sha2(F.concat_ws("|", source, name, kind, F.sha2(normal_space(text), 256)), 256)


def contract_error(text: Column, limit: Column, most: int = 150) -> Column:
    """Error of a search request, checks in this order: line breaks, emptiness, length, limit; null if none."""
    trimmed = F.trim(text)
    return (
        F.when(text.rlike(LINE_BREAKS), "line_break")
        .when(trimmed == "", "empty")
        .when(F.length(trimmed) > most, "too_long")
        .when(~limit.between(1, 5), "limit")
    )


def epoch_ms(value: Column) -> Column:
    """Seconds or milliseconds by magnitude, as milliseconds."""
    return F.when(value < 10**12, value * 1000).otherwise(value)


def cut_longest(df: DataFrame, parts: dict[str, Column], total: int) -> DataFrame:
    """Lengths of fields after the longest one is cut again and again until their sum fits; ties cut the first field.

    The fixed point levels the longest fields: each keeps the least of its length and the level, and what the level
    can't divide evenly goes to later fields. The steps are columns of their own, so that none is worked out twice.
    """
    n = len(parts)
    keep = df.columns
    add = lambda a, x: a + x
    sizes = df.withColumn("_sizes", F.array(*[F.length(F.coalesce(p, F.lit(""))).cast("long") for p in parts.values()]))
    sizes = sizes.withColumn("_ordered", F.sort_array("_sizes", asc=False)).withColumn("_over", F.aggregate("_sizes", F.lit(-total).cast("long"), add))
    levels = [F.floor((F.aggregate(F.slice("_ordered", 1, k), F.lit(0).cast("long"), add) - F.col("_over")) / k) for k in range(1, n + 1)]
    sizes = sizes.withColumn("_levels", F.array(*levels))
    fits = [F.when(F.col("_levels")[k - 1] >= (F.col("_ordered")[k] if k < n else F.lit(0)), F.col("_levels")[k - 1]) for k in range(1, n + 1)]
    sizes = sizes.withColumn("_level", F.when(F.col("_over") <= 0, F.col("_ordered")[0]).otherwise(F.coalesce(*fits, F.lit(0))))
    sizes = sizes.withColumn("_spare", F.aggregate(F.transform("_sizes", lambda x: F.least(x, "_level")), F.lit(-total).cast("long"), add) * -1)
    out = []
    for i, name in enumerate(parts):
        later = F.size(F.filter(F.slice("_sizes", i + 2, n), lambda x: x > F.col("_level"))) if i + 1 < n else F.lit(0)
        own = F.col("_sizes")[i]
        out.append(F.least(own, F.col("_level") + ((own > F.col("_level")) & (later < F.col("_spare"))).cast("long")).alias(name))
    return sizes.select(*keep, *out)
