"""Text and key functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns, in the order in which they are replaced: identifiers first, then plain numbers.
NOISE = (
    ("[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<UUID>"),
    ("0x[0-9a-f]+", "<HEX>"),
    ("[0-9]+", "<NUM>"),
)


def failure_signature(c: Column) -> Column:
    """An error's text without the parts that differ between occurrences: ids, numbers, and the stack below line one."""
    out = F.trim(F.regexp_extract(c, "^[^\\n]*", 0))
    for pattern, name in NOISE:
        out = F.regexp_replace(out, pattern, name)
    return out


def idempotency_key(*parts: Column) -> Column:
    """A stable key of coordinates; lengths are part of it, so no two lists of parts run together."""
    return F.sha2(F.concat_ws("|", *[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)


def anonymous_id(c: Column, seed: str, digits: int = 12) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(seed), c), 256), 1, digits)


def leaks(text: Column, needles: list[str]) -> Column:
    """Those of the needles that the text holds."""
    return F.filter(F.array(*[F.lit(n) for n in needles]), lambda n: F.contains(text, n))


def hash_chain(parts: Column) -> Column:
    """SHA-256 over the previous link and each part in order; empty for no parts."""
    return F.aggregate(parts, F.lit(""), lambda link, p: F.sha2(F.concat(link, F.lit("|"), F.length(p).cast("string"), F.lit("|"), p), 256))
