"""Text rules: failure-reason buckets, slugs, identifiers, digests."""
from __future__ import annotations

import hashlib
import json
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Trailing words dropped from a failure reason.
STOP_WORDS = ("by", "at", "of", "is", "to", "for", "in", "with", "during", "from", "on", "x")

GATE = r"^([a-z][a-z0-9_]*):"
# A token that ends the descriptive part of a reason: it holds a digit, is a comparison or opens a bracket.
BREAK = r" (\S*[0-9]\S*|<|>|=|<=|>=|/|\(\S*)( .*)?$"
# Possessive, and never begun inside a run: Java's engine recurses once per repetition of a group it may give back, so a
# run of thousands of stop words overflowed the stack and took the executor with it. No stop word begins another.
_STOPS = " (?:" + "|".join(STOP_WORDS) + ")"
TAIL = f"(?i)(?<!{_STOPS})(?:{_STOPS})++$"


def reason_kind(reason: Column) -> Column:
    """Bucket of a failure reason: its leading identifier, else its words without sides, names and numbers."""
    text = F.trim(reason)
    words = F.split_part(text, F.lit(":"), F.lit(1))
    words = F.regexp_replace(words, r"\b(left|right)\b\s*", "")
    words = F.regexp_replace(words, r"\bhand-\S+", "hand-object")
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(words, r"\s+", " ")))
    words = F.regexp_replace(words, BREAK, "")
    words = F.trim(F.regexp_replace(words, TAIL, ""))
    return (F.when(text.rlike(GATE), F.regexp_extract(text, GATE, 1))
            .when(words == "", F.lit("other")).otherwise(words))


def exclusion_label(kind: Column, reason: Column) -> Column:
    """``kind: reason`` with numbers masked, the reason cut at 120 characters."""
    masked = F.substring(F.regexp_replace(F.coalesce(reason, F.lit("None")), r"\d+", "#"), 1, 120)
    return F.concat(F.coalesce(kind, F.lit("None")), F.lit(": "), masked)


def slug(text: Column, length: int = 60) -> Column:
    dashed = F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, length)


def tail_slug(text: Column, length: int = 48) -> Column:
    """Last ``length`` characters of a slug, without a leading or trailing dash."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.regexp_replace(F.right(dashed, F.lit(length)), r"^-+|-+$", "")


def short_digest(selectors: Column) -> Column:
    """First 8 hex digits of the SHA-1 of newline-joined selectors."""
    return F.substring(F.sha1(F.array_join(selectors, "\n").cast("binary")), 1, 8)


def fetch_job_id(family: Column, selectors: Column) -> Column:
    first = selectors[0]
    below = F.when(first.contains("/"), F.regexp_replace(first, r"^[^/]*/", "")).otherwise(first)
    return F.concat_ws("-", F.lit("fetch"), family, slug(below), short_digest(selectors))


def numeric_seed(text: Column) -> Column:
    """First 8 bytes of the SHA-256 read as a little-endian unsigned number."""
    digest = F.sha2(text.cast("binary"), 256)
    swapped = F.concat(*[F.substring(digest, 15 - 2 * i, 2) for i in range(8)])
    return F.conv(swapped, 16, 10).cast("decimal(20,0)")


def config_digest(values: dict) -> str:
    """``sha256:`` digest of the canonical JSON of a settings record (driver side, once per run)."""
    text = json.dumps(values, sort_keys=True, separators=(",", ":"))
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def map_digest(values: Column) -> Column:
    """``sha256:`` digest of a string map's entries in key order."""
    entries = F.array_sort(F.map_entries(values))
    ordered = F.to_json(F.map_from_entries(entries))
    return F.concat(F.lit("sha256:"), F.sha2(ordered.cast("binary"), 256))


def finite_or_null(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def joined_with_rest(items: Column, shown: int) -> Column:
    """The first ``shown`` items joined by commas, then ``(+N more)``."""
    head = F.array_join(F.slice(items, 1, shown), ", ")
    extra = F.size(items) - shown
    return F.when(extra > 0, F.concat(head, F.lit(" (+"), extra.cast("string"), F.lit(" more)"))).otherwise(head)


def round_half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def fixed(x: Column, digits: int) -> Column:
    """A number with that many decimals like the C format ``%.3f``: its binary value is rounded to nearest, exact ties to even."""
    x = x.cast("double")
    half = float(f"5e-{digits + 1}")
    # format_number leaves a value below the last digit at zero even beyond one half of that digit
    up = F.abs(x) >= half if Decimal(half) > Decimal(5).scaleb(-digits - 1) else F.abs(x) > half
    unit = f"%.{digits}f" % 10.0 ** -digits
    text = F.call_function("format_number", x, F.lit("0." + "0" * digits if digits else "0"))
    return (F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
            .when((F.abs(x) < 10.0 ** -digits) & up, F.when(x < 0, f"-{unit}").otherwise(unit)).otherwise(text))


def sig3(x: Column) -> Column:
    return significant(x, 3)


def significant(x: Column, digits: int) -> Column:
    """A number with that many significant digits and no trailing zeros (like the C format ``%.3g``)."""
    last = digits - 1
    size = F.abs(x)
    at = F.floor(F.log10(size))
    # rounding may carry into the next decade (0.9996 -> 1)
    at = F.floor(F.log10(F.round(size * F.pow(F.lit(10.0), last - at)) / F.pow(F.lit(10.0), last - at)) + 1e-9)
    out = F.when(size == 0, F.lit("0"))
    for e in range(-4, digits):
        text = fixed(x, last - e)
        out = out.when(at == e, F.regexp_replace(text, r"\.?0+$", "") if e < last else text)
    plain = F.format_string(f"%.{last}e", x.cast("double"))
    return out.otherwise(F.regexp_replace(plain, r"\.?0*e", "e"))
