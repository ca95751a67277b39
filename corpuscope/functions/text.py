"""Character-level measures of a document's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import REPLACEMENT, SPACE_CLASS, digest_of_folded, drop_spaces, fold, strip

CONTENT_CLASS = r"A-Za-z0-9\x{3400}-\x{9fff}"
# Nested to the right: a common character leaves the class at the first test.
_SUSPICIOUS = (
    r"[^ -~]&&[[^\x{4e00}-\x{9fa5}]&&[[^\t-\r\xa0-\x{24f}]&&[[\x{fffd}\p{Cc}\p{Co}\p{Cs}\p{Cn}]&&[^"
    + SPACE_CLASS
    + r"]]]]"
)


def count_of_class(text: Column, char_class: str) -> Column:
    """Number of characters in a class: one find per run, not per character."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{char_class}]+", ""))


def content_length(text: Column) -> Column:
    """Characters a reader counts: ASCII letters, digits and CJK ideographs."""
    return count_of_class(text, CONTENT_CLASS)


def garbled_ratio(text: Column) -> Column:
    """Share of replacement, control, private-use and unassigned characters
    among the non-space ones; 0 for blank text. The non-space characters are
    only counted in texts that have a suspicious one."""
    suspicious = count_of_class(text, _SUSPICIOUS)
    return F.get(
        F.transform(
            F.array(suspicious),
            lambda n: F.when(n > 0, n / F.length(drop_spaces(text))).otherwise(F.lit(0.0)),
        ),
        F.lit(0),
    )


def replacement_ratio(text: Column, bare: Column) -> Column:
    """``garbled_ratio`` of text inside JVM_RANGES, given it (or its residue) and it without
    white space."""
    # The mark is three bytes of UTF-8, and bytes need no counting; few texts have one.
    marks = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(REPLACEMENT), F.lit("")))) / 3
    return F.when(text.contains(REPLACEMENT), marks / F.length(bare)).otherwise(F.lit(0.0))


def content_of_residue(text: Column, rest: Column, spaces: Column, far: Column | None = None) -> Column:
    """``content_length`` by the residue: what it lacks is ASCII letters and ``spaces``. Its
    digits are counted apart from the ideographs, which the far residue has too."""
    letters = F.octet_length(text) - F.octet_length(rest) - spaces
    # Bytes need no counting, and a class of single characters is one look into a table.
    digits = F.octet_length(rest) - F.octet_length(F.regexp_replace(rest, "[0123456789]+", ""))
    # Each ideograph is three bytes.
    seen = rest if far is None else far
    others = F.regexp_replace(seen, r"[\x{3400}-\x{9fff}]+", "")
    return letters + digits + ((F.octet_length(seen) - F.octet_length(others)) / 3).cast("int")


def text_fingerprint(text: Column) -> Column:
    return digest_of_folded(fold(text))


def binary_fingerprint(content: Column, size_bytes: Column) -> Column:
    """SHA-256 of the bytes; null for empty or unreadable files."""
    return F.when(size_bytes > 0, F.sha2(content, 256))


def join_text_parts(parts: Column) -> Column:
    """Trimmed, non-empty parts joined by a line feed."""
    return F.array_join(F.filter(F.transform(parts, strip), lambda p: p != ""), "\n")


def age_years(modified_at: Column, as_of: Column) -> Column:
    """Whole 24-hour days between the two instants, in years of 365.25 days."""
    days = F.timestamp_diff("DAY", modified_at, as_of)
    return F.greatest(F.lit(0.0), days / F.lit(365.25))
