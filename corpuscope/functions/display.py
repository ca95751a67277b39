"""Presentation text of numbers and cells, shared by reports and lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rulepack import DOCUMENT_KINDS

UNITS = ("B", "KB", "MB", "GB", "TB")


def grouped(count: Column) -> Column:
    """1,234 style integer text."""
    return F.format_string("%,d", count.cast("long"))


def format_size(size_bytes: Column) -> Column:
    """1024-step unit text with one decimal (half to even); whole bytes below 1 KB."""
    text = None
    for power in range(len(UNITS) - 1, 0, -1):
        value = size_bytes / F.lit(float(1024**power))
        shown = F.format_string(f"%.1f {UNITS[power]}", F.bround(value, 1))
        text = shown if text is None else F.when(size_bytes < 1024 ** (power + 1), shown).otherwise(text)
    return F.when(size_bytes < 1024, F.format_string("%,d B", size_bytes.cast("long"))).otherwise(text)


def percent_value(count: Column, total: Column) -> Column:
    """Whole percent, halves to even; 0 of nothing."""
    return F.when(total > 0, F.rint(count * 100 / total).cast("int")).otherwise(F.lit(0))


def percent(count: Column, total: Column) -> Column:
    return F.concat(percent_value(count, total).cast("string"), F.lit("%"))


def size_mb(size_bytes: Column) -> Column:
    return size_bytes / F.lit(1024.0 * 1024.0)


def formula_guard(text: Column) -> Column:
    """Keep spreadsheet programs from reading a cell as a formula."""
    value = F.coalesce(text, F.lit(""))
    return F.when(value.rlike(r"\A[=+@-]"), F.concat(F.lit("'"), value)).otherwise(value)


def document_kind(display_type: Column) -> Column:
    kind = F.substring_index(display_type, "（", 1)
    return F.when(kind.isin(*DOCUMENT_KINDS[:-1]), kind).otherwise(F.lit(DOCUMENT_KINDS[-1]))
