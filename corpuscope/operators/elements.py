"""Extraction rules over element tables (pages, cells, merged ranges, shapes).

Decoding one office file is a single-file library's work; the tables it yields
are this module's input. Every rule is a partial aggregation that combines on
the map side. Only the ``*_text`` functions gather a document's parts, because
their result is that document's text, one row per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rulepack as rp
from ..functions.normalize import strip
from ..functions.text import content_length, join_text_parts

HEADER_ROWS = 10


def ordered_text(parts: DataFrame, order: list[Column], text: Column) -> DataFrame:
    """(doc_id, text): trimmed non-empty parts joined by line feeds, in order."""
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    rows = parts.select("doc_id", F.struct(*keys, F.coalesce(text, F.lit("")).alias("text")).alias("part"))
    sorted_parts = F.transform(F.sort_array(F.collect_list("part")), lambda p: p["text"])
    return rows.groupBy("doc_id").agg(join_text_parts(sorted_parts).alias("text"))


def paragraph_table_text(elements: DataFrame) -> DataFrame:
    """Word: (doc_id, kind, pos, text) with kind 'paragraph' or 'cell'; body
    paragraphs first, then table cells."""
    return ordered_text(elements, [F.col("kind") != "paragraph", F.col("pos")], F.col("text"))


def page_text(pages: DataFrame) -> DataFrame:
    readable = F.when(~F.col("failed"), F.col("text"))
    return ordered_text(pages, [F.col("page_no")], readable)


def page_rules(pages: DataFrame) -> DataFrame:
    """PDF: (doc_id, page_no, text, failed, encrypted) to one status row per document.

    The content length of the joined text is the sum over its pages, since
    trimming and line feeds touch no counted character."""
    readable = F.when(F.col("failed"), F.lit("")).otherwise(F.coalesce("text", F.lit("")))
    facts = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.count_if("failed").alias("failed_pages"),
        F.bool_or("encrypted").alias("encrypted"),
        F.sum(content_length(readable)).alias("length"),
    )
    status, issue, scale, unit = page_verdict(
        F.col("encrypted"), F.col("length"), F.col("page_count"), F.col("failed_pages")
    )
    return facts.select(
        "doc_id",
        status.alias("parse_status"),
        F.when(F.col("encrypted"), F.lit(0)).otherwise(F.col("length")).alias("content_length"),
        scale.alias("document_scale"),
        unit.alias("scale_unit"),
        issue.alias("parse_issue"),
    )


def page_verdict(locked: Column, length: Column, pages: Column, failed_pages: Column) -> tuple[Column, Column, Column, Column]:
    """(parse_status, parse_issue, document_scale, scale_unit) of a PDF file."""
    scanned = length < F.greatest(F.lit(20), pages * 10)
    failed = failed_pages > 0
    return (
        F.when(locked | scanned | failed, rp.SPECIAL).otherwise(rp.DIRECT),
        F.when(locked, rp.ISSUE_ENCRYPTED)
        .when(scanned, rp.ISSUE_SCANNED)
        .when(failed, F.format_string("有%d页文字读取异常，建议重新导出文件", failed_pages))
        .otherwise(""),
        F.when(locked, F.lit(0)).otherwise(pages),
        F.when(locked, "").otherwise("页"),
    )


def sheet_text(cells: DataFrame) -> DataFrame:
    """Excel: sheet title, then its non-null values row by row, sheet after sheet.

    Sheets come in workbook order (``sheet_no``); without that column, by title."""
    if "sheet_no" not in cells.columns:
        cells = cells.withColumn("sheet_no", F.lit(0))
    sheet = ["doc_id", "sheet_no", "sheet"]
    titles = cells.select(*sheet).distinct()
    titles = titles.select(*sheet, F.lit(0).alias("row_no"), F.lit(0).alias("col_no"), F.col("sheet").alias("value"))
    values = cells.filter(F.col("value").isNotNull()).select(*sheet, "row_no", "col_no", "value")
    order = [F.col(c) for c in ("sheet_no", "sheet", "row_no", "col_no")]
    return ordered_text(titles.unionByName(values), order, F.col("value"))


def sheet_facts(cells: DataFrame) -> DataFrame:
    """(doc_id, sheet, formulas, preheader): the first ten rows are ten counters,
    so one shuffle of partial counts decides the header rule."""
    filled = F.col("value").isNotNull()
    counters = [
        F.count_if(filled & (F.col("row_no") == i)).alias(f"r{i}") for i in range(1, HEADER_ROWS + 1)
    ]
    counted = cells.groupBy("doc_id", "sheet").agg(F.count_if("is_formula").alias("formulas"), *counters)
    flag = preheader(*[F.col(f"r{i}") for i in range(1, HEADER_ROWS + 1)])
    return counted.select("doc_id", "sheet", "formulas", flag.alias("preheader"))


def preheader(*filled: Column) -> Column:
    """Whether something stands before a sheet's header, from the filled cells of its first
    rows."""
    rows = F.array(*[F.struct(F.lit(i).alias("row"), n.alias("n")) for i, n in enumerate(filled, 1)])
    used = F.filter(rows, lambda r: r["n"] > 0)
    first = F.get(used, F.lit(0))
    header_later = F.exists(F.slice(used, 2, 3), lambda r: r["n"] >= 2)
    return F.coalesce(header_later & ((first["row"] > 1) | (first["n"] == 1)), F.lit(False))


def preheader_sheets(cells: DataFrame) -> DataFrame:
    return sheet_facts(cells).groupBy("doc_id").agg(F.count_if("preheader").alias("preheader_sheets"))


def formula_count(cells: DataFrame) -> DataFrame:
    return cells.groupBy("doc_id").agg(F.count_if("is_formula").alias("formulas"))


def header_merges(merges: DataFrame) -> DataFrame:
    """Merged ranges (doc_id, sheet, ref) that start within the first ten rows."""
    found = merge_bounds(F.col("ref"))
    return merges.groupBy("doc_id").agg(
        F.count_if(found["early"]).alias("header_merges"),
        F.coalesce(F.bool_or(found["early"] & found["vertical"]), F.lit(False)).alias("vertical_merge"),
    )


def merge_bounds(ref: Column) -> dict[str, Column]:
    """early: starts within the header rows; vertical: spans rows."""
    start = F.regexp_extract(ref, r"\A[A-Z]+(\d+):[A-Z]+\d+\z", 1).try_cast("long")
    end = F.regexp_extract(ref, r"\A[A-Z]+\d+:[A-Z]+(\d+)\z", 1).try_cast("long")
    return {"early": start <= HEADER_ROWS, "vertical": end > start}


def workbook_rules(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """(doc_id, sheets, preheader_sheets, formulas, header_merges, vertical_merge,
    layout_warnings) per workbook."""
    books = (
        sheet_facts(cells)
        .groupBy("doc_id")
        .agg(
            F.count(F.lit(1)).alias("sheets"),
            F.count_if("preheader").alias("preheader_sheets"),
            F.sum("formulas").alias("formulas"),
        )
    )
    joined = books.join(header_merges(merges), "doc_id", "left").fillna(
        {"header_merges": 0, "vertical_merge": False}
    )
    return joined.withColumn("layout_warnings", workbook_warnings())


def workbook_warnings(prefix: str = "") -> Column:
    """From the columns vertical_merge, header_merges, preheader_sheets and formulas."""
    sheets, formulas = F.col(f"{prefix}preheader_sheets"), F.col(f"{prefix}formulas")
    merged = F.col(f"{prefix}vertical_merge") | (F.col(f"{prefix}header_merges") > sheets)
    return F.array_compact(
        F.array(
            F.when(merged, rp.WARN_MERGED),
            F.when(sheets > 0, rp.WARN_PREHEADER),
            F.when(formulas > 0, F.format_string("包含%d个计算公式", formulas)),
        )
    )


def slide_rules(shapes: DataFrame) -> DataFrame:
    """PowerPoint: (doc_id, slide_no, shape_no, kind, text) to layout facts per deck.

    Kinds: text, table, chart, group, picture."""
    is_text = (F.col("kind") == "text") & (strip(F.coalesce("text", F.lit(""))) != "")
    slides = shapes.groupBy("doc_id", "slide_no").agg(
        F.count_if(is_text).alias("texts"),
        F.count_if(F.col("kind") == "picture").alias("pictures"),
        F.bool_or(F.col("kind").isin("table", "chart", "group")).alias("structured"),
    )
    decks = slides.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("slides"),
        F.count_if("structured").alias("structured_slides"),
        F.count_if(F.col("texts") >= 5).alias("multi_text_slides"),
        F.count_if((F.col("pictures") >= 2) & (F.col("texts") >= 2)).alias("mixed_slides"),
    )
    return decks.withColumn("layout_warnings", deck_warnings())


def deck_warnings(prefix: str = "") -> Column:
    """From the columns structured_slides, multi_text_slides and mixed_slides."""

    def warn(count: str, text: str) -> Column:
        number = F.col(f"{prefix}{count}")
        return F.when(number > 0, F.format_string(f"%d页{text}", number))

    return F.array_compact(
        F.array(
            warn("structured_slides", "包含表格、图表或组合对象"),
            warn("multi_text_slides", "包含较多独立文本框"),
            warn("mixed_slides", "存在复杂图文混排"),
        )
    )


def slide_text(shapes: DataFrame) -> DataFrame:
    """Text of text shapes and table cells in slide and shape order."""
    spoken = shapes.filter(F.col("kind").isin("text", "table"))
    return ordered_text(spoken, [F.col("slide_no"), F.col("shape_no")], F.col("text"))


def extract_dispatch(suffix: Column, error_kind: Column, error_name: Column) -> tuple[Column, Column]:
    """(parse_status, parse_issue) from the extension and the reader's failure, if any.

    ``error_kind``: null, 'encoding', 'permission', 'damaged' (unreadable
    container, OS or value error), 'missing' (nothing has extracted the content)
    or anything else for an unexpected error."""
    legacy = suffix.isin(*rp.LEGACY)
    unknown = ~suffix.isin(*rp.SUPPORTED) & ~legacy
    status = (
        F.when(unknown, rp.UNAVAILABLE)
        .when(legacy | error_kind.isNotNull(), rp.SPECIAL)
        .otherwise(rp.DIRECT)
    )
    issue = (
        F.when(unknown, rp.ISSUE_UNSUPPORTED)
        .when(legacy, rp.ISSUE_LEGACY)
        .when(error_kind == "encoding", rp.ISSUE_ENCODING)
        .when(error_kind == "permission", rp.ISSUE_PERMISSION)
        .when(error_kind == "missing", rp.ISSUE_NOT_EXTRACTED)
        .when(
            error_kind == "damaged", F.concat(F.lit("文件可能损坏或格式异常（"), error_name, F.lit("）"))
        )
        .when(error_kind.isNotNull(), F.concat(F.lit("文件读取异常（"), error_name, F.lit("）")))
        .otherwise("")
    )
    return status, issue
