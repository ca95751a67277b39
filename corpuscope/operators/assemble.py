"""Element tables into documents: one row per file, with text, status and layout facts.

Pages, cells, merged ranges, shapes and paragraphs are tagged rows of one union, which moves
once, by document. From there on three aggregations run on that partitioning:

* by chunk (some hundred rows of a sheet, a page, a slide): the chunk's parts in order as one
  text, and its counters;
* by group (sheet, page, slide): the chunks in order, the header rule;
* by document: the groups in order, the counts of groups, the rules of its file type.

All three read sorted rows, so no table of groups is held. A document's parts are never gathered one by one: a workbook of ten million cells is
some ten thousand chunk texts in its task."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rulepack as rp
from ..functions import paths
from ..functions.normalize import strip
from ..functions.text import content_length, join_text_parts
from ..session import SORTED_GROUPS
from . import elements as rules

#: Rows of a sheet, or positions of a text, that make a chunk.
CHUNK_ROWS = 512
PAGE, CELL, MERGE, SHAPE, ELEMENT = range(1, 6)
TAGGED = {".docx": ELEMENT, ".pdf": PAGE, ".xlsx": CELL, ".pptx": SHAPE}


@dataclass(frozen=True)
class Elements:
    """The element tables of a set of documents; any may be missing. All name their document
    by ``doc_id`` (or ``relative_path``, see ``numbered``).

    pages: page_no, text, failed, encrypted. cells: sheet, row_no, col_no, value, is_formula
    and optionally sheet_no. merges: sheet, ref. shapes: slide_no, shape_no, kind, text.
    texts: kind ('paragraph' or 'cell'), pos, text. sheets (sheet, optionally sheet_no) and
    slides (slide_no) name those that may hold nothing."""

    pages: DataFrame | None = None
    cells: DataFrame | None = None
    merges: DataFrame | None = None
    shapes: DataFrame | None = None
    texts: DataFrame | None = None
    sheets: DataFrame | None = None
    slides: DataFrame | None = None

    def numbered(self, files: DataFrame) -> Elements:
        """The tables with the ``doc_id`` that ``files`` gives their ``relative_path``."""
        names = files.select("relative_path", "doc_id")
        found = {}
        for field in fields(self):
            table = getattr(self, field.name)
            if table is not None and "doc_id" not in table.columns:
                found[field.name] = table.join(names, "relative_path")
        return replace(self, **found)


def _tagged(table: DataFrame, tag: int, **columns: Column) -> DataFrame:
    """The rows of a table in the common form; what a table lacks is null."""
    null = F.lit(None)
    given = {
        "group_no": F.lit(0),
        "group_name": F.lit(""),
        "chunk": F.lit(0),
        "k1": F.lit(0),
        "k2": F.lit(0),
        "part": null,
        "row_no": null,
        "is_formula": F.lit(False),
        "kind": null,
        "failed": F.lit(False),
        "encrypted": F.lit(False),
        "ref": null,
        **columns,
    }
    types = {
        "group_no": "long", "group_name": "string", "chunk": "long", "k1": "long", "k2": "long", "part": "string",
        "row_no": "long", "is_formula": "boolean", "kind": "string", "failed": "boolean", "encrypted": "boolean",
        "ref": "string",
    }
    return table.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.lit(tag).alias("tag"),
        *[given[name].cast(kind).alias(name) for name, kind in types.items()],
    )


def tagged_rows(e: Elements) -> list[DataFrame]:
    rows = []

    def sheet_no(table: DataFrame) -> Column:
        return F.col("sheet_no") if "sheet_no" in table.columns else F.lit(0)

    if e.pages is not None:
        readable = F.when(~F.coalesce("failed", F.lit(False)), F.col("text"))
        # One chunk per page row: the pages of a document are counted by rows.
        rows.append(
            _tagged(e.pages, PAGE, group_no=F.col("page_no"), part=readable,
                    failed=F.coalesce("failed", F.lit(False)), encrypted=F.coalesce("encrypted", F.lit(False)))
        )
    if e.cells is not None:
        rows.append(
            _tagged(e.cells, CELL, group_no=sheet_no(e.cells), group_name=F.col("sheet"),
                    chunk=F.floor(F.col("row_no") / CHUNK_ROWS), k1=F.col("row_no"), k2=F.col("col_no"),
                    part=F.col("value"), row_no=F.when(F.col("value").isNotNull(), F.col("row_no")),
                    is_formula=F.coalesce("is_formula", F.lit(False)))
        )
    if e.sheets is not None:
        rows.append(_tagged(e.sheets, CELL, group_no=sheet_no(e.sheets), group_name=F.col("sheet")))
    if e.merges is not None:
        rows.append(_tagged(e.merges, MERGE, ref=F.col("ref")))
    if e.shapes is not None:
        spoken = F.when(F.col("kind").isin("text", "table"), F.col("text"))
        rows.append(
            _tagged(e.shapes, SHAPE, group_no=F.col("slide_no"), chunk=F.floor(F.col("shape_no") / CHUNK_ROWS),
                    k1=F.col("shape_no"), part=spoken, kind=F.col("kind"))
        )
    if e.slides is not None:
        rows.append(_tagged(e.slides, SHAPE, group_no=F.col("slide_no")))
    if e.texts is not None:
        later = (F.col("kind") != "paragraph").cast("long")
        rows.append(
            _tagged(e.texts, ELEMENT, group_no=later, chunk=F.floor(F.col("pos") / CHUNK_ROWS),
                    k1=F.col("pos"), part=F.col("text"))
        )
    return rows


def _texts(pieces: Column) -> Column:
    """The pieces' texts in order, by line feeds."""
    return F.array_join(F.transform(F.array_sort(pieces), lambda p: p["text"]), "\n")


def _gathered(text: str, *keys: str) -> Column:
    """The texts that are not empty, with the keys that order them."""
    return F.collect_list(F.when(F.col(text) != "", F.struct(*keys, F.col(text).alias("text"))))


def facts_by_document(rows: DataFrame) -> DataFrame:
    """(doc_id, tag, text, counters) of tagged rows that lie together by document."""
    heads = range(1, rules.HEADER_ROWS + 1)
    part = strip(F.coalesce("part", F.lit("")))
    group = ["doc_id", "tag", "group_no", "group_name"]
    # One sort serves all three aggregations: each takes its groups one after the other
    # (see SORTED_GROUPS), and the later sorts are dropped as redundant.
    trimmed = rows.withColumn("part", part).sortWithinPartitions(*group, "chunk")
    early = rules.merge_bounds(F.col("ref"))
    chunks = trimmed.groupBy(*group, "chunk").agg(
        _texts(_gathered("part", "k1", "k2")).alias("text"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("failed").alias("failed"),
        F.bool_or("encrypted").alias("encrypted"),
        F.count_if("is_formula").alias("formulas"),
        *[F.count_if(F.col("row_no") == i).alias(f"r{i}") for i in heads],
        F.count_if((F.col("kind") == "text") & (F.col("part") != "")).alias("texts"),
        F.count_if(F.col("kind") == "picture").alias("pictures"),
        F.coalesce(F.bool_or(F.col("kind").isin("table", "chart", "group")), F.lit(False)).alias("structured"),
        F.count_if(early["early"]).alias("header_merges"),
        F.coalesce(F.bool_or(early["early"] & early["vertical"]), F.lit(False)).alias("vertical_merge"),
    )
    sums = ["n", "failed", "formulas", *[f"r{i}" for i in heads], "texts", "pictures", "header_merges"]
    flags = ["encrypted", "structured", "vertical_merge"]
    groups = chunks.sortWithinPartitions(*group).groupBy(*group).agg(
        _texts(_gathered("text", "chunk")).alias("text"),
        *[F.sum(c).alias(c) for c in sums],
        *[F.bool_or(c).alias(c) for c in flags],
    )
    titled = F.when(F.col("tag") == CELL, join_text_parts(F.array("group_name", "text"))).otherwise(F.col("text"))
    groups = groups.withColumn("text", titled).withColumn("preheader", rules.preheader(*[F.col(f"r{i}") for i in heads]))
    mixed = (F.col("pictures") >= 2) & (F.col("texts") >= 2)
    return groups.sortWithinPartitions("doc_id", "tag").groupBy("doc_id", "tag").agg(
        _texts(_gathered("text", "group_no", "group_name")).alias("text"),
        F.sum("n").alias("page_count"),
        F.count(F.lit(1)).alias("groups"),
        F.sum("failed").alias("failed_pages"),
        F.bool_or("encrypted").alias("encrypted"),
        F.sum("formulas").alias("formulas"),
        F.count_if("preheader").alias("preheader_sheets"),
        F.sum("header_merges").alias("header_merges"),
        F.bool_or("vertical_merge").alias("vertical_merge"),
        F.count_if("structured").alias("structured_slides"),
        F.count_if(F.col("texts") >= 5).alias("multi_text_slides"),
        F.count_if(mixed).alias("mixed_slides"),
    )


#: What a document keeps of the tag its file type reads; the rest of its rows do not count.
_OWN = (
    "text page_count groups failed_pages encrypted formulas preheader_sheets structured_slides "
    "multi_text_slides mixed_slides"
).split()


def assemble_documents(files: DataFrame, elements: Elements) -> DataFrame:
    """``files`` (doc_id, relative_path and any columns of ``analyze``) with text, parse_status,
    parse_issue, document_scale, scale_unit and layout_warnings from their elements.

    Only Word, PDF, Excel and PowerPoint files take elements; all other rows, and such files
    without elements of their type, keep the text and status they have, or get the status of a
    document whose content was not extracted. Elements of unknown documents, or of a type
    that the file's suffix does not read, do not count. doc_id is unique in ``files``."""
    suffix = paths.suffix(paths.name_of(F.col("relative_path")))
    have = set(files.columns)
    missing = F.when(F.lit("text" not in have) | F.lit("parse_status" not in have), F.lit("missing"))
    status, issue = rules.extract_dispatch(suffix, missing, F.lit(None).cast("string"))
    base = files.select(
        *[c for c in files.columns if c not in RESULT],
        (F.col("text") if "text" in have else F.lit("")).alias("text"),
        (F.col("parse_status") if "parse_status" in have else status).alias("parse_status"),
        (F.col("parse_issue") if "parse_issue" in have else issue).alias("parse_issue"),
        (F.col("document_scale").cast("long") if "document_scale" in have else F.lit(0).cast("long")).alias("document_scale"),
        (F.col("scale_unit") if "scale_unit" in have else F.lit("")).alias("scale_unit"),
        (F.col("layout_warnings") if "layout_warnings" in have else F.array().cast("array<string>")).alias("layout_warnings"),
    )
    tables = tagged_rows(elements)
    if not tables:
        return base
    takes = F.coalesce(suffix.isin(*TAGGED), F.lit(False))
    marks = F.coalesce(*[F.when(suffix == s, F.lit(tag)) for s, tag in TAGGED.items()])
    named = base.filter(takes).select(
        F.col("doc_id").cast("long").alias("doc_id"), marks.alias("_own"), F.struct(*base.columns).alias("_file")
    )
    union = tables[0]
    for table in tables[1:]:
        union = union.unionByName(table)
    files.sparkSession.conf.set(SORTED_GROUPS, "true")
    # Elements move here and only here: what follows needs rows of a document together.
    facts = facts_by_document(union.filter(F.col("doc_id").isNotNull()).repartition("doc_id"))
    rest = base.filter(~takes | F.col("doc_id").isNull())
    return rest.unionByName(_with_facts(named.filter(F.col("doc_id").isNotNull()), facts, base.columns))


RESULT = ("text", "parse_status", "parse_issue", "document_scale", "scale_unit", "layout_warnings")


def _with_facts(own: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """The files with the facts of their type's elements (and merged ranges)."""
    mine = F.col("tag") == F.col("_own")
    merges = F.col("tag") == MERGE
    rows = own.join(facts, "doc_id", "left").groupBy("doc_id").agg(
        F.first("_file").alias("_file"),
        F.first("_own").alias("_own"),
        F.coalesce(F.bool_or(mine), F.lit(False)).alias("_found"),
        *[F.first(F.when(mine, F.col(c)), ignorenulls=True).alias(f"_{c}") for c in _OWN],
        F.coalesce(F.max(F.when(merges, F.col("header_merges"))), F.lit(0)).alias("_header_merges"),
        F.coalesce(F.bool_or(F.when(merges, F.col("vertical_merge"))), F.lit(False)).alias("_vertical_merge"),
    )
    kind = F.col("_own")
    length = content_length(F.col("_text"))
    status, issue, scale, unit = rules.page_verdict(
        F.col("_encrypted"), length, F.col("_page_count"), F.col("_failed_pages")
    )
    pages, books, decks = kind == PAGE, kind == CELL, kind == SHAPE
    none = F.array().cast("array<string>")
    result = {
        "text": F.when(pages & F.col("_encrypted"), "").otherwise(F.col("_text")),
        "parse_status": F.when(pages, status).otherwise(rp.DIRECT),
        "parse_issue": F.when(pages, issue).otherwise(""),
        "document_scale": F.when(pages, scale).when(books | decks, F.col("_groups")).otherwise(F.lit(0)).cast("long"),
        "scale_unit": F.when(pages, unit).when(books, "个工作表").when(decks, "页").otherwise(""),
        "layout_warnings": F.when(books, rules.workbook_warnings("_")).when(decks, rules.deck_warnings("_")).otherwise(none),
    }
    return rows.select(
        *[
            F.when(F.col("_found"), result[c]).otherwise(F.col(f"_file.{c}")).alias(c) if c in result else F.col(f"_file.{c}").alias(c)
            for c in columns
        ]
    )
