"""Element tables into documents and their audit."""

import pytest

from corpuscope import Elements, assemble_documents, audit_folder, audit_manifest
from corpuscope import rulepack as rp
from corpuscope.operators.assemble import CELL, _tagged, facts_by_document
from corpuscope.plans import reports

AS_OF = "2024-01-01 00:00:00"


def files(spark, *names, **columns):
    rows = [(i, n, 10 + i, AS_OF) for i, n in enumerate(names, 1)]
    df = spark.createDataFrame(rows, "doc_id long, relative_path string, size_bytes long, modified_at string")
    for name, value in columns.items():
        df = df.withColumn(name, value)
    return df.withColumn("modified_at", df.modified_at.cast("timestamp"))


@pytest.fixture(scope="module")
def tables(spark):
    pages = [(2, 2, " second ", False, False), (2, 1, "first page " * 3, False, False), (2, 3, "lost", True, False)]
    pages += [(3, 1, "locked text", False, True), (9, 1, "no such file", False, False), (4, 1, "a page of a sheet file", False, False)]
    cells = [(4, "B", 1, 1, 1, "title", False), (4, "B", 1, 2, 1, "x", False), (4, "B", 1, 2, 2, "=1+1", True)]
    cells += [(4, "A", 2, 600, 2, "late", False), (4, "A", 2, 600, 1, " ", False), (4, "A", 2, 1, 1, None, False)]
    cells += [(None, "A", 1, 1, 1, "of nobody", False)]
    shapes = [(5, 1, 2, "text", "two"), (5, 1, 1, "text", "one"), (5, 1, 3, "picture", "no text"), (5, 1, 4, "picture", None)]
    shapes += [(5, 2, 1, "table", "in a table"), (5, 2, 2, "text", " 　 ")]
    texts = [(1, "cell", 0, "from a table"), (1, "paragraph", 700, "last"), (1, "paragraph", 3, "  first\n"), (1, "paragraph", 4, "\t")]
    return Elements(
        pages=spark.createDataFrame(pages, "doc_id long, page_no int, text string, failed boolean, encrypted boolean"),
        cells=spark.createDataFrame(cells, "doc_id long, sheet string, sheet_no int, row_no int, col_no int, value string, is_formula boolean"),
        merges=spark.createDataFrame([(4, "A", "A1:B2"), (4, "B", "A11:B12"), (4, "B", "odd")], "doc_id long, sheet string, ref string"),
        shapes=spark.createDataFrame(shapes, "doc_id long, slide_no int, shape_no int, kind string, text string"),
        texts=spark.createDataFrame(texts, "doc_id long, kind string, pos int, text string"),
        sheets=spark.createDataFrame([(4, "Empty", 3), (4, "A", 2)], "doc_id long, sheet string, sheet_no int"),
        slides=spark.createDataFrame([(5, 3), (5, 1)], "doc_id long, slide_no int"),
    )


NAMES = ("a.docx", "b.pdf", "c.PDF", "d.xlsx", "e.pptx", "f.docx", "g.txt", "h.zip", None)


def test_every_file_type(spark, tables):
    docs = files(spark, *NAMES)
    docs = docs.withColumn("text", docs.relative_path).withColumn("extra", docs.doc_id)
    got = assemble_documents(docs, tables)
    assert got.columns[:5] == ["doc_id", "relative_path", "size_bytes", "modified_at", "extra"]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == got.count() == len(NAMES) and all(r.extra == i for i, r in rows.items())
    said = {i: (r.text, r.parse_status, r.document_scale, r.scale_unit, list(r.layout_warnings)) for i, r in rows.items()}
    assert said[1] == ("first\nlast\nfrom a table", rp.DIRECT, 0, "", [])
    assert said[2] == (("first page " * 3).strip() + "\nsecond", rp.SPECIAL, 3, "页", [])
    assert rows[2].parse_issue == "有1页文字读取异常，建议重新导出文件"
    assert said[3] == ("", rp.SPECIAL, 0, "", []) and rows[3].parse_issue == rp.ISSUE_ENCRYPTED
    assert said[4] == ("B\ntitle\nx\n=1+1\nA\nlate\nEmpty", rp.DIRECT, 3, "个工作表", [rp.WARN_MERGED, rp.WARN_PREHEADER, "包含1个计算公式"])
    assert said[5] == ("one\ntwo\nin a table", rp.DIRECT, 3, "页", ["1页包含表格、图表或组合对象", "1页存在复杂图文混排"])
    # No elements, another format, no known format, no name: the text and status they had.
    assert rows[6].text == "f.docx" and rows[7].text == "g.txt"
    assert rows[6].parse_issue == rp.ISSUE_NOT_EXTRACTED and rows[8].parse_issue == rp.ISSUE_UNSUPPORTED


def test_parts_of_the_tables_and_empty_ones(spark, tables):
    docs = files(spark, *NAMES)
    assert assemble_documents(docs, Elements()).filter("text <> ''").count() == 0
    only = assemble_documents(docs, Elements(pages=tables.pages.limit(0), shapes=tables.shapes))
    assert {r.doc_id for r in only.filter("text <> ''").collect()} == {5}
    assert assemble_documents(docs.limit(0), tables).count() == 0
    known = docs.selectExpr("*", "'kept' AS text", "'s' AS parse_status", "'i' AS parse_issue", "7 AS document_scale", "'u' AS scale_unit")
    row = assemble_documents(known, tables).filter("doc_id = 6").first()
    assert (row.text, row.parse_status, row.parse_issue, row.document_scale, row.scale_unit) == ("kept", "s", "i", 7, "u")


def test_elements_move_once(spark, tables):
    rows = _tagged(tables.cells, CELL).unionByName(_tagged(tables.shapes, CELL))
    plan = facts_by_document(rows.repartition("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == plan.count("Exchange") == 1


def test_a_workbook_of_two_million_cells(spark):
    cells = spark.range(2_000_000).selectExpr(
        "1L AS doc_id", "'S' AS sheet", "1 AS sheet_no", "CAST(id DIV 10 AS INT) + 1 AS row_no", "CAST(id % 10 AS INT) AS col_no",
        "CAST(id AS STRING) AS value", "id % 1000 = 0 AS is_formula",
    )
    row = assemble_documents(files(spark, "big.xlsx"), Elements(cells=cells)).first()
    assert row.text == "S\n" + "\n".join(map(str, range(2_000_000))) and list(row.layout_warnings) == ["包含2000个计算公式"]


def test_folder_with_elements(spark, tables, tmp_path):
    root = tmp_path / "资料"
    (root / "sub").mkdir(parents=True)
    for name in ("sub/e.pptx", "g.txt", ".hidden"):
        (root / name).write_text("some bytes")
    shapes = tables.shapes.selectExpr("'sub/e.pptx' AS relative_path", "slide_no", "shape_no", "kind", "text")
    audit = audit_folder(spark, str(root), AS_OF, Elements(shapes=shapes))
    rows = {r.relative_path: r for r in audit.table().collect()}
    assert set(rows) == {"sub/e.pptx", "g.txt"} and rows["sub/e.pptx"].document_scale == 2
    assert "PPT排版较复杂" in rows["sub/e.pptx"].issues
    summary = reports.run_summary(audit.records, audit.skipped, audit.errors).first()
    assert (summary.total_files, summary.skipped_system_files, summary.access_errors_count) == (2, 1, 0)


def test_manifest_with_refused_rows(spark):
    docs = files(spark, "a.txt", ".git/b.txt", "c.txt", "d.pdf", ".git/e.txt")
    manifest = docs.selectExpr("*", "'文本' AS text", "doc_id = 3 AS is_hidden", "CASE WHEN doc_id = 4 THEN 'denied' END AS error")
    audit = audit_manifest(manifest, AS_OF)
    assert [r.relative_path for r in audit.table().collect()] == ["a.txt"]
    assert audit.skipped.first()[0] == 2 and [tuple(r) for r in audit.errors.collect()] == [("d.pdf", "denied")]
    bare = audit_manifest(manifest.drop("is_hidden", "error"), AS_OF)
    assert bare.records.count() == 3 and bare.errors is None


def test_groups_of_elements_are_read_in_order(spark, tables):
    """one sort, and no hash table of groups that falls back to sorting."""
    plan = assemble_documents(files(spark, "a.xlsx"), tables)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "collect_list" in plan
    rows = _tagged(tables.cells, CELL).unionByName(_tagged(tables.shapes, CELL))
    facts = facts_by_document(rows.repartition("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert facts.count("SortAggregate") == 3 and facts.count("Sort [") == 1
