"""Registered queries: one per operator, each with its DuckDB counterpart."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope import analyze, assemble_documents, audit_manifest, extract_features
from corpuscope import rulepack as rp
from corpuscope.functions import display, normalize, paths, risks, text
from corpuscope.operators import elements, findings, groups, topics
from corpuscope.operators.pairing import pair_rows
from corpuscope.operators.skew import number_rows
from corpuscope.plans import reports
from corpuscope.plans.audit import (
    Audit,
    as_timestamp,
    document_features,
    document_rules,
    finalize_verdicts,
)
from corpuscope.rulepack import DEFAULT_PACK as PACK
from corpuscope.session import materialize, pin_session, scratch_root
from corpuscope.sinks import writer
from corpuscope.sinks.writer import write_outputs
from corpuscope.sources import content, inventory
from corpuscope.sources import tree as trees
from corpuscope.sources.tables import read_table

from . import oracle as o
from .fixtures import AS_OF, dealt, office_elements, table, write_tree

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

c = F.col


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            pin_session(spark)
            return fn(spark, folder.rstrip("/"))

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "corpus")


def measured(spark: SparkSession, folder: str) -> DataFrame:
    return document_features(corpus(spark, folder), PACK)


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Stage 1, written once because the cross-document rules read it repeatedly."""
    return materialize(extract_features(corpus(spark, folder), AS_OF), "features")


def audit(spark: SparkSession, folder: str) -> Audit:
    return analyze(corpus(spark, folder), AS_OF)


def on_corpus(name: str, expression: Callable[[], Column], sql: str) -> None:
    """A scalar operator over the whole text of every document."""
    query(name, o.sql("corpus", f"SELECT doc_id, {sql} AS {name} FROM corpus"))(
        lambda spark, folder: corpus(spark, folder).select("doc_id", expression().alias(name))
    )


def on_features(name: str, columns: Callable[[], dict[str, Column]], sql: str, upto: str = "named") -> None:
    query(name, o.sql(upto, f"SELECT doc_id, {sql} FROM {upto}"))(
        lambda spark, folder: measured(spark, folder).select(
            "doc_id", *[column.alias(alias) for alias, column in columns().items()]
        )
    )


def on_audit(name: str, build: Callable[[DataFrame], DataFrame], sql: str, *stages: str) -> None:
    query(name, o.sql("records", sql, *stages))(
        lambda spark, folder: build(audit(spark, folder).records)
    )


def stamp(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


DUCK_STAMP = "strftime(modified_at, '%Y-%m-%d %H:%M:%S') AS modified_at"

# --- sources -------------------------------------------------------------------

_BAD = (
    "(lower(p) IN ('thumbs.db', '.ds_store', 'desktop.ini', '$recycle.bin', 'system volume information', '__pycache__') "
    "OR starts_with(p, '.') OR starts_with(p, '~$'))"
)
_CLEAN = f"len(list_filter(string_split(relative_path, '/'), lambda p: {_BAD})) = 0"
_NAME = "string_split(relative_path, '/')[-1]"
_EXT = rf"lower(regexp_extract({_NAME}, '^.+(\.[^.]+)$', 1))"


@query("ignore_filter", o.table_sql("manifest", f"SELECT doc_id, relative_path FROM manifest WHERE {_CLEAN}"))
def _(spark, folder):
    return inventory.ignore_filter(table(spark, folder, "manifest")).select("doc_id", "relative_path")


@query(
    "skipped_count",
    o.table_sql(
        "manifest",
        f"""SELECT count(DISTINCT array_to_string(parts[1:i], '/')) AS skipped_system_files FROM (
          SELECT string_split(relative_path, '/') AS parts,
            list_position(list_transform(string_split(relative_path, '/'), lambda p: {_BAD}), true) AS i FROM manifest)
        WHERE i > 0""",
    ),
)
def _(spark, folder):
    return inventory.skipped_count(table(spark, folder, "manifest"))


@query(
    "classify_file",
    o.table_sql(
        "manifest",
        f"SELECT doc_id, {o.category(_EXT)} AS category, {o.display_type(_EXT)} AS display_type, "
        f"{o.scan_note(_EXT)} AS scan_note FROM manifest",
    ),
)
def _(spark, folder):
    kind = inventory.classify_file(paths.suffix(paths.name_of(c("relative_path"))))
    return table(spark, folder, "manifest").select("doc_id", *[v.alias(k) for k, v in kind.items()])


_RECORD_SQL = f"""SELECT doc_id, {_NAME} AS file_name, relative_path, {o.category(_EXT)} AS category,
  {o.display_type(_EXT)} AS display_type, coalesce(nullif({_EXT}, ''), '无扩展名') AS extension, size_bytes, {DUCK_STAMP},
  '已盘点' AS scan_status, {o.scan_note(_EXT)} AS scan_note, '尚未解析' AS parse_status, 0 AS content_length,
  0 AS document_scale, '' AS scale_unit, '' AS parse_issue, '尚未判断' AS use_status, '' AS issues, '' AS priority,
  '' AS recommendation, '' AS duplicate_group, '' AS version_group, '' AS sensitive_risks, 0 AS sensitive_risk_count,
  '待确认资料' AS suggested_knowledge_base FROM manifest"""


@query("record_projection", o.table_sql("manifest", _RECORD_SQL))
def _(spark, folder):
    records = inventory.record_projection(table(spark, folder, "manifest"))
    return records.withColumn("modified_at", stamp("modified_at"))


@query("inventory_only", o.table_sql("manifest", f"{_RECORD_SQL} WHERE {_CLEAN}"))
def _(spark, folder):
    records = inventory.inventory_only(table(spark, folder, "manifest"))
    return records.withColumn("modified_at", stamp("modified_at"))


@query(
    "sort_inventory",
    o.table_sql(
        "manifest",
        f"SELECT doc_id, row_number() OVER (ORDER BY lower(relative_path), lower({_NAME}), doc_id) AS pos FROM manifest",
    ),
)
def _(spark, folder):
    records = inventory.record_projection(table(spark, folder, "manifest")).select(
        "doc_id", F.lower("relative_path").alias("path_key"), F.lower("file_name").alias("name_key")
    )
    return number_rows(records, [c(k) for k in groups.ORDER], "pos").select("doc_id", "pos")


@query(
    "access_errors",
    o.table_sql("manifest", "SELECT relative_path AS path, relative_path || ': denied' AS message FROM manifest WHERE contains(relative_path, 'error/')"),
)
def _(spark, folder):
    path = c("relative_path")
    entries = table(spark, folder, "manifest").select(
        path.alias("path"), F.when(path.contains("error/"), F.concat(path, F.lit(": denied"))).alias("error")
    )
    return inventory.access_errors(entries)


_TREE_KEPT = f"SELECT *, CAST(strlen(text) AS BIGINT) AS size_bytes FROM tree WHERE {_CLEAN}"
_TREE_SKIPPED = f"""(SELECT count(DISTINCT array_to_string(parts[1:list_position(flags, true)], '/')) FROM (
  SELECT string_split(relative_path, '/') AS parts,
    list_transform(string_split(relative_path, '/'), lambda p: {_BAD}) AS flags FROM tree) WHERE list_contains(flags, true))"""


@query(
    "scan_corpus",
    o.table_sql(
        "tree",
        f"SELECT relative_path, size_bytes, {_TREE_SKIPPED} AS skipped, CAST(0 AS BIGINT) AS errors FROM kept",
        f", kept AS ({_TREE_KEPT})",
    ),
)
def _(spark, folder):
    listing = inventory.scan_corpus(spark, write_tree(spark, folder))
    return listing.files.select(
        "relative_path",
        "size_bytes",
        listing.skipped.scalar().alias("skipped"),
        listing.errors.agg(F.count(F.lit(1))).scalar().alias("errors"),
    )


@query(
    "read_documents",
    o.table_sql(
        "tree",
        "SELECT relative_path, sha256(text) AS content_sha256, "
        "CASE WHEN ends_with(relative_path, '.pdf') THEN sha256('') ELSE sha256(text) END AS text_sha256, "
        "CASE WHEN ends_with(relative_path, '.pdf') THEN '需特殊处理' ELSE '可直接解析' END AS parse_status FROM kept",
        f", kept AS ({_TREE_KEPT})",
    ),
)
def _(spark, folder):
    listing = inventory.scan_corpus(spark, write_tree(spark, folder))
    docs = content.read_documents(listing.files)
    return docs.select("relative_path", "content_sha256", F.sha2("text", 256).alias("text_sha256"), "parse_status")


@query(
    "folder_errors",
    "SELECT 'gone-' || n_name AS path, true AS told FROM nation",
)
def _(spark, folder):
    names = read_table(spark, folder, "nation").select(F.concat(F.lit("gone-"), "n_name").alias("relative_path"))
    work = names.select("relative_path", F.lit("").alias("low"), F.lit(None).cast("string").alias("high"))
    root = scratch_root(spark)
    errors = inventory.access_errors(trees.list_folders(work, root))
    told = c("message").contains("No such file or directory")
    return errors.select(F.replace("path", F.lit(f"{root}/"), F.lit("")).alias("path"), told.alias("told"))


# --- extraction ------------------------------------------------------------------


@query(
    "decode_text",
    "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE sha256(text) END AS digest, "
    "CASE WHEN doc_id % 4 = 3 THEN '需特殊处理' ELSE '可直接解析' END AS parse_status FROM documents",
)
def _(spark, folder):
    docs = dealt(read_table(spark, folder, "documents"))
    kind, body = c("doc_id") % 4, c("text")
    utf8 = body.cast("binary")
    raw = (
        F.when(kind == 0, utf8)
        .when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), utf8))
        .when(kind == 2, F.encode(body, "UTF-16"))
        .otherwise(F.concat(F.unhex(F.lit("00")), utf8))
    )
    decoded = docs.select("doc_id", raw.alias("content")).select(
        "doc_id", content.decode_text(c("content")).alias("decoded")
    )
    status, _ = elements.extract_dispatch(
        F.lit(".txt"), F.when(c("decoded").isNull(), F.lit("encoding")), F.lit("")
    )
    return decoded.select("doc_id", F.sha2("decoded", 256).alias("digest"), status.alias("parse_status"))


def _joined_sql(name: str, order: str, value: str = "text", where: str = "true") -> str:
    trimmed = f"regexp_replace(regexp_replace({value}, '^{o.SPACE}+', ''), '{o.SPACE}+$', '')"
    return (
        f"SELECT doc_id, coalesce(string_agg({trimmed}, chr(10) ORDER BY {order}) FILTER ({trimmed} <> ''), '') AS text "
        f"FROM {name} WHERE {where} GROUP BY doc_id"
    )


@query("join_text_parts", o.table_sql("elements", _joined_sql("elements", "pos")))
def _(spark, folder):
    return elements.ordered_text(table(spark, folder, "elements"), [c("pos")], c("text"))


on_corpus("content_length", lambda: text.content_length(c("text")), o.content_length("text"))


@query("paragraph_table_text", o.table_sql("elements", _joined_sql("elements", "kind <> 'paragraph', pos")))
def _(spark, folder):
    return elements.paragraph_table_text(table(spark, folder, "elements"))


_PAGE_RULES = f"""page_facts AS (SELECT doc_id, count(*) AS n, count(*) FILTER (failed) AS bad, bool_or(encrypted) AS locked,
  CAST(sum(CASE WHEN failed THEN 0 ELSE {o.content_length('text')} END) AS BIGINT) AS len FROM pages GROUP BY doc_id),
page_rules AS (SELECT doc_id, CASE WHEN locked OR len < greatest(20, 10 * n) OR bad > 0 THEN '需特殊处理' ELSE '可直接解析' END AS parse_status,
  CASE WHEN locked THEN 0 ELSE len END AS content_length, CASE WHEN locked THEN 0 ELSE n END AS document_scale,
  CASE WHEN locked THEN '' ELSE '页' END AS scale_unit,
  CASE WHEN locked THEN '文件已加密，需要提供可读取版本' WHEN len < greatest(20, 10 * n) THEN '疑似扫描文件，需要先识别文字'
    WHEN bad > 0 THEN '有' || bad || '页文字读取异常，建议重新导出文件' ELSE '' END AS parse_issue FROM page_facts)"""


@query("page_rules", o.table_sql("pages", "SELECT * FROM page_rules", ", " + _PAGE_RULES))
def _(spark, folder):
    return elements.page_rules(table(spark, folder, "pages"))


@query("page_text", o.table_sql("pages", _joined_sql("pages", "page_no", "CASE WHEN failed THEN '' ELSE text END")))
def _(spark, folder):
    return elements.page_text(table(spark, folder, "pages"))


_SHEET_PARTS = """, parts AS (SELECT DISTINCT doc_id, sheet_no, 0 AS row_no, 0 AS col_no, sheet AS value FROM cells
  UNION ALL SELECT doc_id, sheet_no, row_no, col_no, value FROM cells WHERE value IS NOT NULL)"""


@query(
    "sheet_text",
    o.table_sql("cells", _joined_sql("parts", "sheet_no, row_no, col_no, value", "value"), _SHEET_PARTS),
)
def _(spark, folder):
    return elements.sheet_text(table(spark, folder, "cells"))


_PREHEADER = """row_n AS (SELECT doc_id, sheet, row_no, count(value) AS n FROM cells WHERE row_no <= 10 GROUP BY ALL),
used_rows AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sheet ORDER BY row_no) AS rn FROM row_n WHERE n > 0),
sheet_flags AS (SELECT doc_id, sheet, coalesce(bool_or(rn BETWEEN 2 AND 4 AND n >= 2), false)
    AND (max(CASE WHEN rn = 1 THEN row_no END) > 1 OR max(CASE WHEN rn = 1 THEN n END) = 1) AS preheader
  FROM used_rows GROUP BY ALL),
preheaders AS (SELECT s.doc_id, count(*) FILTER (preheader) AS preheader_sheets
  FROM (SELECT DISTINCT doc_id, sheet FROM cells) s LEFT JOIN sheet_flags USING (doc_id, sheet) GROUP BY s.doc_id),
formulas AS (SELECT doc_id, count(*) FILTER (is_formula) AS formulas FROM cells GROUP BY doc_id)"""


@query("preheader_sheets", o.table_sql("cells", "SELECT * FROM preheaders", ", " + _PREHEADER))
def _(spark, folder):
    return elements.preheader_sheets(table(spark, folder, "cells"))


@query("formula_count", o.table_sql("cells", "SELECT * FROM formulas", ", " + _PREHEADER))
def _(spark, folder):
    return elements.formula_count(table(spark, folder, "cells"))


_MERGES = r"""ranges AS (SELECT doc_id, regexp_extract(ref, '^[A-Z]+(\d+):', 1)::BIGINT AS a, regexp_extract(ref, ':[A-Z]+(\d+)$', 1)::BIGINT AS b FROM merges),
merge_facts AS (SELECT doc_id, count(*) FILTER (a <= 10) AS header_merges, coalesce(bool_or(a <= 10 AND b > a), false) AS vertical_merge
  FROM ranges GROUP BY doc_id)"""


@query("header_merges", o.table_sql("merges", "SELECT * FROM merge_facts", ", " + _MERGES))
def _(spark, folder):
    return elements.header_merges(table(spark, folder, "merges"))


_SLIDES = f"""slides AS (SELECT doc_id, slide_no,
  count(*) FILTER (kind = 'text' AND regexp_replace(coalesce(text, ''), '{o.SPACE}', '', 'g') <> '') AS texts,
  count(*) FILTER (kind = 'picture') AS pictures, bool_or(kind IN ('table', 'chart', 'group')) AS structured FROM shapes GROUP BY ALL),
decks AS (SELECT doc_id, count(*) AS slides, count(*) FILTER (structured) AS structured_slides,
  count(*) FILTER (texts >= 5) AS multi_text_slides, count(*) FILTER (pictures >= 2 AND texts >= 2) AS mixed_slides FROM slides GROUP BY doc_id)"""


@query("slide_rules", o.table_sql("shapes", "SELECT * FROM decks", ", " + _SLIDES))
def _(spark, folder):
    return elements.slide_rules(table(spark, folder, "shapes")).drop("layout_warnings")


@query(
    "slide_text",
    o.table_sql("shapes", _joined_sql("shapes", "slide_no, shape_no", "text", "kind IN ('text', 'table')")),
)
def _(spark, folder):
    return elements.slide_text(table(spark, folder, "shapes"))


_WARNED = f"""cells AS ({o.fixtures.duck_sql('cells')}), merges AS ({o.fixtures.duck_sql('merges')}),
{_PREHEADER}, {_MERGES}, {_SLIDES},
warned AS (
  SELECT doc_id, '.xlsx' AS suffix,
    CASE WHEN coalesce(vertical_merge, false) OR coalesce(header_merges, 0) > preheader_sheets THEN {o.q(rp.WARN_MERGED)} END AS w1,
    CASE WHEN preheader_sheets > 0 THEN {o.q(rp.WARN_PREHEADER)} END AS w2,
    CASE WHEN formulas > 0 THEN '包含' || formulas || '个计算公式' END AS w3
  FROM preheaders JOIN formulas USING (doc_id) LEFT JOIN merge_facts USING (doc_id)
  UNION ALL
  SELECT doc_id, '.pptx', CASE WHEN structured_slides > 0 THEN structured_slides || '页包含表格、图表或组合对象' END,
    CASE WHEN multi_text_slides > 0 THEN multi_text_slides || '页包含较多独立文本框' END,
    CASE WHEN mixed_slides > 0 THEN mixed_slides || '页存在复杂图文混排' END
  FROM decks)"""


def _layouts(spark, folder) -> DataFrame:
    books = elements.workbook_rules(table(spark, folder, "cells"), table(spark, folder, "merges"))
    decks = elements.slide_rules(table(spark, folder, "shapes"))
    pick = ("doc_id", "suffix", "layout_warnings")
    return (
        books.withColumn("suffix", F.lit(".xlsx"))
        .select(*pick)
        .unionByName(decks.withColumn("suffix", F.lit(".pptx")).select(*pick))
    )


@query(
    "layout_warnings",
    o.table_sql("shapes", "SELECT doc_id, suffix, concat_ws('|', w1, w2, w3) AS layout_warnings FROM warned", ", " + _WARNED),
)
def _(spark, folder):
    return _layouts(spark, folder).withColumn("layout_warnings", F.array_join("layout_warnings", "|"))


def _office_text(name: str, order: str, digit: int, value: str = "text", where: str = "true") -> str:
    return f"SELECT doc_id * 10 + {digit} AS doc_id, text FROM ({_joined_sql(name, order, value, where)})"


_OFFICE = f"""pages AS ({o.fixtures.duck_sql('pages')}), elements AS ({o.fixtures.duck_sql('elements')}),
office AS ({o.fixtures.duck_sql('office')}), {_PAGE_RULES}, {_WARNED}{_SHEET_PARTS},
office_text AS (
  {_office_text('elements', "kind <> 'paragraph', pos", 1)}
  UNION ALL {_office_text('pages', 'page_no', 2, "CASE WHEN failed THEN '' ELSE text END")}
  UNION ALL {_office_text('parts', 'sheet_no, row_no, col_no, value', 3, 'value')}
  UNION ALL SELECT f.doc_id * 10 + 4, coalesce(t.text, '') FROM decks f
    LEFT JOIN ({_joined_sql('shapes', 'slide_no, shape_no', 'text', "kind IN ('text', 'table')")}) t ON t.doc_id = f.doc_id),
sheet_n AS (SELECT doc_id, count(DISTINCT sheet) AS sheets FROM cells GROUP BY doc_id),
office_facts AS (
  SELECT doc_id * 10 + 1 AS doc_id, 0 AS scale, '' AS unit, '可直接解析' AS status, '' AS issue, NULL AS w1, NULL AS w2, NULL AS w3
  FROM (SELECT DISTINCT doc_id FROM elements)
  UNION ALL SELECT doc_id * 10 + 2, document_scale, scale_unit, parse_status, parse_issue, NULL, NULL, NULL FROM page_rules
  UNION ALL SELECT w.doc_id * 10 + 3, sheets, '个工作表', '可直接解析', '', w1, w2, w3
    FROM warned w JOIN sheet_n USING (doc_id) WHERE suffix = '.xlsx'
  UNION ALL SELECT w.doc_id * 10 + 4, slides, '页', '可直接解析', '', w1, w2, w3
    FROM warned w JOIN decks USING (doc_id) WHERE suffix = '.pptx'),
assembled AS (
  SELECT o.*, CASE WHEN f.issue = {o.q(rp.ISSUE_ENCRYPTED)} THEN '' ELSE coalesce(t.text, '') END AS text,
    coalesce(status, '需特殊处理') AS given_status,
    coalesce(issue, CASE extension WHEN '.doc' THEN {o.q(rp.ISSUE_LEGACY)} ELSE {o.q(rp.ISSUE_NOT_EXTRACTED)} END) AS given_issue,
    CAST(coalesce(scale, 0) AS BIGINT) AS given_scale, coalesce(unit, '') AS given_unit, w1, w2, w3
  FROM office o LEFT JOIN office_facts f USING (doc_id) LEFT JOIN office_text t USING (doc_id))"""


def _assembled(spark, folder) -> DataFrame:
    return assemble_documents(table(spark, folder, "office"), office_elements(spark, folder))


@query(
    "assemble_documents",
    o.table_sql(
        "shapes",
        "SELECT doc_id, relative_path, given_status AS parse_status, given_issue AS parse_issue, given_scale AS document_scale, "
        "given_unit AS scale_unit, concat_ws('|', w1, w2, w3) AS layout_warnings, sha256(text) AS text_sha256 FROM assembled",
        ", " + _OFFICE,
    ),
)
def _(spark, folder):
    return _assembled(spark, folder).select(
        "doc_id",
        "relative_path",
        "parse_status",
        "parse_issue",
        "document_scale",
        "scale_unit",
        F.array_join("layout_warnings", "|").alias("layout_warnings"),
        F.sha2("text", 256).alias("text_sha256"),
    )


@query(
    "extract_dispatch",
    o.table_sql(
        "manifest",
        f"""SELECT doc_id, CASE WHEN e IN ('.doc', '.xls', '.ppt') THEN '需特殊处理'
          WHEN e NOT IN ('.docx', '.pdf', '.xlsx', '.pptx', '.txt', '.md') THEN '暂无法解析'
          WHEN t IN ('error', 'view', 'click', 'signup') THEN '需特殊处理' ELSE '可直接解析' END AS parse_status,
        CASE WHEN e IN ('.doc', '.xls', '.ppt') THEN '旧版Office文件，建议转换为常用格式'
          WHEN e NOT IN ('.docx', '.pdf', '.xlsx', '.pptx', '.txt', '.md') THEN '第一版暂不支持读取此类文件'
          WHEN t = 'error' THEN '文件无法访问，请检查权限或是否被占用'
          WHEN t = 'view' THEN '文件可能损坏或格式异常（ValueError）'
          WHEN t = 'click' THEN '文件读取异常（ValueError）' WHEN t = 'signup' THEN '文字编码异常，建议重新保存文件' ELSE '' END AS parse_issue
        FROM (SELECT m.doc_id, {_EXT} AS e, v.event_type AS t FROM manifest m JOIN events v ON v.event_id = m.doc_id)""",
    ),
)
def _(spark, folder):
    kind = (
        F.when(c("relative_path").contains("error/"), "permission")
        .when(c("relative_path").contains("view/"), "damaged")
        .when(c("relative_path").contains("click/"), "other")
        .when(c("relative_path").contains("signup/"), "encoding")
    )
    suffix = paths.suffix(paths.name_of(c("relative_path")))
    status, issue = elements.extract_dispatch(suffix, kind, F.lit("ValueError"))
    return table(spark, folder, "manifest").select(
        "doc_id", status.alias("parse_status"), issue.alias("parse_issue")
    )


# --- scalar functions --------------------------------------------------------------

on_corpus("text_fingerprint", lambda: text.text_fingerprint(c("text")), o.text_fp("text"))
on_corpus(
    "binary_fingerprint",
    lambda: text.binary_fingerprint(c("content"), c("size_bytes")),
    "CASE WHEN size_bytes > 0 THEN sha256(content) END",
)
on_corpus("garbled_ratio", lambda: text.garbled_ratio(c("text")), o.garbled("text"))
on_features("bad_name", lambda: {"bad_name": c("bad_name")}, "bad_name")
on_features(
    "attachment_or_template",
    lambda: {"attachment": paths.attachment_or_template(c("folded_stem"))},
    "attachment",
)
on_features("age_years", lambda: {"age": text.age_years(c("modified_at"), as_timestamp(AS_OF))}, "age")
on_features(
    "version_key",
    lambda: {"version_key": c("version_key"), "version_marker": c("version_marker")},
    "version_key, version_marker",
)
on_corpus("risk_phone", lambda: risks.phone_count(c("text")), f"CAST({o.PHONE} AS INT)")
on_corpus("risk_id", lambda: risks.id_count(c("text")), f"CAST({o.ID} AS INT)")
on_corpus("risk_email", lambda: risks.email_count(c("text")), f"CAST({o.EMAIL} AS INT)")
on_corpus("risk_classification", lambda: risks.secrecy_count(c("text")), f"CAST({o.SECRECY} AS INT)")
on_corpus("risk_salary", lambda: risks.salary_count(c("text")), f"CAST({o.SALARY} AS INT)")
on_corpus("risk_contract_amount", lambda: risks.contract_count(c("text")), f"CAST({o.CONTRACT} AS INT)")


@query("risk_bank_card", o.sql("measured", "SELECT doc_id, CAST(card AS INT) AS risk_bank_card FROM measured"))
def _(spark, folder):
    return corpus(spark, folder).select("doc_id", risks.card_count(c("text")).alias("risk_bank_card"))


_RISK_JSON = (
    "'{' || concat_ws(',', "
    + ", ".join(f"CASE WHEN {r} > 0 THEN '\"{o.LABELS[r]}\":' || {r} END" for r in o.RISKS)
    + ") || '}'"
)
on_features(
    "risk_map",
    lambda: {
        "risks": F.to_json(risks.risk_map(c("risk_counts"))),
        "risk_text": risks.risk_text(c("risk_counts")),
        "risk_total": risks.risk_total(c("risk_counts")),
    },
    f"{_RISK_JSON} AS risks, {o.RISK_TEXT} AS risk_text, {o.RISK_TOTAL} AS risk_total",
    "measured",
)
on_features("risk_severity", lambda: {"high_impact": risks.has_high_impact(c("risk_counts"))}, f"{o.HIGH} AS high_impact", "measured")


@query(
    "keyword_match",
    o.sql(
        "named",
        "SELECT doc_id, regexp_matches(fstem, '(^|[^a-z0-9])it([^a-z0-9]|$)') AS it, contains(fstem, '系统') AS system FROM named",
    ),
)
def _(spark, folder):
    stem = c("folded_stem")
    return measured(spark, folder).select(
        "doc_id", topics.keyword_match(stem, "IT").alias("it"), topics.keyword_match(stem, "系统").alias("system")
    )


def _by_topic(numbers: Column, value: str) -> Column:
    names = F.array(*[F.lit(t.name) for t in rp.TOPICS])
    pairs = F.transform(
        numbers, lambda n, i: F.struct(F.get(names, i).alias("topic"), n.cast("long").alias(value))
    )
    return F.inline(pairs)


@query(
    "keyword_score",
    o.sql(
        "topics",
        " UNION ALL ".join(
            f"SELECT doc_id, {o.q(t.name)} AS topic, CAST({o._hits('body', t.keywords)} AS BIGINT) AS hits FROM topic_src"
            for t in rp.TOPICS
        ),
    ),
)
def _(spark, folder):
    return measured(spark, folder).select("doc_id", _by_topic(c("body_hits"), "hits"))


on_features(
    "theme_anchor", lambda: {"anchor": c("folded_anchor")}, f"lower({o.ANCHOR}) AS anchor"
)
on_features("folder_text", lambda: {"folder_text": c("folder_text")}, f"lower({o.FOLDER_TEXT}) AS folder_text")


@query(
    "formula_guard",
    "SELECT o_orderkey, CASE WHEN x[1] IN ('=', '+', '-', '@') THEN '''' || x ELSE x END AS guarded FROM "
    "(SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' ELSE '' END || o_orderpriority AS x FROM orders)",
)
def _(spark, folder):
    sign = F.get(F.array(*[F.lit(x) for x in "=+-@"], F.lit("")), (c("o_orderkey") % 5).cast("int"))
    return read_table(spark, folder, "orders").select(
        "o_orderkey", display.formula_guard(F.concat(sign, c("o_orderpriority"))).alias("guarded")
    )


_BYTES = "CAST(round(l_extendedprice * 100) AS BIGINT) * CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END"


@query(
    "format_size",
    f"SELECT b, {o.size_text('b')} AS shown, count(*) AS n FROM (SELECT {_BYTES} AS b FROM lineitem) GROUP BY ALL",
)
def _(spark, folder):
    sized = read_table(spark, folder, "lineitem").select(F.expr(_BYTES).alias("b"))
    return sized.groupBy("b", display.format_size(c("b")).alias("shown")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "percent",
    f"SELECT o_custkey, n, total, {o.percent('n', 'total')} AS share FROM (SELECT o_custkey, "
    "count(*) FILTER (o_orderstatus = 'F') AS n, count(*) AS total FROM orders GROUP BY o_custkey)",
)
def _(spark, folder):
    counts = read_table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count_if(c("o_orderstatus") == "F").alias("n"), F.count(F.lit(1)).alias("total")
    )
    return counts.withColumn("share", display.percent(c("n"), c("total")))


@query("document_kind", o.table_sql("manifest", f"SELECT doc_id, {o.kind(o.display_type(_EXT))} AS kind FROM manifest"))
def _(spark, folder):
    kind = inventory.classify_file(paths.suffix(paths.name_of(c("relative_path"))))["display_type"]
    return table(spark, folder, "manifest").select("doc_id", display.document_kind(kind).alias("kind"))


on_audit(
    "problem_label",
    lambda r: r.select("doc_id", F.array_join(reports.problem_labels(c("issues")), "|").alias("labels")),
    "SELECT doc_id, concat_ws('|', "
    + ", ".join(f"CASE WHEN {o.marker('issues', p.markers)} THEN {o.q(p.label)} END" for p in rp.PROBLEMS)
    + ") AS labels FROM records",
)
on_audit(
    "example_detail",
    lambda r: reports.affected_records(r).select("label", "doc_id", reports.example_detail(c("label")).alias("detail")),
    f"SELECT label, doc_id, {o.DETAIL} AS detail FROM problem_rows",
    "problems",
)
on_audit(
    "status_detail",
    lambda r: r.select("doc_id", reports.status_detail().alias("detail")),
    f"SELECT doc_id, {o.STATUS_DETAIL} AS detail FROM records",
)
on_corpus("size_mb", lambda: display.size_mb(c("size_bytes")), "size_bytes / 1048576.0::DOUBLE")

# --- findings ----------------------------------------------------------------------


def _finding_rows(df: DataFrame, rules: list[Column]) -> DataFrame:
    return df.select("doc_id", F.inline(findings.fired(rules)))


def _rule(name: str, position: int) -> None:
    sql = o.rule_sql(name, "named")
    query(name, o.sql("named", f"SELECT doc_id, issue, advice, status_rank, priority_rank FROM ({sql})"))(
        lambda spark, folder: _finding_rows(
            measured(spark, folder), [document_rules(as_timestamp(AS_OF), PACK)[position]]
        )
    )


for _name, _position in (
    ("rule_unreadable", 0),
    ("rule_length", 1),
    ("rule_garbled", 2),
    ("rule_age", 3),
    ("rule_name", 4),
    ("rule_attachment", 7),
    ("rule_sensitive", 8),
):
    _rule(_name, _position)


@query(
    "rule_unreadable_pages",
    o.table_sql(
        "pages",
        "SELECT doc_id, issue, advice, status_rank, priority_rank FROM (" + o.rule_sql("rule_unreadable", "page_rules") + ")",
        ", " + _PAGE_RULES,
    ),
)
def _(spark, folder):
    pages = elements.page_rules(table(spark, folder, "pages"))
    return _finding_rows(pages, [findings.rule_unreadable(c("parse_status"), c("parse_issue"))])


@query(
    "rule_layout",
    o.table_sql(
        "shapes",
        """SELECT doc_id, 'Excel表头前有标题或说明（' || w2 || '）' AS issue,
          '建议把表格标题写入文件名或单独的资料说明，并让正式数据区域从单行表头开始；删除表头前不必要的空行，确保每行是一条完整记录' AS advice,
          1 AS status_rank, 1 AS priority_rank FROM warned WHERE suffix = '.xlsx' AND w2 IS NOT NULL
        UNION ALL SELECT doc_id, 'Excel排版较复杂（' || concat_ws('、', w1, w3) || '）',
          '建议整理成单行表头、每行一条记录的明细表；公式列应补充字段说明或保留可核对的结果值，复杂原表可作为附件下载', 1, 2
        FROM warned WHERE suffix = '.xlsx' AND (w1 IS NOT NULL OR w3 IS NOT NULL)
        UNION ALL SELECT doc_id, 'PPT排版较复杂（' || concat_ws('、', w1, w2, w3) || '）',
          '建议按页面补充标题和文字摘要；重要流程、图表和图片另写文字说明，复杂原PPT可作为参考附件下载', 1, 2
        FROM warned WHERE suffix = '.pptx' AND (w1 IS NOT NULL OR w2 IS NOT NULL OR w3 IS NOT NULL)""",
        ", " + _WARNED,
    ),
)
def _(spark, folder):
    return _finding_rows(_layouts(spark, folder), findings.rules_layout(c("suffix"), c("layout_warnings")))


@query(
    "accumulate_findings",
    o.sql(
        "named",
        """SELECT n.doc_id, coalesce(string_agg(issue, '；' ORDER BY seq), '') AS issues,
          coalesce(string_agg(advice, '；' ORDER BY seq), '') AS recommendation,
          CASE coalesce(max(status_rank), 0) WHEN 0 THEN '可直接使用' WHEN 1 THEN '整理后使用' ELSE '暂不能使用' END AS use_status,
          CASE coalesce(max(priority_rank), 0) WHEN 0 THEN '' WHEN 1 THEN '后续优化' WHEN 2 THEN '建议处理' ELSE '优先处理' END AS priority
        FROM named n LEFT JOIN (SELECT * FROM """
        + "(" + o.BASE_FINDINGS.removeprefix("base_findings AS (") + ") f USING (doc_id) GROUP BY n.doc_id",
    ),
)
def _(spark, folder):
    found = extract_features(corpus(spark, folder), AS_OF)
    return found.select("doc_id", *[v.alias(k) for k, v in findings.accumulate(c("findings")).items()])


def _marked(spark, folder) -> DataFrame:
    docs = features(spark, folder)
    return groups.cross_document_marks(docs, PACK)


for _name in ("rule_duplicate", "rule_version"):
    _source = "(SELECT * FROM marked WHERE duplicate_group IS NOT NULL)" if _name == "rule_duplicate" else "marked"
    ORACLE[_name] = o.sql(
        "verdicts",
        f"SELECT doc_id, issue, advice, status_rank, priority_rank FROM ({o.rule_sql(_name, _source)})",
    )


@query("rule_duplicate")
def _(spark, folder):
    rule = findings.rule_duplicate(c("duplicate_group").isNotNull(), c("is_primary"))
    return _finding_rows(_marked(spark, folder), [rule])


@query("rule_version")
def _(spark, folder):
    return _finding_rows(_marked(spark, folder), [findings.rule_version(c("version_group").isNotNull())])


_RECORD = [x for x in (
    "doc_id", "file_name", "relative_path", "category", "display_type", "extension", "size_bytes",
    "scan_status", "scan_note", "parse_status", "content_length", "document_scale", "scale_unit", "parse_issue", "use_status",
    "issues", "priority", "recommendation", "duplicate_group", "version_group", "sensitive_risks", "sensitive_risk_count",
)]


@query("finalize_verdicts", o.sql("verdicts", f"SELECT {', '.join(_RECORD)}, {DUCK_STAMP} FROM verdicts"))
def _(spark, folder):
    docs = features(spark, folder)
    return finalize_verdicts(docs, groups.cross_document_marks(docs, PACK)).select(*_RECORD, stamp("modified_at"))


_LAYOUT_FINDINGS = """
  UNION ALL SELECT doc_id, 4.5 AS seq, 'Excel表头前有标题或说明（' || w2 || '）' AS issue, '' AS advice, 1 AS status_rank, 1 AS priority_rank
  FROM named WHERE suffix = '.xlsx' AND w2 IS NOT NULL
  UNION ALL SELECT doc_id, 4.6, 'Excel排版较复杂（' || concat_ws('、', w1, w3) || '）', '', 1, 2
  FROM named WHERE suffix = '.xlsx' AND (w1 IS NOT NULL OR w3 IS NOT NULL)
  UNION ALL SELECT doc_id, 4.7, 'PPT排版较复杂（' || concat_ws('、', w1, w2, w3) || '）', '', 1, 2
  FROM named WHERE suffix = '.pptx' AND (w1 IS NOT NULL OR w2 IS NOT NULL OR w3 IS NOT NULL)"""


def _elements_audit_sql() -> str:
    """The chain of the corpus audit over the assembled documents."""
    whole = o.sql("verdicts", "SELECT * FROM verdicts")
    head, rest = whole.split(f"corpus AS ({o.fixtures.duck_sql('corpus')})")
    shapes = f"shapes AS ({o.fixtures.duck_sql('shapes')})"
    rest = rest.replace("CASE WHEN size_bytes > 0 THEN sha256(content) END AS binary_fp", "CAST(NULL AS VARCHAR) AS binary_fp")
    for name, end in (("given_status", "END AS parse_status"), ("given_issue", "END AS parse_issue")):
        first = rest.index("CASE WHEN extension IN ('.doc'")
        last = rest.index(end) + len(end)
        rest = rest[:first] + f"{name} AS {end.split()[-1]}" + rest[last:]
    rest = rest.replace("SELECT * FROM base_findings", "SELECT * FROM base_findings" + _LAYOUT_FINDINGS)
    rest = rest.replace("'b' || binary_fp AS signature FROM named WHERE size_bytes > 0", "'b' AS signature FROM named WHERE false")
    body = rest.removesuffix("SELECT * FROM verdicts")
    select = (
        "SELECT doc_id, parse_status, parse_issue, CAST(content_length AS BIGINT) AS content_length, given_scale AS document_scale, "
        "given_unit AS scale_unit, use_status, issues, priority, duplicate_group, version_group, sensitive_risks "
        "FROM verdicts JOIN assembled USING (doc_id)"
    )
    return f"{head}{shapes}, {_OFFICE}, corpus AS (SELECT * FROM assembled){body}{select}"


@query("audit_elements", _elements_audit_sql())
def _(spark, folder):
    done = analyze(_assembled(spark, folder), AS_OF)
    return done.records.select(
        *"doc_id parse_status parse_issue content_length document_scale scale_unit use_status issues priority".split(),
        "duplicate_group", "version_group", "sensitive_risks",
    )


# --- groups ------------------------------------------------------------------------


@query(
    "signature_groups",
    o.sql(
        "dups",
        "SELECT CASE WHEN signature[1] = 'b' THEN '00' ELSE '01' END || signature[2:] AS signature, n, rep FROM shared",
    ),
)
def _(spark, folder):
    found = groups.signature_groups(extract_features(corpus(spark, folder), AS_OF), PACK)
    return found.withColumn("signature", F.lower(F.hex("signature")))


@query("duplicate_components", o.sql("dups", "SELECT doc_id, component FROM members"))
def _(spark, folder):
    return groups.duplicate_members(features(spark, folder), PACK)


@query("elect_primary", o.sql("dups", "SELECT component, n, primary_id FROM primaries"))
def _(spark, folder):
    docs = features(spark, folder)
    return groups.elect_primary(groups.duplicate_members(docs, PACK), docs).drop("first")


@query("version_families", o.sql("versions", "SELECT parent_key, version_key, n FROM families"))
def _(spark, folder):
    families = groups.version_families(extract_features(corpus(spark, folder), AS_OF), PACK)
    return families.drop("first", "root_key")


@query(
    "group_ids",
    o.sql(
        "verdicts",
        "SELECT doc_id, duplicate_group, version_group FROM marked WHERE duplicate_group IS NOT NULL OR version_group IS NOT NULL",
    ),
)
def _(spark, folder):
    return _marked(spark, folder).drop("is_primary")


@query(
    "positional_zip",
    o.sql("topics", "SELECT n.doc_id, n.file_name, s.topic FROM named n JOIN special s USING (doc_id)"),
)
def _(spark, folder):
    docs = corpus(spark, folder).select("doc_id", "file_name")
    topic = extract_features(corpus(spark, folder), AS_OF).select("doc_id", "topic")
    return pair_rows(docs, topic)


on_audit(
    "category_lookup",
    lambda r: reports.category_lookup(r.select(c("suggested_knowledge_base").alias("topic")).distinct()),
    f"SELECT DISTINCT topic, description FROM records JOIN {o.DESCRIPTIONS} ON topic = suggested_knowledge_base",
)
on_audit(
    "affected_records",
    lambda r: reports.affected_records(r).select("label", "doc_id"),
    "SELECT label, doc_id FROM problem_rows",
    "problems",
)


@query(
    "selected_topics_filter",
    o.sql("topics", "SELECT doc_id, final_topic AS suggested_knowledge_base FROM special JOIN final_topics USING (topic)"),
)
def _(spark, folder):
    docs = features(spark, folder)
    return topics.assign_topics(docs, PACK).select("doc_id", "suggested_knowledge_base")


# --- topics ------------------------------------------------------------------------


@query("topic_scores", o.sql("topics", "SELECT doc_id, topic, CAST(score AS BIGINT) AS score FROM scores"))
def _(spark, folder):
    scored = topics.with_topic_scores(measured(spark, folder), PACK)
    return scored.select("doc_id", _by_topic(c("scores"), "score"))


def _chosen(spark, folder) -> DataFrame:
    return topics.with_topic_choice(topics.with_topic_scores(measured(spark, folder), PACK), PACK)


@query("choose_topic", o.sql("topics", "SELECT doc_id, topic FROM chosen"))
def _(spark, folder):
    return _chosen(spark, folder).select("doc_id", "topic")


@query(
    "specialise_topic",
    o.sql(
        "topics",
        """SELECT doc_id, CASE WHEN topic <> '销售与客户服务知识库' THEN topic WHEN doc_id % 3 = 0 THEN '经销商与客户服务知识库'
          WHEN doc_id % 3 = 1 THEN '门店销售助手知识库' ELSE topic END AS topic FROM chosen""",
    ),
)
def _(spark, folder):
    anchor = F.when(c("doc_id") % 3 == 0, "华东经销商").when(c("doc_id") % 3 == 1, "门店销售助手").otherwise("销售")
    return _chosen(spark, folder).select(
        "doc_id", topics.specialise_topic(c("topic"), anchor, PACK).alias("topic")
    )


def _line_topics(spark, folder, topic: str) -> DataFrame:
    """Line items as documents of a corpus with a known topic mix."""
    lines = read_table(spark, folder, "lineitem")
    return lines.select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("doc_id"),
        c("l_shipdate").cast("string").alias("path_key"),
        c("l_returnflag").alias("name_key"),
        F.expr(topic).alias("topic"),
    )


_MIX = (
    "CASE WHEN l_quantity <= 43 THEN '合同与法务知识库' WHEN l_quantity <= 44 THEN '员工办事知识库' "
    "WHEN l_quantity <= 45 THEN '财务与经营知识库' WHEN l_quantity <= 49 THEN '产品与解决方案知识库' ELSE '待确认资料' END"
)


@query(
    "absorb_tiny_topics",
    f"""WITH t AS (SELECT {_MIX} AS topic, count(*) AS n FROM lineitem GROUP BY 1),
    o AS (SELECT sum(n) AS total, max(n) AS lead_n, arg_max(topic, n) AS lead FROM t WHERE topic <> '待确认资料')
    SELECT topic, n, CASE WHEN total >= 10 AND lead_n / total >= 0.8 AND topic <> '待确认资料' AND n <= greatest(1, floor(total * 0.03))
      THEN lead ELSE topic END AS absorbed FROM t, o""",
)
def _(spark, folder):
    counts = topics.topic_counts(_line_topics(spark, folder, _MIX))
    return topics.absorb_tiny_topics(counts, PACK).drop("first")


_SEVEN = "CASE l_linenumber " + " ".join(f"WHEN {i} THEN {o.q(t.name)}" for i, t in enumerate(rp.TOPICS[:7], 1)) + " ELSE '待确认资料' END"


@query(
    "cap_topics",
    f"""SELECT topic, n FROM (SELECT {_SEVEN} AS topic, count(*) AS n,
      min((CAST(l_shipdate AS VARCHAR), l_returnflag, l_orderkey * 10 + l_linenumber)) AS first
    FROM lineitem GROUP BY 1) WHERE topic <> '待确认资料' ORDER BY n DESC, first LIMIT 6""",
)
def _(spark, folder):
    counts = topics.topic_counts(_line_topics(spark, folder, _SEVEN))
    capped = topics.cap_topics(topics.absorb_tiny_topics(counts, PACK), PACK)
    return capped.select(c("absorbed").alias("topic"), "n")


_PLAN_SQL = f"""SELECT CAST(row_number() OVER (ORDER BY document_count DESC, first) AS INT) AS ord, plan.topic AS name, description, document_count,
  CASE WHEN plan.topic = '待确认资料' THEN '需要人工确认' ELSE {o.SITUATION} END AS current_situation,
  coalesce(main_issue, '未发现集中问题') AS main_issue
FROM plan JOIN {o.DESCRIPTIONS} ON x.topic = plan.topic LEFT JOIN main_issues ON main_issues.topic = plan.topic"""
on_audit("topic_plan", reports.topic_plan, _PLAN_SQL, "plan")
on_audit(
    "situation",
    reports.topic_situation,
    f"SELECT topic, {o.SITUATION} AS situation FROM plan",
    "plan",
)
on_audit(
    "main_issue",
    reports.main_issue,
    "SELECT plan.topic, coalesce(main_issue, '未发现集中问题') AS main_issue FROM plan LEFT JOIN main_issues USING (topic)",
    "plan",
)

# --- report datasets -----------------------------------------------------------------

on_audit(
    "total_counts",
    reports.total_counts,
    "SELECT count(*) AS total_files, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes FROM records",
)
on_audit("category_counts", reports.category_counts, "SELECT category, count(*) AS n FROM records GROUP BY 1")
on_audit("type_counts", reports.type_counts, "SELECT display_type, count(*) AS n FROM records GROUP BY 1")
_METRICS_SQL = f"""SELECT CAST(ord AS INT) AS ord, metric, value, note FROM (
  SELECT 1 AS ord, '总文档数' AS metric, {o.commas('total')} || '份' AS value, '本次盘点的全部资料' AS note FROM facts
  UNION ALL SELECT 2, '总数据量', {o.size_text('bytes')}, '资料占用的本地空间' FROM facts
  UNION ALL SELECT 3, '可直接解析', {o.commas('direct')} || '份', '占全部资料的' || {o.percent('direct', 'total')} FROM facts
  UNION ALL SELECT 4, '需特殊处理', {o.commas('special')} || '份', '含扫描、加密、损坏或旧格式' FROM facts
  UNION ALL SELECT 5, '疑似重复文档', {o.commas('duplicates')} || '份', '涉及' || {o.commas('groups')} || '组重复或多版本资料' FROM facts
  UNION ALL SELECT 6, '暂无法解析', {o.commas('unavailable')} || '份', '占全部资料的' || {o.percent('unavailable', 'total')} FROM facts)"""
on_audit("key_metrics", reports.key_metrics, _METRICS_SQL, "facts")
on_audit("format_distribution", reports.format_distribution, "SELECT * FROM format_n", "distributions")
on_audit("length_distribution", reports.length_distribution, "SELECT * FROM length_n", "distributions")
_NOTE_SQL = f"""SELECT CASE WHEN scanned > 0 THEN '其中' || {o.commas('scanned')} || '份扫描版PDF共' || {o.commas('pages')}
    || '页，因没有可读取的文字层，单独列为“暂无法统计”，不计入500字以内。'
  WHEN uncounted > 0 THEN '有' || {o.commas('uncounted')} || '份资料暂时无法可靠统计字数，已单独列出。其余篇幅按工具能够读取到的文字统计。'
  ELSE '篇幅根据工具能够读取到的文字统计，仅用于了解资料的大致情况。' END AS note FROM (
  SELECT count(*) FILTER (starts_with(display_type, 'PDF') AND contains(parse_issue, '疑似扫描文件')) AS scanned,
    coalesce(sum(document_scale) FILTER (starts_with(display_type, 'PDF') AND contains(parse_issue, '疑似扫描文件')), 0) AS pages,
    count(*) FILTER (parse_status <> '可直接解析') AS uncounted FROM {{source}})"""
on_audit("length_note", reports.length_note, _NOTE_SQL.replace("{source}", "records"))


@query(
    "length_note_scanned",
    o.table_sql(
        "pages", _NOTE_SQL.replace("{source}", "(SELECT *, 'PDF' AS display_type FROM page_rules)"), ", " + _PAGE_RULES
    ),
)
def _(spark, folder):
    files = table(spark, folder, "pages").select(
        "doc_id", F.format_string("%d.pdf", "doc_id").alias("relative_path"), F.lit(1).alias("size_bytes"), F.lit(AS_OF).cast("timestamp").alias("modified_at")
    )
    kept = ("parse_status", "parse_issue", "document_scale")
    pages = elements.page_rules(table(spark, folder, "pages")).select("doc_id", *kept)
    records = inventory.record_projection(files.distinct()).drop(*kept).join(pages, "doc_id")
    keyed = records.withColumn("path_key", c("relative_path")).withColumn("name_key", c("file_name"))
    return reports.length_note(keyed)


on_audit(
    "status_distribution",
    reports.status_distribution,
    f"SELECT ord, label, n, {o.percent('n', '(SELECT count(*) FROM records)')} AS percent FROM status_n",
    "distributions",
)
_TOTAL = "(SELECT count(*) FROM records)"
on_audit(
    "chart_series",
    reports.chart_series,
    f"""SELECT chart, ord, label, n, {o.percent('n', _TOTAL)} AS percent, n / {_TOTAL} AS share,
      coalesce(sum(n) OVER (PARTITION BY chart ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {_TOTAL} AS "offset",
      NULL::DOUBLE AS of_max
    FROM (SELECT 'format' AS chart, * FROM format_n UNION ALL SELECT 'status', * FROM status_n)
    UNION ALL SELECT chart, ord, label, n, NULL, NULL, NULL, n / max(n) OVER (PARTITION BY chart)
    FROM (SELECT 'length' AS chart, * FROM length_n UNION ALL SELECT 'problem', ord, label, n FROM top_problems)""",
    "distributions",
    "problems",
)
on_audit("top_problems", reports.top_problems, "SELECT CAST(ord AS INT) AS ord, label, n, advice FROM top_problems", "problems")
_EXAMPLES_SQL = f"""SELECT label, CAST(rn AS INT) AS ord, relative_path, detail, greatest(n - 4, 0) AS remaining FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY pos) AS rn, count(*) OVER (PARTITION BY label) AS n
  FROM (SELECT *, {o.DETAIL} AS detail FROM problem_rows)) WHERE rn <= 4"""
on_audit("problem_examples", reports.problem_examples, _EXAMPLES_SQL, "problems")
_STATUS_EXAMPLES_SQL = f"""SELECT use_status, CAST(rn AS INT) AS ord, relative_path,
  detail || '，' || CASE use_status WHEN '整理后使用' THEN '需整理后再入库' ELSE '当前不建议入库' END || '。' AS detail, greatest(n - 3, 0) AS remaining FROM (
  SELECT *, row_number() OVER (PARTITION BY use_status ORDER BY pos) AS rn, count(*) OVER (PARTITION BY use_status) AS n
  FROM (SELECT *, {o.STATUS_DETAIL} AS detail FROM records WHERE use_status <> '可直接使用')) WHERE rn <= 3"""
on_audit("status_examples", reports.status_examples, _STATUS_EXAMPLES_SQL)
_CONCLUSIONS_SQL = f"""SELECT ord, paragraph FROM (
  SELECT 1 AS ord, '本次共检查' || {o.commas('total')} || '份资料，总数据量' || {o.size_text('bytes')} || '。' AS paragraph FROM facts
  UNION ALL SELECT 2, '从读取情况看：' || {o.commas('direct')} || '份可直接解析，' || {o.commas('special')} || '份需特殊处理，' ||
    {o.commas('duplicates')} || '份疑似重复，' || {o.commas('unavailable')} || '份暂时无法解析。' FROM facts
  UNION ALL SELECT 3, '从入库情况看：' || {o.commas('ready')} || '份（' || {o.percent('ready', 'total')} || '）未发现明显阻碍；' ||
    {o.commas('work')} || '份（' || {o.percent('work', 'total')} || '）需要先整理；' ||
    {o.commas('blocked')} || '份（' || {o.percent('blocked', 'total')} || '）不建议现在进入知识库。' FROM facts
  UNION ALL SELECT 4, '其中最需要处理的问题是：' || coalesce((SELECT string_agg(label || '（' || {o.commas('n')} || '份）', '、' ORDER BY ord)
    FROM top_problems WHERE ord <= 3), '未发现集中问题') || '。'
  UNION ALL SELECT 5, '建议规划知识库：' || coalesce((SELECT string_agg(topic, '、' ORDER BY document_count DESC, first) FROM plan
    WHERE topic <> '待确认资料'), '暂未形成明确建议') || '。')"""
on_audit("conclusions", reports.conclusions, _CONCLUSIONS_SQL, "facts", "problems", "plan")
_PRIORITY_SQL = f"""SELECT x.ord, x.label, count(doc_id) AS n, x.description FROM
  {o.values([(i, a, b) for i, (a, b) in enumerate(rp.PRIORITY_NOTES, 1)], 'ord, label, description')}
  LEFT JOIN records ON x.label = priority AND issues <> '' GROUP BY ALL"""
on_audit("priority_overview", reports.priority_overview, _PRIORITY_SQL)
_STANDARDS_SQL = f"""SELECT ord, s.label, n, {o.percent('n', _TOTAL)} AS percent, x.description FROM status_n s
  JOIN {o.values(list(rp.STATUS_STANDARDS), 'label, description')} ON x.label = s.label"""
on_audit("use_standards", reports.use_standards, _STANDARDS_SQL, "distributions")


def _json_counts(column: str) -> str:
    return (
        f"(SELECT '{{' || string_agg('\"' || k || '\":' || n, ',' ORDER BY k) || '}}' FROM "
        f"(SELECT {column} AS k, count(*) AS n FROM records GROUP BY 1))"
    )


@query(
    "run_summary",
    o.sql(
        "records",
        f"""SELECT total AS total_files, bytes AS total_size_bytes, {_json_counts('parse_status')} AS parse_counts,
          {_json_counts('use_status')} AS use_counts,
          (SELECT count(*) FROM supplier WHERE s_suppkey % 3 IN (0, 2)) AS skipped_system_files,
          (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 1) AS access_errors_count FROM facts""",
        "facts",
    ),
)
def _(spark, folder):
    manifest = corpus(spark, folder).unionByName(table(spark, folder, "refused"), allowMissingColumns=True)
    done = audit_manifest(manifest, AS_OF)
    summary = reports.run_summary(done.records, done.skipped, done.errors)
    for name in ("parse_counts", "use_counts"):
        summary = summary.withColumn(name, F.to_json(name))
    return summary


# --- sinks ---------------------------------------------------------------------------

_GUARD = "CASE WHEN {0}[1] IN ('=', '+', '-', '@') THEN '''' || {0} ELSE {0} END AS {0}"
on_audit(
    "rectification_list",
    reports.rectification_list,
    "SELECT "
    + ", ".join(_GUARD.format(x) for x in ("file_name", "relative_path", "issues", "recommendation"))
    + ", use_status, priority, suggested_knowledge_base FROM records WHERE issues <> ''",
)
on_audit(
    "inventory_list",
    lambda r: reports.inventory_list(r).withColumn("modified_at", stamp("modified_at")),
    "SELECT "
    + ", ".join(_GUARD.format(x) for x in ("file_name", "relative_path", "issues"))
    + f", display_type, size_bytes / 1048576.0::DOUBLE AS size_mb, {DUCK_STAMP}, use_status, suggested_knowledge_base FROM records",
)


def _section(name: str, sql: str, label: str, value: str, note: str, ord_: str = "ord") -> str:
    return f"SELECT '{name}' AS section, CAST({ord_} AS INT) AS ord, {label} AS label, CAST({value} AS VARCHAR) AS value, {note} AS note FROM ({sql})"


_REPORT_SQL = " UNION ALL ".join(
    [
        _section("conclusions", _CONCLUSIONS_SQL, "''", "paragraph", "''"),
        _section("key_metrics", _METRICS_SQL, "metric", "value", "note"),
        _section("format_distribution", "SELECT * FROM format_n", "label", "n", "''"),
        _section("length_distribution", "SELECT * FROM length_n", "label", "n", "''"),
        _section("length_note", _NOTE_SQL.replace("{source}", "records"), "''", "note", "''", "1"),
        _section("status_distribution", _STANDARDS_SQL, "label", "n", "description"),
        _section("status_examples", _STATUS_EXAMPLES_SQL, "use_status", "relative_path", "detail"),
        _section("top_problems", "SELECT * FROM top_problems", "label", "n", "advice"),
        _section("problem_examples", _EXAMPLES_SQL, "label", "relative_path", "detail"),
        _section("topic_plan", _PLAN_SQL, "name", "document_count", "main_issue"),
        _section("priority_overview", _PRIORITY_SQL, "label", "n", "description"),
    ]
)
_REPORT_STAGES = ("facts", "problems", "plan", "distributions")
on_audit("report_datasets", reports.report_datasets, _REPORT_SQL, *_REPORT_STAGES)


@query(
    "write_outputs",
    o.sql(
        "records",
        f"""SELECT 'records' AS output, count(*) AS n FROM records UNION ALL SELECT 'inventory', count(*) FROM records
        UNION ALL SELECT 'rectification', count(*) FROM records WHERE issues <> '' UNION ALL SELECT 'summary', 1
        UNION ALL SELECT 'report', count(*) FROM ({_REPORT_SQL})""",
        *_REPORT_STAGES,
    ),
)
def _(spark, folder):
    done = audit(spark, folder)
    target = f"{scratch_root(spark)}/corpuscope/outputs-{uuid.uuid4().hex}"
    rows = write_outputs(done, target, folder)
    return spark.createDataFrame(sorted(rows.items()), "output string, n long")


@query(
    "verify_outputs",
    """SELECT x.ord, x.copy, n - CAST(x.ord = 3 AS INT) AS n, x.verdict FROM (SELECT count(*) AS n FROM documents),
    (VALUES (1, 'same', 'kept'), (2, 'one value changed', 'values'), (3, 'one row missing', 'rows')) AS x(ord, copy, verdict)""",
)
def _(spark, folder):
    docs = read_table(spark, folder, "documents")
    last = docs.agg(F.max("doc_id")).scalar()
    base = f"{scratch_root(spark)}/corpuscope/verified-{uuid.uuid4().hex}"
    written = writer.write_staged(docs, f"{base}/same")
    copies = {
        "same": docs,
        "one value changed": docs.withColumn("text", F.when(c("doc_id") == last, F.concat("text", F.lit("."))).otherwise(c("text"))),
        "one row missing": docs.filter(c("doc_id") < last),
    }
    rows = []
    for number, (name, copy) in enumerate(copies.items(), 1):
        path = f"{base}/{name}"
        count = written.rows if name == "same" else writer.write_staged(copy, path).rows
        verdict = "kept"
        try:
            writer.verify_output(docs, path, written)
        except writer.OutputError as error:
            verdict = "rows" if "rows read back" in str(error) else "values"
        rows.append((number, name, count, verdict))
    return spark.createDataFrame(rows, "ord int, copy string, n long, verdict string")
