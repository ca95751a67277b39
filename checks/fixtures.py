"""Document, page, cell, range and shape tables derived from the given tables.

The same text serves Spark and DuckDB. Every table holds all rows and the whole
texts of its source; what a rule needs to see is added to the texts, and short, empty
or blank cases are rows of their own, made from ``supplier``, ``nation`` and ``events``.
"""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.operators.assemble import Elements
from corpuscope.session import scratch_root
from corpuscope.sources.tables import read_table
from corpuscope.sources.tree import open_root

AS_OF = "2024-01-01 00:00:00"

CORPUS = """
SELECT d.doc_id, d.root_name, d.folder || '/' || d.file_name AS relative_path, d.file_name, d.extension,
       CAST(length(d.body) AS BIGINT) AS size_bytes,
       CAST(DATE '2024-01-01' - CAST((d.doc_id * 37) % 2600 AS INT) AS TIMESTAMP) AS modified_at,
       d.body AS text,
       {content}
FROM (
  SELECT doc_id, '公司资料' AS root_name, e.extension,
    CASE lang WHEN 'en' THEN '销售' WHEN 'fr' THEN '人资' WHEN 'de' THEN '财经' ELSE '待整理' END || '/' || source AS folder,
    CASE WHEN doc_id % 10 = 0 THEN '产品手册_v' || CAST(doc_id % 4 + 1 AS STRING)
         WHEN doc_id % 10 = 1 THEN '新建文档 (' || CAST(doc_id % 9 AS STRING) || ')'
         WHEN doc_id % 10 = 2 THEN '附件-' || e.slug
         WHEN doc_id % 10 = 3 THEN '备份-IT系统-' || e.slug
         ELSE 'memo-' || e.slug END || e.extension AS file_name,
    CASE WHEN lang = 'zh' THEN text
         WHEN doc_id % 20 = 7 THEN repeat('�', CAST(length(text) AS INT)) || text
         WHEN doc_id % 20 = 8 THEN repeat('�', CAST((length(text) - length(text) % 6) / 6 AS INT)) || text
         WHEN doc_id % 20 = 9 THEN text || ' 手机13800138000，备用13900139000 '
         WHEN doc_id % 20 = 10 THEN text || ' 身份证 11010519491231002X '
         WHEN doc_id % 20 = 11 THEN text || ' 银行卡号：4111 1111 1111 1111 。'
         WHEN doc_id % 20 = 12 THEN text || ' 邮箱 a.b@example.com, c@example.org. '
         WHEN doc_id % 20 = 13 THEN text || chr(10) || '密级：机密' || chr(10) || '禁止外传'
         WHEN doc_id % 20 = 14 THEN text || ' 月薪约8,000元；本合同总金额为人民币￥100,000元 '
         WHEN doc_id % 20 = 16 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')
         ELSE text END AS body
  FROM (SELECT *, translate(CAST(doc_id AS STRING), '0123456789', 'abcdefghij') AS slug,
          CASE CAST(doc_id AS INT) % 8 WHEN 0 THEN '.docx' WHEN 1 THEN '.pdf' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.pptx'
               WHEN 4 THEN '.txt' WHEN 5 THEN '.md' WHEN 6 THEN '.doc' ELSE '.csv' END AS extension
        FROM (
          SELECT doc_id, text, lang, source FROM {documents}
          UNION ALL
          SELECT 1000000000 + s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN '' WHEN 1 THEN '简短通知 ' || s_name
            WHEN 2 THEN repeat('会议纪要，', 8) || s_name WHEN 3 THEN repeat('会议纪要内容。', 20) || s_name
            ELSE '同一份制度正文，用于重复检测。员工考勤与休假管理办法，适用于全体员工。版本' || CAST(s_suppkey % 3 AS STRING) END,
            'zh', 'src' || CAST(s_nationkey AS STRING) FROM {supplier}) t) e
) d
"""

PAGES = """
SELECT conv_id AS doc_id, CAST(turn AS INT) AS page_no,
  text, (conv_id + turn) % 11 = 0 AS failed, conv_id % 13 = 0 AS encrypted FROM {conversations}
UNION ALL
SELECT 1000000000 + n_nationkey, 1, n_name, n_nationkey % 4 = 0, n_nationkey % 7 = 0 FROM {nation}
"""

CELLS = """
SELECT l_orderkey AS doc_id, l_linestatus AS sheet, CASE l_linestatus WHEN 'O' THEN 1 ELSE 2 END AS sheet_no,
  CAST(l_linenumber AS INT) AS row_no, 1 AS col_no,
  CASE WHEN l_linenumber = 1 AND l_orderkey % 3 = 0 THEN NULL ELSE l_returnflag END AS value,
  false AS is_formula
FROM {lineitem}
UNION ALL
SELECT l_orderkey, l_linestatus, CASE l_linestatus WHEN 'O' THEN 1 ELSE 2 END, CAST(l_linenumber AS INT), 2,
  CASE WHEN l_linenumber > 1 OR l_orderkey % 5 = 0 THEN
    CASE WHEN l_orderkey % 4 = 0 THEN '=SUM(A1)' ELSE l_returnflag END END,
  l_orderkey % 4 = 0 AND (l_linenumber > 1 OR l_orderkey % 5 = 0)
FROM {lineitem}
"""

MERGES = """
SELECT l_orderkey AS doc_id, l_linestatus AS sheet,
  'A' || CAST(l_linenumber * 2 AS STRING) || ':C' ||
  CAST(l_linenumber * 2 + CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END AS STRING) AS ref
FROM {lineitem}
"""

SHAPES = """
SELECT user_id AS doc_id, CAST(event_id % 12 AS INT) AS slide_no, event_id AS shape_no,
  CASE event_type WHEN 'view' THEN 'picture' WHEN 'error' THEN 'table' ELSE 'text' END AS kind,
  props AS text
FROM {events}
UNION ALL
SELECT user_id, CAST(event_id % 12 AS INT), 1000000000 + event_id, 'text', '　' || chr(10) || chr(9)
FROM {events} WHERE event_id % 3 > 0
"""

ELEMENTS = """
SELECT conv_id AS doc_id, CASE WHEN role = 'user' THEN 'paragraph' ELSE 'cell' END AS kind, turn AS pos, text
FROM {conversations}
"""

MANIFEST = """
SELECT event_id AS doc_id,
  CASE WHEN user_id % 11 = 0 THEN '__pycache__/' WHEN user_id % 7 = 0 THEN '.git/hooks/'
       WHEN user_id % 5 = 0 THEN 'Temp/$RECYCLE.BIN/' ELSE '' END ||
  event_type || '/' ||
  CASE WHEN event_id % 13 = 0 THEN '~$' WHEN event_id % 17 = 0 THEN '.' WHEN event_id % 19 = 0 THEN '.~lock.' ELSE '' END ||
  CASE WHEN event_id % 23 = 0 THEN 'Thumbs.db' ELSE 'file ' || CAST(user_id AS STRING) ||
    CASE CAST(event_id AS INT) % 16 WHEN 0 THEN '.DOCX' WHEN 1 THEN '.pdf' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.pptx'
      WHEN 4 THEN '.txt' WHEN 5 THEN '.md' WHEN 6 THEN '.Doc' WHEN 7 THEN '.xls' WHEN 8 THEN '.ppt'
      WHEN 9 THEN '.csv' WHEN 10 THEN '.rtf' WHEN 11 THEN '.odt' WHEN 12 THEN '.ods' WHEN 13 THEN '.odp'
      WHEN 14 THEN '' ELSE '.tar.gz' END END AS relative_path,
  CAST(round(value * 1000) AS BIGINT) AS size_bytes, ts AS modified_at
FROM {events}
"""

#: Files whose elements are the tables above, their ids told apart by a last digit.
OFFICE = """
SELECT doc_id, '公司资料' AS root_name, CASE doc_id % 3 WHEN 0 THEN '销售/' WHEN 1 THEN '人资/' ELSE '财经/' END ||
  'memo-' || translate(CAST(doc_id AS STRING), '0123456789', 'abcdefghij') || extension AS relative_path,
  'memo-' || translate(CAST(doc_id AS STRING), '0123456789', 'abcdefghij') || extension AS file_name, extension,
  1000 + doc_id AS size_bytes, CAST(DATE '2024-01-01' - CAST((doc_id * 37) % 2600 AS INT) AS TIMESTAMP) AS modified_at
FROM (
  SELECT DISTINCT CAST(conv_id AS BIGINT) * 10 + 1 AS doc_id, '.docx' AS extension FROM {conversations}
  UNION ALL SELECT DISTINCT CAST(conv_id AS BIGINT) * 10 + 2, '.pdf' FROM {conversations}
  UNION ALL SELECT CAST(1000000000 + n_nationkey AS BIGINT) * 10 + 2, '.pdf' FROM {nation}
  UNION ALL SELECT DISTINCT CAST(l_orderkey AS BIGINT) * 10 + 3, '.xlsx' FROM {lineitem}
  UNION ALL SELECT DISTINCT CAST(user_id AS BIGINT) * 10 + 4, '.pptx' FROM {events}
  UNION ALL SELECT CAST(s_suppkey AS BIGINT) * 10 + 5, CASE s_suppkey % 3 WHEN 0 THEN '.docx' WHEN 1 THEN '.doc' ELSE '.pptx' END
  FROM {supplier}) f
"""

#: Files of a tree written from the documents: some ignored, some in ignored folders.
TREE = """
SELECT source || '/' || CASE WHEN doc_id % 50 = 7 THEN '.git/' ELSE '' END || coalesce(lang, 'none') || '/' ||
  CASE WHEN doc_id % 50 = 8 THEN '~$' ELSE '' END || 'doc ' || CAST(doc_id AS STRING) ||
  CASE WHEN doc_id % 5 = 0 THEN '.md' WHEN doc_id % 5 = 1 THEN '.pdf' ELSE '.txt' END AS relative_path,
  coalesce(text, '') AS text
FROM {documents}
"""

#: Rows of a manifest that no audit takes: ignored, hidden, or not to be looked at.
REFUSED = """
SELECT 4000000000 + s_suppkey AS doc_id, CASE s_suppkey % 3
    WHEN 0 THEN 'sub' || CAST(s_suppkey AS STRING) || '/.git/hooks/pre.txt'
    WHEN 1 THEN 'locked/' || CAST(s_suppkey AS STRING) || '.pdf' ELSE 'hidden/' || CAST(s_suppkey AS STRING) || '.txt' END AS relative_path,
  s_suppkey % 3 = 2 AS is_hidden, CASE WHEN s_suppkey % 3 = 1 THEN 'Permission denied' END AS error
FROM {supplier}
"""

SPARK_CONTENT = "CAST(d.body AS BINARY) AS content"
DUCK_CONTENT = "encode(d.body) AS content"

_SOURCES = {
    "corpus": (CORPUS.replace("{content}", SPARK_CONTENT), ("documents", "supplier")),
    "pages": (PAGES, ("conversations", "nation")),
    "cells": (CELLS, ("lineitem",)),
    "merges": (MERGES, ("lineitem",)),
    "shapes": (SHAPES, ("events",)),
    "elements": (ELEMENTS, ("conversations",)),
    "manifest": (MANIFEST, ("events",)),
    "office": (OFFICE, ("conversations", "nation", "lineitem", "events", "supplier")),
    "tree": (TREE, ("documents",)),
    "refused": (REFUSED, ("supplier",)),
}


def office_elements(spark: SparkSession, folder: str) -> Elements:
    """The element tables under the ids of the files of ``office``."""

    def of(name: str, digit: int) -> DataFrame:
        rows = table(spark, folder, name)
        return rows.withColumn("doc_id", F.col("doc_id").cast("long") * 10 + digit)

    return Elements(
        texts=of("elements", 1), pages=of("pages", 2), cells=of("cells", 3), merges=of("merges", 3), shapes=of("shapes", 4)
    )


def write_tree(spark: SparkSession, folder: str) -> str:
    """Writes the files of ``tree`` below the scratch folder; returns their root."""
    root = f"{scratch_root(spark)}/corpuscope/tree-{uuid.uuid4().hex}"

    def write(batches):
        mount = open_root(root)
        for batch in batches:
            # One text at a time is a Python value; the others stay in the Arrow batch.
            for path, text in zip(batch.column("relative_path"), batch.column("text")):
                full = mount.full(path.as_py())
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "wb") as file:
                    file.write(text.as_buffer())
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})

    table(spark, folder, "tree").mapInArrow(write, "files long").agg(F.sum("files")).collect()
    return root


def dealt(df: DataFrame) -> DataFrame:
    """The rows over all cores: the given tables are files of one row group, which no
    scan can split as it splits a table of real size."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    query, sources = _SOURCES[name]
    return spark.sql(query, **{x: dealt(read_table(spark, folder, x)) for x in sources})


def duck_sql(name: str) -> str:
    query, sources = _SOURCES[name]
    query = query.replace(SPARK_CONTENT, DUCK_CONTENT)
    for source in sources:
        query = query.replace("{" + source + "}", source)
    return query.replace("AS STRING", "AS VARCHAR")
