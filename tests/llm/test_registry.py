"""Registered queries against DuckDB, the pipeline end to end, and the optional import."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks import compare
from corpuscope.llm.queries import ORACLE, QUERIES
from corpuscope.session import materialize
from corpuscope.sources.tables import read_table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, name):
    verdict, *_ = compare.compare(spark, compare.duck(FOLDER), name, QUERIES[name], ORACLE[name], FOLDER)
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_covers_every_row(spark, name):
    table, key = ("pages", "page_id") if name.startswith("op6") else ("documents", "doc_id")
    rows = QUERIES[name](spark, FOLDER).select(key).distinct().count()
    assert rows == read_table(spark, FOLDER, table).select(key).distinct().count()


def test_pipeline(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "line_dedup", "ngram_jaccard_join", "best_fit_packing"]
    docs = read_table(spark, FOLDER, "documents")
    columns, ids = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, FOLDER), name)
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert docs.columns == columns or name == names[-1]
    assert ids[0] >= ids[1] >= ids[2] > ids[3] == ids[4]
    whole = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in whole.select("doc_id").collect()} == ids[4]


def test_stages_take_empty_tables_and_nulls(spark):
    docs = read_table(spark, FOLDER, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "", "", "", 0)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
        assert stage(spark, odd, FOLDER).count() == 3


def test_stages_give_extra_columns_back(spark):
    docs = read_table(spark, FOLDER, "documents").limit(60)
    extra = ["score", "label", "lines", "removed_lines", "removed", "_parts", "_bounds", "_row", "Score_2"]
    docs = materialize(docs.select("*", *[F.concat(F.lit(c), "doc_id").alias(c) for c in extra]), "extra")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, FOLDER)
        assert got.columns == docs.columns
        for r in got.collect():
            assert [r[c] for c in extra] == [f"{c}{r.doc_id}" for c in extra], name


def test_entry_works_without_this_folder():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('corpuscope.llm', 'corpus_pipeline'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries()) and len(e.queries()) > 90\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    top = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=top, check=True, timeout=300)
