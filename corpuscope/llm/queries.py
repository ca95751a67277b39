"""Registered queries of the operators of this folder, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import pin_session
from ..sources.tables import read_table
from . import (
    block_ann,
    bpe,
    decontamination,
    exact_dedup,
    line_dedup,
    lloyd,
    ngram_join,
    oracles,
    packing,
    period_runs,
    quality,
    sharding,
    toxicity,
    url_rules,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

SHARDS = 40
TOXIC_FROM = 0.7
GOOD_FROM = 0.5
SITE_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
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


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier may learn from: crc32 of the id's digits mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_exact_dedup", oracles.EXACT_DEDUP)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return exact_dedup.exact_groups(docs)


@query("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    labels = read_table(spark, folder, "labels")
    model = toxicity.train(docs, labels, ~held_out(F.col("doc_id")))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


@query("op3_ngram_join", oracles.NGRAM_JOIN)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_components(read_table(spark, folder, "documents").select("doc_id", "text"))


@query("op4_hash_tree")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    tree = sharding.even_tree(SHARDS)
    return sharding.assign_shards(docs, tree, tree.grown("region3", "rack19", (SHARDS, 1.0)))


@query("op5_block_join", oracles.BLOCK_JOIN)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_table(spark, folder, "embeddings").select("vec_id", "embedding")
    return block_ann.nearest(vectors, F.col("vec_id") % 50 == 0, 5)


@query("op6_url_rules")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages").select("page_id", "url")
    # The number in a page's path is the id of the document, and so of the label.
    key = url_rules.path_number(F.col("url"))
    return url_rules.judge_urls(pages, read_table(spark, folder, "labels"), SITE_RULES, label_key=key)


@query("op7_best_fit")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read_table(spark, folder, "documents").select("doc_id", "text", "source"))


@query("op8_bpe")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    encoded = bpe.encode_texts(docs, bpe.load_vocabulary(vocabulary_path()), decode=True)
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        digest(F.col("ids")).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"),
    )


@query("op9_line_spread", oracles.LINE_SPREAD)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text", "source")
    return line_dedup.dedup_lines(docs).select("doc_id", "lines", "removed_lines", "text")


@query("op10_quality")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    labels = read_table(spark, folder, "labels")
    model = quality.train(docs, labels, ~held_out(F.col("doc_id")))
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"),
    )


@query("op11_suffix_automaton", oracles.DECONTAMINATION)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(docs, read_table(spark, folder, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        digest(F.array_join(names, ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op12_period_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    found = period_runs.find_runs(period_runs.planted(docs))
    found = found.select("doc_id", "runs", "collapsed", period_runs.strongest(F.col("runs")).alias("best"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        digest(period_runs.run_lines(F.col("runs"))).alias("runs_sha256"),
        digest(F.coalesce("collapsed", F.lit(""))).alias("collapsed_sha256"),
    )


@query("op13_sharded_lloyd", oracles.lloyd(clusters=40, rounds=5))
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return lloyd.cluster_vectors(read_table(spark, folder, "embeddings").select("vec_id", "embedding"))
