"""A training-data pipeline over ``documents``: five stages, each one operator.

toxicity and quality drop the documents their classifiers reject, the line stage removes
repeated lines (and documents of which nothing remains), the n-gram join keeps one document
of each group of near copies and then removes passages that the kept ones share, packing puts what is left into bins. Every stage's result is
written as parquet below ``spark.checkpoint.dir`` and read again as the next one's input, so
a lost executor costs at most one stage."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm import line_dedup, ngram_join, packing, quality, toxicity
from corpuscope.llm.queries import GOOD_FROM, TOXIC_FROM, held_out
from corpuscope.session import materialize, pin_session
from corpuscope.sources.tables import read_table

#: Near copies in the pipeline: five words, similarity 0.8 or more.
NEAR = ngram_join.Similarity(words=5, percent=80)

#: Passages of 50 words or more are repeated from two sources on. They are looked for after
#: the near copies have gone: before, copies would lose them and stay as unlike remainders.
PASSAGES = line_dedup.Spread(sites=2, least_words=50)

#: The columns of documents that the stages read.
READ = ("doc_id", "text", "source", "n_chars")

#: No table expresses the trained classifiers and the packing in SQL.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def own_columns(stage: Stage) -> Stage:
    """``stage`` with every column it does not read under a name that no operator uses, so
    that extra columns named like an operator's come back as they were given."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        given = docs.columns
        apart = [c if c in READ else f"_given_{i}" for i, c in enumerate(given)]
        return stage(spark, docs.toDF(*apart), sf_dir).toDF(*given)

    return run_stage


@own_columns
def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the threshold."""
    pin_session(spark)
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return toxicity.score(docs, model).filter(F.col("score") < TOXIC_FROM).select(*docs.columns)


@own_columns
def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score at or above the threshold."""
    pin_session(spark)
    model = quality.train(docs, read_table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return quality.score(docs, model).filter(F.col("score") >= GOOD_FROM).select(*docs.columns)


def without_repeats(docs: DataFrame, p: line_dedup.Spread) -> DataFrame:
    """``docs`` without repeated lines; one that had text and lost all of it goes."""
    cleaned = line_dedup.dedup_lines(docs, p)
    emptied = (F.col("removed_lines") > 0) & (F.trim("text", F.lit(line_dedup.BLANKS + "\n")) == "")
    kept = cleaned.filter(~emptied)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", changed)
    return kept.select(*docs.columns)


@own_columns
def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one that had text and lost all of it goes."""
    pin_session(spark)
    return without_repeats(docs, line_dedup.Spread())


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest id,
    null last; ties go to the smaller hash of the text.

    Rows are told apart by their id, or by a number if ids repeat or are null. Rows without
    words are no copies and stay."""
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    if ids.filter((F.col("rows") > 1) | F.col("doc_id").isNull()).isEmpty():
        found = ngram_join.ngram_components(docs.select("doc_id", "text"), NEAR)
        gone = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = ngram_join.ngram_components(rows.select(F.col("_row").alias("doc_id"), "text"), NEAR)
    found = found.select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("hash"), "_row")
    kept = found.join(rows.select("_row", order.alias("order")), "_row").groupBy("component_id")
    kept = kept.agg(F.min("order")["_row"].alias("_row"))
    return rows.join(kept.select("_row"), "_row", "left_semi").select(*docs.columns)


@own_columns
def stage_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id, and of these
    each shared passage once."""
    pin_session(spark)
    return without_repeats(one_of_each(docs), PASSAGES)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins for all that is left."""
    pin_session(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("quality", stage_quality),
    ("line_dedup", stage_lines),
    ("ngram_jaccard_join", stage_near_copies),
    ("best_fit_packing", stage_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the ``documents`` of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
