"""Line deduplication by distinct-site spread.

A line's spread is the number of distinct sites (sources) it occurs on. Every line hash
gets a HyperLogLog sketch of its sites, combined on the map side and merged by
aggregation, so a hot line is one row per partition. Lines whose estimate is far above or
below ``Spread.sites`` are decided by it; for those near the threshold, within the factor
``Spread.margin``, the distinct sites are counted exactly. Lines that reach the threshold
are boilerplate: each stays in the document with the smallest id that holds it, at its
first place there, and is removed everywhere else. With ``Spread.least_words`` shorter lines are
neither counted nor removed. A line that repeats within one site has spread 1 and stays.

Lines are the parts between line feeds, compared without blanks around them. Only their
hashes are shuffled (two independent 64-bit hashes, so that texts sharing a billion lines
do not collide); the text moves once, to meet the list of its removed lines.

Defined results: null text counts as empty and stays null; blank lines are neither counted
nor removed; a null source is no site; rows with a null id keep all their lines and
count; rows that share an id are cleaned alike; rows repeat in the output as in the input.
Extra columns are carried along unless they bear the name of a result column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, materialize


@dataclass(frozen=True)
class Spread:
    sites: int = 4
    margin: float = 2.0
    #: 2^10 registers at most: a standard error of 3 %; up to some dozen sites a sketch is a list.
    log2_registers: int = 10
    least_words: int = 1


BLANKS = " \t\r\x0b\x0c"
#: What ends a word, as in ``packing.word_count``; lines begin with a word.
WHITE = BLANKS + "\n"
RESULT = ("lines", "removed_lines", "removed")


def lines_of(docs: DataFrame, p: Spread = Spread()) -> DataFrame:
    """(doc_id, source, n, a, b): the place and hashes of every line that is not blank and
    has ``p.least_words`` words."""
    rows = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    rows = rows.withColumn("line", F.trim("line", F.lit(BLANKS))).filter(F.col("line") != "")
    if p.least_words > 1:
        # Words are counted only in lines with enough bytes for them and the blanks between, and
        # not beyond ``least_words``.
        roomy = F.octet_length("line") >= 2 * p.least_words - 1
        wordy = F.col("line").rlike(f"^(?:[^{WHITE}]++[{WHITE}]*+){{{p.least_words}}}")
        rows = rows.filter(F.when(roomy, wordy).otherwise(False))
    hashes = F.xxhash64("line").alias("a"), F.xxhash64(F.lit("line"), "line").alias("b")
    return rows.select("doc_id", "source", "n", *hashes)


def boilerplate(lines: DataFrame, p: Spread = Spread()) -> DataFrame:
    """(a, b, sites) of the lines that occur on at least ``p.sites`` distinct sites."""
    sketch = F.hll_sketch_agg("source", p.log2_registers).alias("sketch")
    known = lines.filter(F.col("source").isNotNull()).groupBy("a", "b")
    if 1 < p.sites <= p.margin:
        # Every line is near so low a threshold; nearly all have one site, which both ends tell.
        sketches = known.agg(sketch, F.min("source").alias("low"), F.max("source").alias("high")).filter("low < high")
    else:
        sketches = known.agg(sketch)
    spread = sketches.select("a", "b", F.hll_sketch_estimate("sketch").alias("sites"))
    likely = materialize(spread.filter(F.col("sites") >= p.sites / p.margin), "spread")
    sure = likely.filter(F.col("sites") >= p.sites * p.margin)
    near = likely.filter(F.col("sites") < p.sites * p.margin).select("a", "b")
    exact = (
        lines.select("a", "b", "source")
        .filter(F.col("source").isNotNull())
        .join(near, ["a", "b"], "left_semi")
        .distinct()
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("sites"))
    )
    return sure.unionByName(exact.filter(F.col("sites") >= p.sites))


def removed_places(docs: DataFrame, p: Spread) -> DataFrame:
    """(doc_id, removed): the sorted places of the lines each document loses."""
    lines = materialize(lines_of(docs, p), "lines")
    spread = materialize(boilerplate(lines, p), "boilerplate").select("a", "b")
    hits = lines.filter(F.col("doc_id").isNotNull()).join(spread, ["a", "b"])
    hits = materialize(hits.select("a", "b", "doc_id", "n"), "hits")
    first = hits.groupBy("a", "b").agg(F.min("doc_id").alias("keeper"))
    marked = hits.join(materialize(first, "keepers"), ["a", "b"])
    # In the keeping document the first place stays; that minimum needs its own lines only.
    kept = (
        marked.filter(F.col("doc_id") == F.col("keeper")).groupBy("a", "b").agg(F.min("n").alias("first_n"))
    )
    return (
        marked.join(kept, ["a", "b"])
        .filter((F.col("doc_id") != F.col("keeper")) | (F.col("n") != F.col("first_n")))
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_set("n")).alias("removed"))
    )


def dedup_lines(docs: DataFrame, p: Spread = Spread()) -> DataFrame:
    """``docs`` with cleaned text, plus lines, removed_lines and removed (their places)."""
    docs = docs.drop(*RESULT)
    with Scratch(docs.sparkSession) as scratch:
        gone = removed_places(docs, p)
    gone = materialize(gone, "removed")
    scratch.drop()
    # The text travels as its lines, which the cut below then reads in one pass.
    parted = docs.select(
        *[F.split("text", "\n", -1).alias("_parts") if c == "text" else F.col(c) for c in docs.columns]
    )
    # The same join at every size: what loses lines grows with the input and is never broadcast.
    found = parted.join(gone.hint("merge"), "doc_id", "left")
    size, removed = F.coalesce(F.size("_parts"), F.lit(0)), F.coalesce("removed", F.array().cast("array<int>"))
    found = found.withColumns({"lines": F.greatest(size, F.lit(0)), "removed_lines": F.size(removed), "removed": removed})
    bounds = F.concat(F.array(F.lit(-1)), "removed", F.array("lines"))
    found = found.withColumn("_bounds", bounds)
    runs = F.transform(
        F.sequence(F.lit(1), F.col("removed_lines") + 1),
        lambda i: F.slice(
            "_parts",
            F.element_at("_bounds", i) + 2,
            F.element_at("_bounds", i + 1) - F.element_at("_bounds", i) - 1,
        ),
    )
    cleaned = F.array_join(F.when(F.col("removed_lines") == 0, F.col("_parts")).otherwise(F.flatten(runs)), "\n")
    return found.select(
        *[cleaned.alias("text") if c == "text" else F.col(c) for c in docs.columns],
        *RESULT,
    )
