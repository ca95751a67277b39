"""Joins and numbering that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

HOT_ROWS = 1_000_000


def split_join(
    rows: DataFrame, keys: DataFrame, on: list[str], size: str, how: str = "inner", hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Join ``rows`` to ``keys`` (unique on ``on``, ``size`` = rows per key).

    Keys with ``hot_rows`` rows or more number at most rows/hot_rows, so they
    are broadcast and their rows never shuffle; all other rows shuffle on the
    key, where no key can exceed ``hot_rows`` rows. ``how`` is inner or left. Without ``hot_rows``, no key is known to be hot."""
    if hot_rows is None:
        return rows.join(keys, on, how)
    extra = [c for c in keys.columns if c not in on]
    hot = keys.filter(F.col(size) >= hot_rows).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), on, "left")
    done = marked.filter(F.col("_hot")).drop("_hot")
    rest = marked.filter(F.col("_hot").isNull()).drop("_hot", *extra)
    cold = rest.join(keys.filter(F.col(size) < hot_rows), on, how)
    return done.unionByName(cold.select(*done.columns))


def number_rows(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name`` = 1, 2, 3 … over the whole table in ``order``.

    A range sort spreads the rows over the cluster; a row's number is its place
    within its partition plus the sizes of the partitions before it. Only that
    list of partition sizes passes through a single task."""
    placed = materialize(
        rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered"
    )
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = (
        F.sum("_n").over(
            Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        )
    )
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + within + 1)
        .drop("_part", "_before", "_id")
    )
