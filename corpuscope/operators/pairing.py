"""Keyed pairing of two per-document tables that must describe the same documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_rows(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """Inner join on ``key``; the job fails unless both sides hold each key once."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    uneven = (
        sides.groupBy(key)
        .agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
        .filter((F.col("l") != 1) | (F.col("r") != 1))
        .agg(F.count(F.lit(1)))
        .scalar()
    )
    checked = F.when(uneven == 0, F.lit(True)).otherwise(
        F.raise_error(F.lit("the two tables do not describe the same documents")).cast("boolean")
    )
    return left.join(right, key).filter(checked)
