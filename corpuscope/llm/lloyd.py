"""Centroid clustering by Lloyd's rounds, sharded by dimension.

Vectors of whole numbers are cut into chunks of rows and blocks of columns, one table row per
chunk and block. In every round

1. a task of a column block computes the exact squared distances of its part of the vectors
   to its slice of the centroids, which is all of the centroids it sees;
2. the partial distances meet by chunk, where the blocks are added and the nearest centroid
   is taken;
3. the assignments go back to the column blocks: each adds up its own columns per centroid,
   within a task first, and its slice of the centroids becomes the exact floor of sum / count.

Centroids are a table (cluster, dim, value); a block's slice of it, ``clusters`` times
``block_columns`` numbers, is what a round broadcasts. Shuffled are the partial distances, in
the smallest integers that hold them, and the chunks of the columns once per round; no hot
vector or cluster gathers anywhere, since chunks are cut from the rows as they lie and sums
combine before the shuffle. Every round is written to the scratch area.

A column block of ``w`` columns is exact as long as its numbers stay below 2^(53 - log2 w) when
squared; larger ones take an integer path. Numbers beyond ``LARGEST`` count as it, so that a
distance always fits a long.

Defined results: vectors that are null, of another length or hold null or non-finite components
take no part and give no row; rows that repeat are vectors of their own; a null id takes part,
but as a start only after all others; equal hashes go by the vector; with fewer vectors than
clusters each is a centroid; with none there are no rows; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch, materialize

#: 64 columns of differences of twice this size, squared, still fit a long.
LARGEST = 1 << 27


@dataclass(frozen=True)
class Lloyd:
    clusters: int = 40
    rounds: int = 5
    dimensions: int = 64
    block_columns: int = 32
    chunk_rows: int = 2_048
    #: Every component x becomes floor(x * scale).
    scale: int = 256
    salt: str = "2:"


def packed(numbers: np.ndarray) -> bytes:
    """The array in the smallest of three integer types; its size tells which."""
    peak = max(int(numbers.max(initial=0)), -int(numbers.min(initial=0)))
    kind = next(k for k in (np.int16, np.int32, np.int64) if peak <= np.iinfo(k).max)
    return numbers.astype(kind).tobytes()


def unpacked(data: bytes, rows: int, columns: int) -> np.ndarray:
    kind = np.dtype(f"i{len(data) // (rows * columns)}")
    return np.frombuffer(data, dtype=kind).reshape(rows, columns).astype(np.int64)


def whole_numbers(vectors: DataFrame, p: Lloyd) -> DataFrame:
    """(vec_id, vector array<long>) of the rows that take part."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter((F.size("vector") == p.dimensions) & finite)

    def whole(x: Column) -> Column:
        scaled = F.greatest(F.least(x * p.scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
        return F.floor(scaled)

    return rows.select("vec_id", F.transform("vector", whole).alias("vector"))


def starts(vectors: DataFrame, p: Lloyd) -> DataFrame:
    """(cluster, dim, value) of the vectors with the smallest hashes of their ids."""
    hashed = vectors.select(
        F.sha2(F.concat(F.lit(p.salt), F.col("vec_id").cast("string")), 256).alias("hash"), "vector"
    )
    first = hashed.orderBy(F.asc_nulls_last("hash"), "vector").limit(p.clusters)
    listed = first.agg(F.array_sort(F.collect_list(F.struct(F.col("hash").isNull().alias("last"), "hash", "vector"))).alias("all"))
    numbered = listed.select(F.posexplode("all").alias("cluster", "row"))
    return numbered.select("cluster", F.posexplode("row.vector").alias("dim", "value"))


def column_blocks(vectors: DataFrame, p: Lloyd) -> DataFrame:
    """(chunk, block, rows, data, ids): chunks of rows cut into blocks of columns. Block -1
    holds the ids of a chunk and no numbers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number = 0
        for batch in batches:
            for first in range(0, batch.num_rows, p.chunk_rows):
                part = batch.slice(first, p.chunk_rows)
                rows = part.num_rows
                flat = part.column("vector").flatten().to_numpy(zero_copy_only=False)
                matrix = flat.reshape(rows, p.dimensions)
                slices = [matrix[:, at : at + p.block_columns] for at in range(0, p.dimensions, p.block_columns)]
                size = len(slices) + 1
                ids = [part.column("vec_id").to_pylist()] + [None] * len(slices)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([task << 32 | number] * size, pa.int64()),
                        pa.array(range(-1, size - 1), pa.int32()),
                        pa.array([rows] * size, pa.int32()),
                        pa.array([None, *(packed(s) for s in slices)], pa.binary()),
                        pa.array(ids, pa.list_(pa.int64())),
                    ],
                    ["chunk", "block", "rows", "data", "ids"],
                )
                number += 1

    schema = "chunk long, block int, rows int, data binary, ids array<long>"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").mapInArrow(cut, schema)


def partial_distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids over the columns given."""
    peak = max(np.abs(rows).max(initial=0), np.abs(centroids).max(initial=0))
    if float(peak) ** 2 * 4 * rows.shape[1] < 1 << 53:  # every sum is a whole number that a double holds
        x, c = rows.astype(np.float64), centroids.astype(np.float64)
        near = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
        return near.astype(np.int64)
    near = np.zeros((len(rows), len(centroids)), dtype=np.int64)
    for column in range(rows.shape[1]):
        near += (rows[:, column, None] - centroids[None, :, column]) ** 2
    return near


def slices_of(centroids: DataFrame, p: Lloyd) -> DataFrame:
    """(block, slice): the numbers of a column block, cluster after cluster."""
    block = F.floor(F.col("dim") / p.block_columns).cast("int").alias("block")
    grouped = centroids.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("cluster", "dim", "value"))).alias("all"))
    return grouped.select("block", F.transform("all", lambda x: x["value"]).alias("slice"))


def columns_of(block: int, p: Lloyd) -> int:
    return min(p.block_columns, p.dimensions - block * p.block_columns)


def assign(blocks: DataFrame, centroids: DataFrame, p: Lloyd) -> DataFrame:
    """(chunk, clusters, distances): the nearest centroid of every row of a chunk."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for block, rows, data, numbers in zip(
                batch.column("block").to_pylist(), batch.column("rows").to_pylist(), batch.column("data"), batch.column("slice")
            ):
                width = columns_of(block, p)
                centers = numbers.values.to_numpy(zero_copy_only=False).reshape(-1, width)
                near.append(packed(partial_distances(unpacked(data.as_buffer(), rows, width), centers)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk"), batch.column("rows"), pa.array(near, pa.binary())], ["chunk", "rows", "near"]
            )

    def nearest(parts: pd.DataFrame) -> pd.DataFrame:
        rows = int(parts["rows"].iloc[0])
        total = None
        for data in parts["near"]:
            near = unpacked(data, rows, clusters)
            total = near if total is None else total + near
        best = total.argmin(axis=1)  # the first of equal ones
        distances = total[np.arange(rows), best].astype(np.int64)
        return pd.DataFrame(
            {"chunk": parts["chunk"].iloc[:1], "clusters": [best.astype(np.int32).tobytes()], "distances": [distances.tobytes()]}
        )

    clusters = centroids.agg(F.max("cluster")).first()[0] + 1
    parted = blocks.filter("block >= 0").join(F.broadcast(slices_of(centroids, p)), "block")
    parted = parted.select("chunk", "block", "rows", "data", "slice").mapInArrow(measure, "chunk long, rows int, near binary")
    return parted.groupBy("chunk").applyInPandas(nearest, "chunk long, clusters binary, distances binary")


def moved(blocks: DataFrame, assigned: DataFrame, centroids: DataFrame, p: Lloyd) -> DataFrame:
    """The centroids with every column block's slice brought to the floor of the means."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, rows, data, found in zip(
                batch.column("block").to_pylist(), batch.column("rows").to_pylist(), batch.column("data"), batch.column("clusters")
            ):
                width = columns_of(block, p)
                numbers = unpacked(data.as_buffer(), rows, width)
                cluster = np.frombuffer(found.as_buffer(), dtype=np.int32)
                if block not in sums:
                    sums[block] = np.zeros((p.clusters, width), dtype=np.int64)
                    counts[block] = np.zeros(p.clusters, dtype=np.int64)
                np.add.at(sums[block], cluster, numbers)
                counts[block] += np.bincount(cluster, minlength=p.clusters)
        for block, total in sums.items():
            cluster, column = np.indices(total.shape).reshape(2, -1)
            arrays = cluster, column + block * p.block_columns, total.ravel(), counts[block][cluster]
            types = pa.int32(), pa.int32(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, t) for a, t in zip(arrays, types)], ["cluster", "dim", "total", "n"]
            )

    parts = blocks.filter("block >= 0").join(assigned.select("chunk", "clusters"), "chunk")
    parts = parts.select("block", "rows", "data", "clusters").mapInArrow(add, "cluster int, dim int, total long, n long")
    sums = parts.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).filter("n > 0")
    mean = F.expr("(total - pmod(total, n)) div n")  # exact: the floor in whole numbers
    found = centroids.join(F.broadcast(sums), ["cluster", "dim"], "left")
    return found.select("cluster", "dim", F.coalesce(mean, "value").alias("value"))


def rows_of(blocks: DataFrame, assigned: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, clusters, distances in zip(batch.column("ids"), batch.column("clusters"), batch.column("distances")):
                arrays = (
                    ids.values,
                    pa.array(np.frombuffer(clusters.as_buffer(), dtype=np.int32)),
                    pa.array(np.frombuffer(distances.as_buffer(), dtype=np.int64)),
                )
                yield pa.RecordBatch.from_arrays(list(arrays), ["vec_id", "cluster", "distance"])

    named = blocks.filter("block = -1").select("chunk", "ids").join(assigned, "chunk")
    return named.select("ids", "clusters", "distances").mapInArrow(spread, "vec_id long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, p: Lloyd = Lloyd()) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of
    every vector that takes part."""
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    scratch = Scratch(vectors.sparkSession)
    try:
        with scratch:
            usable = whole_numbers(vectors, p)
            blocks = materialize(column_blocks(usable, p), "blocks")
            centroids = materialize(starts(usable, p), "centroids")
            if centroids.isEmpty():
                return vectors.sparkSession.createDataFrame([], result)
            for _ in range(p.rounds):
                assigned = materialize(assign(blocks, centroids, p), "assigned")
                centroids = materialize(moved(blocks, assigned, centroids, p), "centroids")
            assigned = materialize(assign(blocks, centroids, p), "assigned")
            rows = rows_of(blocks, assigned)
            digest = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]), ",")
            digests = centroids.groupBy("cluster").agg(F.sha2(digest, 256).alias("centroid_sha256"))
            facts = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
            facts = materialize(facts, "inertia").join(digests, "cluster")
            # One row per cluster: their sum is a window over at most ``p.clusters`` rows.
            whole = F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0)))
            found = rows.join(F.broadcast(facts.withColumn("inertia", whole)), "cluster")
        return materialize(found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), "clusters")
    finally:
        scratch.drop()
