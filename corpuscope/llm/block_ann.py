"""Nearest neighbours by block matrix join.

Queries and candidates are dealt into blocks by a hash of their ids; every pair of blocks
is one tile. In a tile the int8 codes of both blocks are multiplied as matrices (in float,
where products of such codes are exact integers), which gives every cosine within a bound
computed from the lengths of the quantisation errors:

    |cos(q, v) - c| <= |e_q| + |e_v| * |q'|,    q = q' + e_q and v = v' + e_v of unit length.

A pair survives if its upper bound reaches the k-th largest lower bound of its query; the
survivors are computed anew from the original numbers in double precision, component by
component, and go through a heap of k per query and tile. The heaps of all tiles merge by
(score descending, id ascending).

Memory: a tile holds ``query_block`` x ``candidate_block`` rows in strips of 256 queries.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do rows with a null id; rows that repeat with the same id and vector
count once; vectors of different lengths are never compared; a query with fewer than k
candidates gets all of them, with none no row; ties go to the smaller id. Extra columns
are ignored."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


@dataclass(frozen=True)
class Blocks:
    query_block: int = 2_048
    candidate_block: int = 8_192
    strip: int = 256
    survivors: int = 1 << 16


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector array<double>, width) of the rows that take part, once each."""
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    return rows.distinct().withColumn("width", F.size("vector"))


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (integers within int8, as float32), scales, and the lengths of the decoded
    unit vectors and of their errors, the latter rounded up."""
    peak = np.abs(vectors).max(axis=1, keepdims=True)
    units = vectors / peak
    units /= np.sqrt((units * units).sum(axis=1, keepdims=True))
    scales = np.abs(units).max(axis=1, keepdims=True) / 127.0
    codes = np.rint(units / scales).astype(np.int8)
    decoded = codes * scales
    errors = np.sqrt(((units - decoded) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
    return codes, scales[:, 0], np.sqrt((decoded**2).sum(axis=1)), errors


def exact_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``a`` and ``b``, summed component by component in order."""
    dots, left, right = (np.zeros(len(a)) for _ in range(3))
    for d in range(a.shape[1]):
        x, y = a[:, d], b[:, d]
        dots += x * y
        left += x * x
        right += y * y
    with np.errstate(all="ignore"):
        cosines = dots / (np.sqrt(left) * np.sqrt(right))
    odd = np.flatnonzero(~np.isfinite(cosines) | (left * right < 1e-250))
    for i in odd:  # squares outside the range of doubles: scale each vector by its peak
        x, y = a[i] / np.abs(a[i]).max(), b[i] / np.abs(b[i]).max()
        cosines[i] = (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))
    return cosines


def tile_top(
    queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, p: Blocks
) -> Iterator[tuple[int, float, int]]:
    """(query id, score, row id) of the k best of the tile for every query."""
    q_codes, q_scales, q_lengths, q_errors = quantise(queries)
    codes, scales, _, errors = quantise(rows)
    kind = np.float32 if queries.shape[1] * 127 * 127 < 1 << 24 else np.float64
    codes = codes.astype(kind).T
    for at in range(0, len(queries), p.strip):
        strip = slice(at, at + p.strip)
        near = (q_codes[strip].astype(kind) @ codes).astype(np.float64)
        near *= q_scales[strip, None] * scales
        slack = q_errors[strip, None] + q_lengths[strip, None] * errors + 1e-9
        own = query_ids[strip, None] == row_ids
        low = np.where(own, -np.inf, near - slack)
        take = min(k, low.shape[1])
        bound = np.partition(low, low.shape[1] - take, axis=1)[:, low.shape[1] - take, None]
        left, right = np.nonzero((near + slack >= bound) & ~own)
        heaps: dict[int, list[tuple[float, int]]] = {}
        for part in range(0, len(left), p.survivors):
            i, j = at + left[part : part + p.survivors], right[part : part + p.survivors]
            scores = exact_cosines(queries[i], rows[j])
            order = np.lexsort((row_ids[j], -scores, i))
            i, ids, scores = i[order], row_ids[j][order], scores[order]
            start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            rank = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
            for n in np.flatnonzero(rank < k):
                heap = heaps.setdefault(int(i[n]), [])
                entry = (float(scores[n]), -int(ids[n]))
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                else:
                    heapq.heappushpop(heap, entry)
        for i, heap in heaps.items():
            for value, minus_id in heap:
                yield int(query_ids[i]), value, -minus_id


def nearest(vectors: DataFrame, is_query: Column, k: int, p: Blocks = Blocks()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of every query row."""
    usable = materialize(usable_vectors(vectors), "vectors")
    queries = usable.filter(is_query)
    candidate_blocks = -(-usable.count() // p.candidate_block) or 1
    query_blocks = -(-queries.count() // p.query_block) or 1
    tile = ["width", "query_block", "candidate_block"]

    def blocks(n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.withColumn("query_block", blocks(query_blocks)).withColumn("candidate_block", every(candidate_blocks))
    right = usable.withColumn("candidate_block", blocks(candidate_blocks)).withColumn("query_block", every(query_blocks))

    def multiply(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        found = ()
        if len(q) and len(v):
            found = tile_top(
                np.stack(q["vector"].to_numpy()), q["vec_id"].to_numpy(),
                np.stack(v["vector"].to_numpy()), v["vec_id"].to_numpy(), k, p,
            )
        return pd.DataFrame(list(found), columns=["query_id", "score", "vec_id"])

    tops = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInPandas(
        multiply, "query_id long, score double, vec_id long"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = tops.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
