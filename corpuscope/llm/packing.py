"""Best-fit packing of documents into bins of equal token capacity, under conflicts.

No bin holds two documents of one source, nor two of one duplicate cluster. Within a group
of about ``Packing.group_rows`` documents, items are placed largest first. Open bins are
kept ordered by residual; the search starts at the smallest residual that holds the item
and goes on to its successors until a bin's source and cluster bitmaps admit it, which is
the tightest compatible bin; only if there is none does a new bin open. Residuals are grouped
by the bitmap of their sources, so a run of bins that all refuse a source is passed in one step.

Groups come from a hash of the id, so a hot source or cluster is spread over all of them
and a group's memory is bounded; each group packs on its own, and bins are numbered per
group. A document above the capacity is cut into whole-capacity pieces, each a bin of its
own, and a rest that is packed like any other item: nothing is dropped.

Defined results: tokens are the words of the text (anything but space and U+0009 to
U+000D); null or empty text has none and still gets a place; a null source is a source;
rows with null ids are packed like others; equal rows are separate items; ties go to the
smaller id, then the smaller piece. Of extra columns none is carried."""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact_dedup import normalise


@dataclass(frozen=True)
class Packing:
    capacity: int = 2_048
    group_rows: int = 8_192


class Bins:
    """Open bins by residual, then by source bitmap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residuals: list[int] = []
        self.at: dict[int, dict[int, list[int]]] = {}
        self.clusters: list[int] = []
        self.used: list[int] = []

    def _put(self, residual: int, sources: int, number: int) -> None:
        held = self.at.get(residual)
        if held is None:
            held = self.at[residual] = {}
            insort(self.residuals, residual)
        held.setdefault(sources, []).append(number)

    def _take(self, residual: int, sources: int, place: int) -> None:
        held = self.at[residual]
        held[sources].pop(place)
        if not held[sources]:
            del held[sources]
            if not held:
                del self.at[residual]
                self.residuals.pop(bisect_left(self.residuals, residual))

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset in it) of an item with one-bit masks of its source and cluster."""
        for residual in self.residuals[bisect_left(self.residuals, size) :]:
            for sources, numbers in self.at[residual].items():
                if sources & source:
                    continue
                for place, number in enumerate(numbers):
                    if not self.clusters[number] & cluster:
                        self._take(residual, sources, place)
                        self._put(residual - size, sources | source, number)
                        self.clusters[number] |= cluster
                        self.used[number] += 1
                        return number, self.capacity - residual
        number = len(self.clusters)
        self.clusters.append(cluster)
        self.used.append(1)
        self._put(self.capacity - size, source, number)
        return number, 0


def one_bit(values: pd.Series, shared_only: bool) -> list[int]:
    """A bit per distinct value; with ``shared_only`` none for values that occur once."""
    codes, _ = pd.factorize(values, use_na_sentinel=False)
    if shared_only:
        counts = np.bincount(codes, minlength=1)
        again = np.cumsum(counts > 1) - 1
        return [1 << int(again[c]) if counts[c] > 1 else 0 for c in codes]
    return [1 << int(c) for c in codes]


def pack_group(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bins of one group: a row per piece."""
    rows = rows.sort_values(["doc_id", "cluster", "tokens"], kind="stable", na_position="first").reset_index(drop=True)
    sources, clusters = one_bit(rows["source"], False), one_bit(rows["cluster"], True)
    items = []  # (rest first by size, document, piece, size)
    for at, tokens in enumerate(rows["tokens"].tolist()):
        whole, rest = divmod(tokens, capacity)
        items += [(at, piece, capacity) for piece in range(whole)]
        if rest or not whole:
            items.append((at, whole, rest))
    items.sort(key=lambda x: (-x[2], x[0], x[1]))
    bins = Bins(capacity)
    placed = [(*x, *bins.place(x[2], sources[x[0]], clusters[x[0]])) for x in items]
    at, piece, size, number, offset = np.array(placed, dtype=np.int64).reshape(-1, 5).T
    fill = np.bincount(number, weights=size, minlength=1).astype(np.int64)
    group = int(rows["pack_group"].iloc[0])
    return pd.DataFrame(
        {
            "doc_id": rows["doc_id"].to_numpy()[at],
            "piece": piece,
            "start": piece * capacity,
            "tokens": size,
            "bin_id": (group << 32) + number,
            "bin_offset": offset,
            "bin_fill": fill[number],
        }
    ).astype({"doc_id": "Int64"})


def word_count(text: Column) -> Column:
    """Words as runs of bytes other than white space: word starts, counted in the JVM."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def pack(docs: DataFrame, cluster: Column | None = None, p: Packing = Packing()) -> DataFrame:
    """doc_id, piece, start, tokens, bin_id, bin_offset, bin_fill for every piece of every row.

    ``docs`` has doc_id, text, source; ``cluster`` names the duplicates that must not meet
    (by default equal texts, letters A-Z compared without case)."""
    cluster = F.xxhash64(normalise(F.col("text"))) if cluster is None else cluster
    groups = max(1, -(-docs.count() // p.group_rows))
    items = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        cluster.alias("cluster"),
        word_count(F.col("text")).alias("tokens"),
        F.pmod(F.xxhash64(F.lit("pack"), "doc_id"), F.lit(groups)).alias("pack_group"),
    )
    capacity = p.capacity

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        return pack_group(rows, capacity)

    schema = "doc_id long, piece long, start long, tokens long, bin_id long, bin_offset long, bin_fill long"
    return items.groupBy("pack_group").applyInPandas(packed, schema)
