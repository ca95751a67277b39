"""Exact deduplication by counting quotient filters (Pandey et al., "A General-Purpose
Counting Filter", 2017).

1. A narrow pass writes (row columns, 64-bit fingerprint, SHA-256) of every normalised text.
2. Every partition builds a counting quotient filter of its fingerprints: the high bits
   (quotient) choose a run, the low bits (remainder) are kept in it in sorted order with a
   count. Quotient and remainder together are the whole fingerprint, so nothing is lost.
3. The filters are cut at the same quotients and merged range by range, run by run, by
   sorted remainders; counts add up. A hot text is one entry per partition with a count.
4. Rows whose fingerprint has a count above one go to byte verification: their texts are
   grouped by the bytes themselves, combined before the shuffle, so fingerprints that
   collide separate again.

Defined results: null text counts as empty; empty texts equal one another; of equal texts
the row with the largest id stays, null ids being smaller than any other; rows that repeat
with the same id and text are all returned and all marked as kept; a group of null ids
alone has a null ``keep_id``. Extra columns are carried along unless they bear the name
of a result column, which then replaces them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = ("keep_id", "group_size", "kept", "text_sha256")
#: Fingerprints that one merge holds, in memory, on average: 24 bytes each.
RANGE_ROWS = 1_000_000
LEAST_RANGES = 64


def normalise(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


class CountingQuotientFilter:
    """Sorted runs of remainders with counts, one run per quotient."""

    def __init__(self, quotients: np.ndarray, remainders: np.ndarray, counts: np.ndarray, bits: int):
        self.quotients, self.remainders, self.counts, self.bits = quotients, remainders, counts, bits

    @classmethod
    def build(cls, fingerprints: np.ndarray, bits: int) -> CountingQuotientFilter:
        values, counts = np.unique(fingerprints.view(np.uint64), return_counts=True)
        shift = np.uint64(64 - bits)
        return cls(values >> shift, values & ((np.uint64(1) << shift) - np.uint64(1)), counts.astype(np.int64), bits)

    @classmethod
    def merge(cls, parts: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        quotients, remainders, counts = (
            np.concatenate([getattr(x, name) for x in parts]) for name in ("quotients", "remainders", "counts")
        )
        order = np.lexsort((remainders, quotients))
        quotients, remainders, counts = quotients[order], remainders[order], counts[order]
        first = np.ones(len(order), dtype=bool)
        first[1:] = (quotients[1:] != quotients[:-1]) | (remainders[1:] != remainders[:-1])
        sums = np.add.reduceat(counts, np.flatnonzero(first)) if len(order) else counts
        return cls(quotients[first], remainders[first], sums, parts[0].bits)

    def cut(self, ranges: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """The filter by equal ranges of quotients; ``ranges`` is a power of two."""
        part = (self.quotients >> np.uint64(self.bits - ranges.bit_length() + 1)).astype(np.int64)
        bounds = np.searchsorted(part, np.arange(ranges + 1))
        for i in np.flatnonzero(np.diff(bounds)):
            at = slice(bounds[i], bounds[i + 1])
            yield int(i), CountingQuotientFilter(
                self.quotients[at], self.remainders[at], self.counts[at], self.bits
            )

    def repeated(self) -> np.ndarray:
        at = self.counts > 1
        return ((self.quotients[at] << np.uint64(64 - self.bits)) | self.remainders[at]).view(np.int64)

    def dump(self) -> bytes:
        """Run lengths of the occupied quotients, remainders, and the counts above one."""
        occupied, lengths = np.unique(self.quotients, return_counts=True)
        many = np.flatnonzero(self.counts > 1)
        head = np.array([len(occupied), len(self.remainders), len(many)], dtype=np.int64)
        arrays = (occupied.astype(np.uint32), lengths.astype(np.uint32), many.astype(np.uint32))
        return b"".join(
            [head.tobytes(), *(x.tobytes() for x in arrays), self.counts[many].tobytes(), self.remainders.tobytes()]
        )

    @classmethod
    def load(cls, data: bytes, bits: int) -> CountingQuotientFilter:
        runs, entries, many = np.frombuffer(data, np.int64, 3)
        at, parts = 24, []
        for kind, n in ((np.uint32, runs), (np.uint32, runs), (np.uint32, many), (np.int64, many), (np.uint64, entries)):
            parts.append(np.frombuffer(data, kind, n, at))
            at += int(n) * np.dtype(kind).itemsize
        counts = np.ones(entries, dtype=np.int64)
        counts[parts[2]] = parts[3]
        return cls(np.repeat(parts[0], parts[1]).astype(np.uint64), parts[4], counts, bits)


def repeated_fingerprints(signatures: DataFrame, rows: int, bits: int = 32) -> DataFrame:
    """The fingerprints (column ``fp``) that occur more than once in ``signatures``."""
    ranges = max(LEAST_RANGES, 1 << (rows // RANGE_ROWS).bit_length())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(CountingQuotientFilter.build(np.asarray(batch.column(0)), bits))
            size += len(held[-1].counts)
            if size > 2 * RANGE_ROWS:  # fold what has come so far; emit it if it stays large
                held = [CountingQuotientFilter.merge(held)]
                size = len(held[0].counts)
                if size > RANGE_ROWS:
                    yield from dumped(held.pop())
                    size = 0
        if held:
            yield from dumped(CountingQuotientFilter.merge(held))

    def dumped(whole: CountingQuotientFilter) -> Iterator[pa.RecordBatch]:
        for i, part in whole.cut(ranges):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part.dump()], pa.binary())], ["part", "filter"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        whole = CountingQuotientFilter.merge([CountingQuotientFilter.load(x, bits) for x in frame["filter"]])
        return pd.DataFrame({"fp": whole.repeated()})

    filters = signatures.select("fp").mapInArrow(build, "part long, filter binary")
    return filters.groupBy("part").applyInPandas(merge, "fp long")


def verified_groups(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """(_fp, text_sha256, keep_id, group_size) of the texts that occur more than once."""
    text = normalise(F.col("text"))
    again = materialize(repeated_fingerprints(signed.select(F.col("_fp").alias("fp")), signed.count()), "repeated")
    routed = docs.select("doc_id", F.xxhash64(text).alias("fp"), text.alias("same")).join(again, "fp", "left_semi")
    # Written as it comes from the join, whose hot partitions can then be split; grouping
    # after the re-read combines the copies of each split before the shuffle.
    routed = materialize(routed, "routed")
    groups = routed.groupBy("fp", "same").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return groups.select(
        F.col("fp").alias("_fp"), F.sha2("same", 256).alias("text_sha256"), "keep_id", "group_size"
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, …) without text, plus keep_id, group_size, kept, text_sha256."""
    carried = [c for c in docs.columns if c not in ("text", *RESULT)]
    text = normalise(F.col("text"))
    # the digest of the same bytes in the JVM: two 64-bit hashes would do, but the result shows it
    signed = docs.select(*carried, F.xxhash64(text).alias("_fp"), F.sha2(text, 256).alias("text_sha256"))
    signed = materialize(signed, "signatures")
    with Scratch(docs.sparkSession) as scratch:
        groups = verified_groups(docs, signed)
    groups = materialize(groups, "groups")
    scratch.drop()
    found = signed.join(groups, ["_fp", "text_sha256"], "left")
    single = F.col("group_size").isNull()
    return found.select(
        *carried,
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
