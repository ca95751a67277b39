"""Runs of repeated word sequences, found by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q, at least
``Periods.least_exponent`` periods and ``Periods.least_length`` words long, that no
neighbouring word extends. Inside a run two windows of positions one period apart hold the
same words, so they choose their minima one period apart as well:

* A scale covers the periods ``low`` to ``high`` (half as long again). Positions are keyed by
  a hash of the next ``high`` words, and every window of ``width`` positions selects its
  leftmost smallest key. A run of three periods holds two equal windows one period apart,
  and because the keyed words span a whole smallest period, the next selected position with
  the same key is exactly one period on. Such pairs are the scale's seeds.
* A seed is extended to both sides by comparing words; seeds inside the stretch found are
  skipped. Word numbers are compared, not hashes, so a collision costs time only.
* Periods up to ``Periods.scanned`` are too short for windows: for each of them one scan
  marks the words equal to the word that many places on.

A period that divides a longer one is told by its prime factors. Scales grow with the text,
so the work is in proportion to words times the logarithm of the longest text; a batch of
texts is worked on together, longest first, so that a scale touches only texts that can
hold its runs. No text meets another, nothing is shuffled. A task holds about 20 bytes per
byte of one slice (``SLICE_BYTES``, or one longer text).

Defined results: null text has no words, no runs and a null collapsed text; a text of
blanks collapses to the empty string; rows repeat in the output as in the input, whatever
their ids; extra columns are carried along unless they bear the name of a result column."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import NOT_SPACE, mix64, text_slices, with_fields, word_spans

RESULT = "runs array<struct<start:long,length:long,period:long>>, collapsed string"
ALL_ONES = np.uint64((1 << 64) - 1)
LOW_HALF = np.uint64((1 << 32) - 1)
COPY_WORDS = 1 << 17


@dataclass(frozen=True)
class Periods:
    least_length: int = 24
    #: At least 3: two periods do not hold two equal windows.
    least_exponent: int = 3
    scanned: int = 8

    def least(self, period: int) -> int:
        return max(self.least_length, self.least_exponent * period)

    def scales(self, longest: int) -> Iterator[tuple[int, int, int]]:
        """(low, high, window width) of the scales that a text of ``longest`` words needs."""
        low = self.scanned + 1
        while self.least(low) <= longest:
            high = low + low // 2
            yield low, high, (self.least_exponent - 1) * low - high + 1
            low = high + 1


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number per word, the same for the same bytes."""
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = np.ascontiguousarray(data[NOT_SPACE[data]])
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]
    )
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32)


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest key of every window of ``width`` keys."""
    if len(keys) < width:
        return keys[:0]
    out, span = keys, 1
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Grams:
    """Hashes of the next ``size`` words at every position, for rising sizes: the hash of
    two halves of a power of two, or of two overlapping powers."""

    def __init__(self, words: np.ndarray):
        self.size = 1
        self.level = mix64(words.astype(np.int64).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))

    @staticmethod
    def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return mix64(left * np.uint64(0xD6E8FEB86659FD93) + right)

    def of(self, size: int, first: int) -> np.ndarray:
        """Hashes at the positions below ``first`` that have ``size`` words after them."""
        self.level = self.level[:first]
        while 2 * self.size <= size:
            self.level = self._joined(self.level[: -self.size], self.level[self.size :])
            self.size *= 2
        rest = size - self.size
        return self._joined(self.level[: len(self.level) - rest], self.level[rest:])


def equal_ahead(words: np.ndarray, left: int, right: int) -> int:
    """How many words from ``left`` on equal those from ``right`` on (right > left)."""
    found, step = 0, 32
    while (size := min(step, len(words) - right - found)) > 0:
        a, b = left + found, right + found
        odd = np.flatnonzero(words[a : a + size] != words[b : b + size])
        if len(odd):
            return found + int(odd[0])
        found += size
        step = min(2 * step, 1 << 16)
    return found


def equal_behind(words: np.ndarray, left: int, right: int) -> int:
    """How many words before ``left`` equal those before ``right``."""
    found, step = 0, 32
    while (size := min(step, left - found)) > 0:
        a, b = left - found, right - found
        odd = np.flatnonzero(words[a - size : a] != words[b - size : b])
        if len(odd):
            return found + size - 1 - int(odd[-1])
        found += size
        step = min(2 * step, 1 << 16)
    return found


def is_smallest(words: np.ndarray, start: int, period: int) -> bool:
    """Whether the first ``period`` words of a stretch with that period, two periods long
    or more, are no power of fewer words."""
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            shorter = period // factor
            if equal_ahead(words[start : start + period], 0, shorter) == period - shorter:
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def scanned_runs(words: np.ndarray, period: int, least: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the stretches with that period, told word by word."""
    if len(words) <= period:
        return
    odd = np.flatnonzero(words[period:] != words[:-period])
    bounds = np.concatenate(([-1], odd, [len(words) - period]))
    equal = np.diff(bounds) - 1
    for at in np.flatnonzero(equal >= least - period):
        yield int(bounds[at]) + 1, int(equal[at]) + period


def scale_seeds(hashes: np.ndarray, room: np.ndarray, low: int, high: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of the selected positions whose next equal one is ``low`` to
    ``high`` words on, by period, then position. ``room``: words left in the text."""
    keys = (hashes & ~LOW_HALF) | np.arange(len(hashes), dtype=np.uint64)
    keys[room[: len(keys)] < high] = ALL_ONES
    minima = window_minima(keys, width)
    minima = minima[minima != ALL_ONES]
    new = np.ones(len(minima), dtype=bool)
    new[1:] = minima[1:] != minima[:-1]
    chosen = (minima[new] & LOW_HALF).astype(np.int64)
    order = np.argsort(hashes[chosen], kind="stable")
    sorted_at, sorted_hash = chosen[order], hashes[chosen[order]]
    apart = np.diff(sorted_at)
    pairs = np.flatnonzero((sorted_hash[1:] == sorted_hash[:-1]) & (apart >= low) & (apart <= high))
    at, period = sorted_at[pairs], apart[pairs]
    order = np.lexsort((at, period))
    return at[order], period[order]


def extended(words: np.ndarray, at: np.ndarray, periods: np.ndarray, p: Periods) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the stretches that the seeds lie in, each once."""
    seed = 0
    while seed < len(at):
        here, period = int(at[seed]), int(periods[seed])
        start = here - equal_behind(words, here, here + period)
        end = here + equal_ahead(words, here, here + period)  # of the words with an equal one ahead
        if end - start + period >= p.least(period):
            yield start, end - start + period, period
        same = int(np.searchsorted(periods, period, side="right"))
        seed = max(seed + 1, int(np.searchsorted(at[:same][seed:], end)) + seed)


def runs_of(words: np.ndarray, counts: np.ndarray, p: Periods = Periods()) -> np.ndarray:
    """Rows (text, start, length, period), sorted, of all runs in consecutive texts of
    ``counts`` words."""
    none = np.empty((0, 4), dtype=np.int64)
    able = np.flatnonzero(counts >= p.least(1))
    if not len(able):
        return none
    able = able[np.argsort(-counts[able], kind="stable")]
    sizes, firsts = counts[able], (np.cumsum(counts) - counts)[able]
    base = np.cumsum(sizes + 1) - (sizes + 1)
    # Texts longest first, each followed by a number of its own that equals no word.
    line = np.empty(int(base[-1] + sizes[-1]) + 1, dtype=np.int32)
    room = np.empty(len(line), dtype=np.int32)
    for text, (first, size, at) in enumerate(zip(firsts.tolist(), sizes.tolist(), base.tolist())):
        line[at : at + size] = words[first : first + size]
        line[at + size] = -1 - text
        room[at : at + size + 1] = np.arange(size, -1, -1)
    found = [
        (start, length, period)
        for period in range(1, p.scanned + 1)
        for start, length in scanned_runs(line, period, p.least(period))
    ]
    grams = Grams(line)
    for low, high, width in p.scales(int(sizes[0])):
        last = int(np.flatnonzero(sizes >= p.least(low))[-1])
        seeds = scale_seeds(grams.of(high, int(base[last] + sizes[last]) + 1), room, low, high, width)
        found += extended(line, *seeds, p)
    found = [run for run in found if is_smallest(line, run[0], run[2])]
    if not found:
        return none
    start, length, period = np.array(found, dtype=np.int64).T
    text = np.searchsorted(base, start, side="right") - 1
    rows = np.column_stack([able[text], start - base[text], length, period])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def without_repeats(counts: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run holds after its first period."""
    steps = np.zeros(int(counts.sum()) + 1, dtype=np.int32)
    first = (np.cumsum(counts) - counts)[runs[:, 0]] + runs[:, 1]
    np.add.at(steps, first + runs[:, 3], 1)
    np.add.at(steps, first + runs[:, 2], -1)
    return np.cumsum(steps)[:-1] == 0


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, texts: int) -> pa.Array:
    """The given words of every text, joined by one space."""
    last = np.ones(len(starts), dtype=bool)
    last[:-1] = text[1:] != text[:-1]
    sizes = ends - starts + ~last
    total = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=total[1:])
    out = np.empty(int(total[-1]), dtype=np.uint8)
    padded = np.append(data, np.uint8(0x20))
    for at in range(0, len(starts), COPY_WORDS):
        part = slice(at, at + COPY_WORDS)
        low, high = int(total[at]), int(total[min(at + COPY_WORDS, len(starts))])
        out[low:high] = padded[np.arange(low, high) + np.repeat(starts[part] - total[:-1][part], sizes[part])]
    out[(total[1:] - 1)[~last]] = 0x20
    offsets = total[np.searchsorted(text, np.arange(texts + 1))]
    return pa.LargeStringArray.from_buffers(texts, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def find_runs(docs: DataFrame, p: Periods = Periods()) -> DataFrame:
    """``docs`` plus runs (by start, then period) and collapsed: the words that no run
    repeats, joined by one space."""
    if p.least_exponent < 3:
        raise ValueError("a run needs three periods or more")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n not in ("runs", "collapsed")]
            column = batch.column("text")
            for first, data, offsets in text_slices(column):
                texts = len(offsets) - 1
                starts, ends, text = word_spans(data, offsets, NOT_SPACE)
                counts = np.bincount(text, minlength=texts).astype(np.int64)
                runs = runs_of(word_numbers(data, starts, ends), counts, p)
                kept = without_repeats(counts, runs)
                bounds = np.searchsorted(runs[:, 0], np.arange(texts + 1)).astype(np.int32)
                fields = [pa.array(np.ascontiguousarray(runs[:, i])) for i in (1, 2, 3)]
                rows = pa.ListArray.from_arrays(
                    pa.array(bounds), pa.StructArray.from_arrays(fields, ["start", "length", "period"])
                )
                collapsed = joined_words(data, starts[kept], ends[kept], text[kept], texts)
                nulls = column.slice(first, texts).is_null()
                if nulls.true_count:
                    collapsed = pa.compute.if_else(nulls, pa.scalar(None, pa.string()), collapsed)
                part = batch.slice(first, texts)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), rows, collapsed], [*names, "runs", "collapsed"]
                )

    return docs.mapInArrow(found, with_fields(docs, RESULT))


def strongest(runs: Column) -> Column:
    """The run of greatest exact length over period; ties: smallest start, then period."""

    def order(a: Column, b: Column) -> Column:
        gain = a["length"] * b["period"] - b["length"] * a["period"]
        later = F.coalesce(F.nullif(a["start"] - b["start"], F.lit(0)), a["period"] - b["period"])
        return F.signum(F.when(gain != 0, -gain).otherwise(later)).cast("int")

    return F.get(F.array_sort(runs, order), F.lit(0))


def run_lines(runs: Column) -> Column:
    """Every run as ``start,length,period`` and a line feed."""
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), ""
    )


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` where one text in ten, by the crc32 of its id, repeats its tail.

    With h that number, g = floor(h / 10) and n words, a text with h % 10 = 0 keeps its first
    a = g % n words; from there on its next p = 1 + floor((n - a) / (3 + g % 8)) words come
    again and again up to n words. Rows with a null id stay as they are."""
    blanks = " \t\n\x0b\x0c\r"
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    trimmed = F.trim(F.col("text"), F.lit(blanks))
    taken = F.coalesce((h % 10 == 0) & (trimmed != ""), F.lit(False))
    found = docs.withColumn("_words", F.when(taken, F.split(trimmed, "[\\x20\\x09-\\x0D]+", -1)))
    found = found.withColumn("_g", F.floor(h / 10)).withColumn("_n", F.size("_words").cast("long"))
    words, g, n = F.col("_words"), F.col("_g"), F.col("_n")
    found = found.withColumn("_a", F.when(words.isNotNull(), g % n).cast("int"))
    tail = (n - F.col("_a")).cast("int")
    found = found.withColumn("_p", (1 + F.floor(tail / (3 + g % 8))).cast("int"))
    period = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    again = F.array_repeat(period, F.ceil(tail / F.col("_p")).cast("int"))
    whole = F.concat(F.slice("_words", F.lit(1), F.col("_a")), F.slice(F.flatten(again), F.lit(1), tail))
    text = F.when(words.isNotNull(), F.array_join(whole, " ")).otherwise(F.col("text"))
    return found.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])
