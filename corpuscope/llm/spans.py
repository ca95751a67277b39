"""Words of UTF-8 text as byte spans, and 64-bit hashes of spans, a slice of texts at a time.

Bytes below 0x80 never occur inside a longer character, so splitting at ASCII bytes and
lower-casing A-Z need no decoding. Slices bound the memory of a task: about 30 bytes per
byte of text while a slice is worked on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 20
MASK64 = (1 << 64) - 1
#: Odd multiplier of the positional hash; its powers weight the bytes of a span.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))

#: Words of the shingle contracts: anything but space and U+0009 to U+000D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Words for scoring: ASCII letters, digits and every byte of a longer character.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[128:] = True
for _first, _last in (("0", "9"), ("A", "Z"), ("a", "z")):
    LETTERS[ord(_first) : ord(_last) + 1] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about ``limit`` bytes.

    Null texts are empty. A text above the limit is a slice of its own."""
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    rows = len(column)
    if not rows:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + rows + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.empty(0, np.uint8)
    first = 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; no word crosses a text's end."""
    inside = is_word[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(after & (~before | cut))
    ends = np.flatnonzero(before & (~after | cut))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


class SpanHasher:
    """64-bit hashes of byte spans: sums of coded bytes weighted by powers of ``BASE``,
    moved to a common position and mixed. Equal bytes give equal hashes anywhere."""

    def __init__(self) -> None:
        self._powers = self._inverse = np.empty(0, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self._powers) < size:
            size = max(size, 2 * SLICE_BYTES)
            for name, base in (("_powers", BASE), ("_inverse", BASE_INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODES[data] * self._powers[: len(data)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * self._inverse[starts])


def with_fields(docs: DataFrame, fields: str) -> StructType:
    """The schema of ``docs`` without any field of that name, then ``fields`` (as DDL)."""
    added = StructType.fromDDL(fields)
    return StructType([*(f for f in docs.schema if f.name not in added.names), *added])
