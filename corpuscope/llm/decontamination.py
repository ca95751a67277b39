"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are sequences of words: letters A-Z lower-cased, runs of ASCII letters,
digits and all characters beyond ASCII. A window is ``Limits.words`` consecutive words of an
item; an item of fewer words, but not none, is one window. Every occurrence of a window in
a document marks its words as hit.

The automaton accepts every stretch of every item. A document's words stream through it and
the length of the longest stretch that ends at each word is tracked: where it reaches
``Limits.words``, the last words are a window. For each state the automaton knows the items
that hold its last window, and the short items that end there. Words that no item knows,
and neighbours that no item has side by side, cut a text into pieces first; pieces too short
for a window never enter the automaton.

Items go into blocks of about ``Limits.block_words`` words, cut into overlapping pieces of
``PIECE_WORDS`` where needed, and one automaton per block is built in a task. What is
broadcast is thus bounded by the block, not by the benchmark: at most twice as many states
as words, some 60 bytes a word. Each block meets all documents in a pass of its own, and
the hits of several blocks are joined by the digest of the text, so equal texts count once.

Defined results: null or empty text has no words and no hits; null stays null; items
without words, or null, never occur; repeated items count once; an item with a null id marks
words but is not listed; rows of documents repeat in the output as in the input, whatever
their ids; extra columns are carried along unless they bear the name of a result column."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, materialize
from .spans import LETTERS, LOWER, text_slices, with_fields, word_spans

PIECE_WORDS = 1_024
HITS = "n_words long, spans array<struct<start:long,end:long>>, items array<long>"
RESULT = "n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<long>, cleaned string"


@dataclass(frozen=True)
class Limits:
    words: int = 10
    #: A document with a larger share of hit words is not worth keeping: its cleaned text is empty.
    coverage: float = 0.5
    block_words: int = 250_000


def words_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The lower-cased words as an array of byte strings."""
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = np.ascontiguousarray(LOWER[data[LETTERS[data]]])
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]
    )


class Automaton:
    """Suffix automaton of several word sequences: state 0 is the empty stretch."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, at: int, word: int, to: int) -> int:
        """The state of ``at`` followed by ``word`` where that stretch is no state's longest."""
        copy = self._state(self.length[at] + 1, dict(self.step[to]), self.link[to])
        self.link[to] = copy
        while at >= 0 and self.step[at].get(word) == to:
            self.step[at][word] = copy
            at = self.link[at]
        return copy

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            to = self.step[last].get(word)
            if to is not None:
                last = to if self.length[to] == self.length[last] + 1 else self._split(last, word, to)
                continue
            new, at = self._state(self.length[last] + 1, {}, 0), last
            while at >= 0 and word not in self.step[at]:
                self.step[at][word] = new
                at = self.link[at]
            if at >= 0:
                to = self.step[at][word]
                self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, word, to)
            last = new

    def walk(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """After every word: the state and length of the longest stretch that ends there."""
        step, link, lengths = self.step, self.link, self.length
        state = length = 0
        for word in words:
            while state and word not in step[state]:
                state = link[state]
                length = lengths[state]
            if word in step[state]:
                state = step[state][word]
                length += 1
            yield state, length


class Index:
    """The automaton of a block of items, and what its states say about windows."""

    def __init__(self, tables: dict):
        vars(self).update(tables)
        self.automaton = Automaton()
        vars(self.automaton).update(tables["automaton"])

    def packed(self) -> bytes:
        """Plain tables, so that no task needs this class to read them."""
        return pickle.dumps({**vars(self), "automaton": vars(self.automaton)})

    @classmethod
    def unpacked(cls, data: bytes) -> Index:
        return cls(pickle.loads(data))

    @classmethod
    def of(cls, items: list[tuple[int | None, list[bytes]]], window: int) -> Index:
        vocabulary = sorted({w for _, words in items for w in words})
        number = {w: i for i, w in enumerate(vocabulary)}
        coded = [(item, [number[w] for w in words]) for item, words in items]
        pairs = np.unique(np.array([a << 32 | b for _, w in coded for a, b in zip(w, w[1:])], dtype=np.int64))
        auto = Automaton()
        for _, words in coded:
            auto.add(words)
        by_length = np.argsort(auto.length, kind="stable").tolist()
        top = [-1] * len(auto.length)  # the state of the last ``window`` words of a state
        for state in by_length[1:]:
            if auto.length[state] >= window:
                above = auto.link[state]
                top[state] = state if auto.length[above] < window else top[above]
        holders: dict[int, set] = {}  # state of a window or short item: ids
        whole = set()
        for item, words in coded:
            state = 0
            for state, length in auto.walk(words):
                if length >= window:
                    holders.setdefault(top[state], set()).add(item)
            if len(words) < window:
                whole.add(state)
                holders.setdefault(state, set()).add(item)
        short = [0] * len(auto.length)  # the longest short item that a state ends with
        for state in by_length[1:]:
            short[state] = state if state in whole else short[auto.link[state]]
        return cls(
            {
                "automaton": vars(auto),
                "window": window,
                "shortest": min((min(len(words), window) for _, words in items), default=window),
                "vocabulary": pa.array(vocabulary, pa.large_binary()),
                "pairs": pairs,
                "top": top,
                "holders": holders,
                "short": short,
            }
        )

    def hits(self, words: list[int]) -> tuple[list[int], list[int], set]:
        """First words and sizes of the windows in a piece, and the items that hold them."""
        auto, window, top, short = self.automaton, self.window, self.top, self.short
        at, sizes, items = [], [], set()
        for place, (state, length) in enumerate(auto.walk(words)):
            if length >= window:
                at.append(place + 1 - window)
                sizes.append(window)
                items |= self.holders[top[state]]
            end = short[state]
            if end == state and auto.length[end] > length:
                end = short[auto.link[end]]
            if end:
                at.append(place + 1 - auto.length[end])
                sizes.append(auto.length[end])
                while end:
                    items |= self.holders[end]
                    end = short[auto.link[end]]
        return at, sizes, items

    def search(self, words: pa.Array, text: np.ndarray) -> tuple[np.ndarray, dict[int, set]]:
        """Which words of consecutive texts are hit, and the items found in each text."""
        steps = np.zeros(len(words) + 1, dtype=np.int32)
        found: dict[int, set] = {}
        coded = pa.compute.index_in(words, value_set=self.vocabulary)
        coded = coded.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        known = coded >= 0
        both = np.flatnonzero(known[:-1] & known[1:] & (text[:-1] == text[1:]))
        code = coded[both] << 32 | coded[both + 1]
        where = np.searchsorted(self.pairs, code)
        tied = np.zeros(len(words) + 1, dtype=bool)  # to the word before
        if len(self.pairs):
            tied[both[self.pairs[np.minimum(where, len(self.pairs) - 1)] == code] + 1] = True
        firsts = np.flatnonzero(known & ~tied[:-1])
        lasts = np.flatnonzero(known & ~tied[1:]) + 1
        enough = np.flatnonzero(lasts - firsts >= self.shortest)
        for first, last in zip(firsts[enough].tolist(), lasts[enough].tolist()):
            at, sizes, items = self.hits(coded[first:last].tolist())
            if at:
                at = np.array(at) + first
                np.add.at(steps, at, 1)
                np.add.at(steps, at + np.array(sizes), -1)
                found.setdefault(int(text[first]), set()).update(items)
        return np.cumsum(steps)[:-1] > 0, found


def item_pieces(benchmark: DataFrame, p: Limits) -> DataFrame:
    """(item_id, words array<binary>): every distinct item, long ones as overlapping pieces."""
    pieces = PIECE_WORDS + p.words

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_slices(batch.column("text")):
                starts, ends, text = word_spans(data, offsets, LETTERS)
                words = words_of(data, starts, ends).to_pylist()
                bounds = np.searchsorted(text, np.arange(len(offsets))).tolist()
                ids = batch.column("item_id").slice(first, len(offsets) - 1).to_pylist()
                rows = [
                    (item, words[at : min(at + pieces, high)])
                    for item, low, high in zip(ids, bounds, bounds[1:])
                    for at in range(low, max(low, high - p.words) + 1, PIECE_WORDS)
                    if low < high
                ]
                arrays = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(arrays, ["item_id", "words"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return items.mapInArrow(cut, "item_id long, words array<binary>")


def indexes(benchmark: DataFrame, p: Limits) -> Iterator[bytes]:
    """The pickled index of every block of items, one at a time."""
    pieces = materialize(item_pieces(benchmark, p), "pieces")
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // p.block_words))
    block = F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)).cast("int").alias("block")
    window = p.words

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        order = rows.sort_values("item_id", kind="stable", na_position="first")
        items = [(None if pd.isna(i) else int(i), list(w)) for i, w in zip(order["item_id"], order["words"])]
        return pd.DataFrame({"block": rows["block"].iloc[:1], "index": [Index.of(items, window).packed()]})

    built = pieces.withColumn("block", block).groupBy("block").applyInPandas(build, "block int, index binary")
    built = materialize(built, "indexes")
    for number in range(blocks):
        for row in built.filter(F.col("block") == number).collect():  # one, of bounded size
            yield bytes(row["index"])


def spans_of(hit: np.ndarray, text: np.ndarray, first_word: np.ndarray, texts: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Maximal spans of hit words: a list per text by word number, and their bounds in the slice."""
    before = np.r_[False, hit[:-1] & (text[1:] == text[:-1])] if len(hit) else hit
    after = np.r_[hit[1:] & (text[1:] == text[:-1]), False] if len(hit) else hit
    low, high = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
    owner = text[low]
    fields = [pa.array(low - first_word[owner]), pa.array(high - first_word[owner])]
    bounds = np.searchsorted(owner, np.arange(texts + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(fields, ["start", "end"])), low, high


def cleaned_texts(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray, emptied: np.ndarray) -> pa.Array:
    """The texts without the byte ranges ``cuts``; empty where ``emptied``."""
    steps = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(steps, cuts[:, 0], 1)
    np.add.at(steps, cuts[:, 1], -1)
    np.add.at(steps, offsets[:-1][emptied], 1)
    np.add.at(steps, offsets[1:][emptied], -1)
    kept = np.cumsum(steps)[:-1] == 0
    sizes = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(kept, out=sizes[1:])
    out = np.ascontiguousarray(data[kept])
    bounds = np.ascontiguousarray(sizes[offsets])
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(bounds), pa.py_buffer(out)).cast(pa.string())


def _search(docs: DataFrame, index: bytes, p: Limits) -> DataFrame:
    """``docs`` (with text) plus the columns of ``RESULT`` for one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Index.unpacked(shared.value)
        for batch in batches:
            column = batch.column("text")
            for first, data, offsets in text_slices(column):
                texts = len(offsets) - 1
                starts, ends, text = word_spans(data, offsets, LETTERS)
                hit, found = ready.search(words_of(data, starts, ends), text)
                ids = [sorted(x for x in found.get(t, ()) if x is not None) for t in range(texts)]
                yield finished(batch.slice(first, texts), data, offsets, starts, ends, text, hit, ids, p)

    return docs.mapInArrow(searched, with_fields(docs, RESULT))


def finished(batch, data, offsets, starts, ends, text, hit, ids, p: Limits) -> pa.RecordBatch:
    """The rows of a slice with their results, from the hit words and the items per text."""
    texts = len(offsets) - 1
    counts = np.bincount(text, minlength=texts).astype(np.int64)
    hits = np.bincount(text[hit], minlength=texts).astype(np.int64)
    spans, low, high = spans_of(hit, text, np.cumsum(counts) - counts, texts)
    cuts = np.column_stack([starts[low], ends[high - 1]])
    cleaned = cleaned_texts(data, offsets, cuts, hits > p.coverage * counts)
    nulls = batch.column("text").is_null()
    if nulls.true_count:
        cleaned = pa.compute.if_else(nulls, pa.scalar(None, pa.string()), cleaned)
    added = {
        "n_words": pa.array(counts),
        "n_hit": pa.array(hits),
        "spans": spans,
        "items": pa.array(ids, pa.list_(pa.int64())),
        "cleaned": cleaned,
    }
    names = [n for n in batch.schema.names if n not in added]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *added.values()], [*names, *added])


def _merged(docs: DataFrame, found: DataFrame, p: Limits) -> DataFrame:
    """``docs`` with the hits of all blocks: ``found`` has lists of them by text digest."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.drop_columns(["_digest", "_spans", "_items"])
            for first, data, offsets in text_slices(batch.column("text")):
                texts = len(offsets) - 1
                starts, ends, text = word_spans(data, offsets, LETTERS)
                first_word = np.searchsorted(text, np.arange(texts))
                steps = np.zeros(len(starts) + 1, dtype=np.int32)
                part = batch.slice(first, texts)
                ids = []
                rows = zip(part.column("_spans").to_pylist(), part.column("_items").to_pylist())
                for at, (spans, items) in enumerate(rows):
                    for span in spans or ():
                        steps[first_word[at] + span["start"]] += 1
                        steps[first_word[at] + span["end"]] -= 1
                    ids.append(sorted(set(items or ())))
                hit = np.cumsum(steps)[:-1] > 0
                yield finished(rest.slice(first, texts), data, offsets, starts, ends, text, hit, ids, p)

    schema = with_fields(docs, RESULT)
    digest = F.sha2("text", 256).alias("_digest")
    return docs.select("*", digest).join(found, "_digest", "left").mapInArrow(merge, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: Limits = Limits()) -> DataFrame:
    """``docs`` plus n_words, n_hit, spans of hit words (start, end past the last), items
    (sorted ids) and cleaned: the text without the spans, empty beyond ``p.coverage``."""
    docs = docs.drop("n_words", "n_hit", "spans", "items", "cleaned", "_digest", "_spans", "_items")
    with Scratch(docs.sparkSession) as scratch:
        blocks = indexes(benchmark, p)
        first = next(blocks, None) or Index.of([], p.words).packed()
        second = next(blocks, None)
        if second is None:
            scratch.drop()
            return _search(docs, first, p)
        texts, tables = docs.select("text"), []
        for index in (first, second, *blocks):
            hits = _search(texts, index, p).filter("n_hit > 0")
            hits = hits.select(F.sha2("text", 256).alias("_digest"), "spans", "items")
            tables.append(materialize(hits.groupBy("_digest").agg(F.first("spans").alias("spans"), F.first("items").alias("items")), "hits"))
        every = tables[0]
        for table in tables[1:]:
            every = every.unionByName(table)
        found = every.groupBy("_digest").agg(
            F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items")
        )
    return _merged(docs, found, p)
