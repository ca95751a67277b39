"""BPE encoding and decoding by speculation and verification.

For a vocabulary of ranked merges with an end-of-word mark (a ``tokenizers`` JSON file):

1. Speculate: every distinct word is cut greedily into longest vocabulary entries.
2. Verify: a cut is the exact BPE result if each neighbouring pair of tokens is compatible,
   that is, if merging the characters of the two alone gives the same two tokens back. All
   neighbouring pairs of a batch are tested at once by a sorted lookup of known pairs; a pair
   not met before is merged once and remembered.
3. Only words with an incompatible pair are merged exactly, lowest rank first.

Words are kept with their tokens in two generations of at most ``CACHED_WORDS``,
``CACHED_LETTERS`` and the words of one slice; a full generation becomes the older one and
words in use move back from it. Known pairs are forgotten beyond ``KNOWN_PAIRS``. So memory
is bounded and every text is encoded whole; a word of n letters takes n log n steps.

Defined results: null text counts as empty; an empty text has no tokens and decodes to the
empty string; special tokens written in a text become their ids; rows repeat in the output
as in the input; extra columns are carried along."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .spans import text_slices, with_fields

CACHED_WORDS = 300_000
CACHED_LETTERS = 1 << 24
KNOWN_PAIRS = 1 << 22
#: Words of more symbols keep their pairs in a heap; a scan of a short list is faster.
SCANNED = 64
UNRANKED = 1 << 62
SLICE_BYTES = 1 << 20

# The word pattern of the vocabulary file, and its white space.
SPACE = "\\u0009-\\u000d\\u0020\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^" + SPACE + "\\p{L}\\p{N}]+"


def byte_letters() -> list[str]:
    """A printable letter for every byte: itself if printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """The plain tables of a vocabulary file, fit for a broadcast (about 5 MB)."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    model = data["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return {
        "vocab": model["vocab"],
        "merges": merges,
        "suffix": model["end_of_word_suffix"],
        "special": {t["content"]: t["id"] for t in data["added_tokens"]},
    }


class Encoder:
    def __init__(self, tables: dict):
        vocab, suffix = tables["vocab"], tables["suffix"]
        self.special = tables["special"]
        self.token_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.merge = {
            (vocab[a], vocab[b]): rank << 32 | vocab[a + b] for rank, (a, b) in enumerate(tables["merges"])
        }
        self.final = {t.removesuffix(suffix): i for t, i in vocab.items() if t.endswith(suffix)}
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(suffix)}
        self.last_reach = max(map(len, self.final), default=0)
        self.reach: dict[str, int] = {}  # the longest entry that begins with two given letters
        for t in self.inner:
            self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 1))
        # the symbols a token starts from before any merge
        self.symbols = {i: [self.inner[c] for c in t] for t, i in self.inner.items()}
        for t, i in self.final.items():
            if t:
                self.symbols[i] = [*(self.inner[c] for c in t[:-1]), self.final[t[-1]]]
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.word = regex.compile(WORD)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.good, self.bad = np.empty(0, np.int64), np.empty(0, np.int64)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cached_letters = 0

    def merged(self, symbols: list[int]) -> list[int]:
        """Exact merging: the pair of lowest rank first, from the left."""
        if len(symbols) > SCANNED:
            return self.merged_by_heap(symbols)
        out = list(symbols)
        rank = self.merge.get
        ranks = [rank(pair, UNRANKED) for pair in zip(out, out[1:])]
        while ranks and (best := min(ranks)) != UNRANKED:
            at = ranks.index(best)
            out[at : at + 2] = [best & 0xFFFFFFFF]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((out[at - 1], out[at]), UNRANKED)
            if at < len(ranks):
                ranks[at] = rank((out[at], out[at + 1]), UNRANKED)
        return out

    def merged_by_heap(self, symbols: list[int]) -> list[int]:
        """As ``merged``, in n log n steps: pairs wait by rank and place, symbols are linked."""
        size, rank = len(symbols), self.merge.get
        out, after, before = list(symbols), list(range(1, size + 1)), list(range(-1, size - 1))
        waiting = [(best, at) for at, pair in enumerate(zip(out, out[1:])) if (best := rank(pair)) is not None]
        heapq.heapify(waiting)
        while waiting:
            best, at = heapq.heappop(waiting)
            gone = after[at]
            if gone >= size or rank((out[at], out[gone])) != best:
                continue  # one of the two has been merged since
            out[at], out[gone] = best & 0xFFFFFFFF, -1
            after[at] = after[gone]
            if after[at] < size:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] < size and (pair := rank((out[left], out[after[left]]))) is not None:
                    heapq.heappush(waiting, (pair, left))
        return [x for x in out if x >= 0]

    def proposed(self, word: str) -> list[int]:
        """Longest vocabulary entry first; the last one carries the end mark."""
        tokens, at, size = [], 0, len(word)
        final, inner, reach = self.final, self.inner, self.reach
        while size - at > self.last_reach or (last := final.get(word[at:])) is None:
            for end in range(min(at + reach.get(word[at : at + 2], 1), size - 1), at, -1):
                token = inner.get(word[at:end])
                if token is not None:
                    tokens.append(token)
                    at = end
                    break
        tokens.append(last)
        return tokens

    def incompatible(self, pairs: np.ndarray) -> np.ndarray:
        """Which of the pairs (left << 32 | right) do not stand; (-1, t) is t alone."""
        if len(self.good) + len(self.bad) > KNOWN_PAIRS:
            self.good, self.bad = np.empty(0, np.int64), np.empty(0, np.int64)
        distinct, where = np.unique(pairs, return_inverse=True)
        new = distinct[~(np.isin(distinct, self.good) | np.isin(distinct, self.bad))]
        if len(new):
            stands = np.zeros(len(new), dtype=bool)
            for i, pair in enumerate(new.tolist()):
                tokens = [t for t in (pair >> 32, pair & 0xFFFFFFFF) if t >= 0]
                stands[i] = self.merged(list(chain.from_iterable(self.symbols[t] for t in tokens))) == tokens
            self.good = np.union1d(self.good, new[stands])
            self.bad = np.union1d(self.bad, new[~stands])
        return np.isin(distinct, self.bad)[where]

    def learn(self, words: list[str]) -> None:
        """Tokens of words not in the cache: speculate, verify, merge what fails."""
        letters = self.letters
        spelt = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(letters) for w in words]
        proposals = [self.proposed(w) for w in spelt]
        sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter(chain.from_iterable(proposals), np.int64, int(sizes.sum()))
        first = np.cumsum(sizes) - sizes
        left = np.empty_like(flat)
        left[1:] = flat[:-1]
        left[first] = -1
        check = np.ones(len(flat), dtype=bool)
        check[first] = sizes == 1  # the first of several is tested with its neighbour
        wrong = np.zeros(len(flat), dtype=bool)
        wrong[check] = self.incompatible((left[check] << 32) | flat[check])
        failed = np.logical_or.reduceat(wrong, first)
        stream, ends = flat.astype("<u4").tobytes(), np.cumsum(sizes) * 4
        for i, word in enumerate(words):
            if failed[i]:
                symbols = [*(self.inner[c] for c in spelt[i][:-1]), self.final[spelt[i][-1]]]
                self.cache[word] = np.array(self.merged(symbols), dtype="<u4").tobytes()
            else:
                self.cache[word] = stream[ends[i] - 4 * sizes[i] : ends[i]]

    def words(self, text: str) -> list[str]:
        """Composed, lower-cased words; a special token stands for itself."""
        if self.split and "<|" in text and len(parts := self.split.split(text)) > 1:
            return list(chain.from_iterable([p] if p in self.special else self.words(p) for p in parts))
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.word.findall(text.lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of every text."""
        if len(self.cache) > CACHED_WORDS or self.cached_letters > CACHED_LETTERS:
            self.cache, self.older, self.cached_letters = {}, self.cache, 0
        split = list(map(self.words, texts))
        for token, number in self.special.items():
            self.cache[token] = np.array([number], dtype="<u4").tobytes()
        new = set(chain.from_iterable(split)).difference(self.cache)
        self.cached_letters += sum(map(len, new))
        known = new.intersection(self.older)
        self.cache.update(zip(known, map(self.older.__getitem__, known)))
        if len(new) > len(known):
            self.learn(list(new - known))
        return [b"".join(map(self.cache.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        """The token strings joined by blanks: the vocabulary file names no decoder."""
        return " ".join(map(self.token_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_texts(docs: DataFrame, tables: dict, decode: bool = False) -> DataFrame:
    """``docs`` plus ``ids`` (binary, little-endian 32 bits each) and, if asked, ``decoded``:
    the text those ids decode to."""
    held = docs.sparkSession.sparkContext.broadcast({"tables": tables, "encoder": None})
    schema = with_fields(docs, "ids binary, decoded string" if decode else "ids binary")
    names = schema.names

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = held.value  # kept by the worker from task to task, and the encoder with it
        if state["encoder"] is None:
            state["encoder"] = Encoder(state["tables"])
        encoder = state["encoder"]
        for batch in batches:
            for first, _, offsets in text_slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(first, len(offsets) - 1)
                ids = encoder.encode([x or "" for x in part.column("text").to_pylist()])
                columns = [*part.columns, pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array(list(map(encoder.decode, ids)), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.drop("ids", "decoded" if decode else "ids").mapInArrow(encoded, schema)
