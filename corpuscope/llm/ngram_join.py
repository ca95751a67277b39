"""N-gram Jaccard self-join: a size-aware heavy-light join.

Two documents link when the Jaccard similarity of their sets of word shingles is at least
``percent`` / 100. Equal sets are one set. The other links are found by keys:

* Light (small) sets enumerate fixed-size subsets. The universe of shingles is cut by hash
  into m parts; m exceeds by ``slack`` + 1 the largest symmetric difference that two linked sets
  of the size class can have, so linked sets agree on some part. A key is the content of one
  part, about six shingles, which sets that only share a passage practically never have in
  common (Arasu, Ganti, Kaushik, "Efficient Exact Set-Similarity Joins", 2006).
* Heavy (large) sets are scanned in inverted lists: linked sets share k of their first n - o + k
  shingles in any order common to all, o being the least overlap that size allows; k grows with n, so
  that a shingle or two met by chance are no candidates. The order is by
  hash, but shingles that ``common_from`` or more of the sets of a part of the ids hold come last,
  the commonest at the very end (Chaudhuri, Ganti, Kaushik, "A Primitive Operator for Similarity
  Joins", 2006): a passage that more and more texts quote would else be a list of all of them.

The boundary between light and heavy is the size class at which the cost of both sides
together is least (Deng, Tao, Li, "Overlap Set Similarity Joins with Theoretical Guarantees",
2018): a light set costs its keys, a heavy one its list entries, both the pairs met in them
(small light sets have empty parts, which many sets share). Nothing else decides, whatever the size.

Keys are made from the texts once and move once, to be sorted by key; what holds the key of
another set goes on. Keys that a part of the ids, chosen by hash, shows to be held by
``hot_rows`` sets or more do not move: their holders combine where they are.

Sets that share a key form a bucket. No bucket is expanded into all pairs: each set is
first compared with the hub of its buckets, the member that shares most keys with others,
and linked sets become one component. Only buckets that still hold several components are
looked at again, against a new hub, until the pairs across components that remain are
fewer than ``few`` times the sets in buckets (``least_sets`` at least), so that the work stays in proportion to the
input; these are then compared tile by tile of at most ``tile`` x ``tile`` sets, a bounded number
at a time, by ``MARK_BITS`` bits a set. What these bits allow is listed, and pairs with too few
keys in common fall out. Every candidate pair is thus compared, or its two sets are already
known to be connected.

A pair that is left is compared in two steps. Each set has a bitmap of 2 to 4 bits per shingle, in which a
shingle flips one bit; two bitmaps differ in no more bits than the sets in shingles, so a pair
whose bitmaps differ in more than the threshold allows cannot link. Only the others bring
their whole texts together for the exact count.

Defined results: null text, and text without words, is the empty set, linked with nothing;
with fewer words than a shingle the whole sequence is one shingle; rows that share an id
are one node with the union of their links; rows with a null id get their own n_shingles
and a null component; rows repeat in the output as in the input. Extra columns are
ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import star_components
from ..session import Scratch, materialize, release
from .spans import LOWER, NOT_SPACE, SpanHasher, mix64, text_slices, word_spans


@dataclass(frozen=True)
class Similarity:
    words: int = 3
    percent: int = 90
    #: Ratio of the bounds of a size class.
    step: float = 1.5
    #: Cost of a pair met in an inverted list, in units of a key written and read.
    pair_cost: float = 4.0
    #: Pairs per set that may be compared in tiles, by some 20 ns each.
    few: int = 2_048
    #: Fewer sets than that may have the pairs of so many: it is less work than another hub round.
    least_sets: int = 1 << 17
    tile: int = 1_024
    #: Keys of more sets than that are known before keys are moved.
    hot_rows: int = 1_000_000
    #: Shingles that so many sets of one in ``COUNTED`` ids hold come last in the order of heavy
    #: keys, and how many may. They only order: whatever they are, the links are the same.
    common_from: int = 3
    most_common: int = 1 << 16

    def links(self, overlap, union):
        return 100 * overlap >= self.percent * union

    def largest_partner(self, n: int) -> int:
        return 100 * n // self.percent

    def prefix(self, n: int) -> tuple[int, int]:
        """How many heavy keys a set of n shingles has, and how many of them a linked set has as
        well: in prefixes of n - o + k two sets of overlap o >= k share k. Larger partners want
        more, and the larger of two needs is the one that both meet."""
        least = -(-self.percent * n // 100)
        return n - least + min(least, 1 + self.largest_partner(n) // 50), 1 + n // 50

    def classes(self, limit: int) -> list[int]:
        """Lower bounds of the size classes, from the smallest size at which sets can
        link without being equal."""
        least = next((n for n in range(1, 202) if self.links(n, n + 1)), 1 << 62)
        bounds = [least]
        while bounds[-1] <= limit:
            bounds.append(max(bounds[-1] + 1, math.ceil(bounds[-1] * self.step)))
        return bounds

    def parts(self, low: int, high: int) -> tuple[int, int]:
        """(parts, slack) of the class of sizes low to high - 1."""
        most = 2 * (high - 1) * (100 - self.percent) // (100 + self.percent)
        slack = 1 if most < 20 else max(4, most // 8)
        return most + 1 + slack, slack

    def light_classes(self, bounds: np.ndarray, n: int) -> range:
        """The classes a light set has keys in: its own, and those of its larger partners."""
        if n < bounds[0]:
            return range(0)
        own, last = np.searchsorted(bounds, [n, self.largest_partner(n)], side="right") - 1
        return range(int(own), int(last) + 1)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of whole texts."""

    def __init__(self, words: int):
        self.words, self.hasher = words, SpanHasher()

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        for _, data, offsets in text_slices(column):
            starts, ends, text = word_spans(data, offsets, NOT_SPACE)
            words = self.hasher(LOWER[data], starts, ends)
            bounds = np.searchsorted(text, np.arange(len(offsets)))
            grams = np.zeros(max(len(words) - self.words + 1, 0), dtype=np.uint64)
            for i in range(self.words):
                grams = mix64(grams * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(grams)] + np.uint64(1))
            for first, last in zip(bounds[:-1], bounds[1:], strict=True):
                count = last - first
                if count >= self.words:
                    own = np.sort(grams[first : last - self.words + 1])
                    yield own[np.r_[True, own[1:] != own[:-1]]]  # np.unique takes ten times as long
                elif count:
                    whole = np.array([count], dtype=np.uint64)
                    for at in range(first, last):
                        whole = mix64(whole * np.uint64(0xD6E8FEB86659FD93) + words[at : at + 1])
                    yield whole
                else:
                    yield np.empty(0, np.uint64)


def set_digest(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, the same in any order."""
    a = mix64(grams).sum(dtype=np.uint64) if len(grams) else np.uint64(0)
    b = mix64(grams ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) if len(grams) else np.uint64(0)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def part_keys(grams: np.ndarray, at: int, low: int, high: int, sim: Similarity) -> tuple[np.ndarray, int]:
    """The light keys of a set in the size class number ``at``, and how many of them a linked
    set has as well."""
    parts, slack = sim.parts(low, high)
    mixed = mix64(grams + np.uint64(at + 1))
    part = ((mixed >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    first = np.searchsorted(part[order], np.arange(parts, dtype=np.uint64))
    sums = np.add.reduceat(np.append(mix64(mixed), np.uint64(0))[np.append(order, len(grams))], first)
    sizes = np.diff(np.append(first, len(grams)))
    sums[sizes == 0] = 0
    keys = mix64(sums + np.arange(parts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(at << 40))
    empty = int((sizes == 0).sum())
    # With more empty parts than slack all keys count; a partner with fewer leaves its empty ones out.
    return (keys, 1) if empty > slack else (keys[sizes > 0], slack + 1 - empty)


@dataclass(frozen=True)
class Order:
    """What comes last among shingles: sorted hashes, and the rank of each (larger is later)."""

    last: np.ndarray
    rank: np.ndarray

    def first(self, grams: np.ndarray, many: int) -> np.ndarray:
        """The mixed hashes of the ``many`` first of some shingles."""
        mixed = mix64(grams)
        if not len(self.last):
            return smallest(mixed, many)
        at = np.minimum(np.searchsorted(self.last, grams), len(self.last) - 1)
        late = self.last[at] == grams
        early = mixed[~late]
        if many <= len(early):
            return smallest(early, many)
        mixed, rank = mixed[late], self.rank[at[late]]
        return np.concatenate([early, mixed[np.lexsort((mixed, rank))[: many - len(early)]]])


BY_HASH = Order(np.empty(0, np.uint64), np.empty(0, np.int64))


def smallest(values: np.ndarray, many: int) -> np.ndarray:
    return np.partition(values, many - 1)[:many] if many < len(values) else values


def prefix_keys(grams: np.ndarray, sim: Similarity, order: Order = BY_HASH) -> np.ndarray:
    """The heavy keys: the first shingles of a set."""
    return mix64(order.first(grams, sim.prefix(len(grams))[0]) ^ np.uint64(0xE7037ED1A0B428DB))


def one_id_in(many: int) -> Column:
    own = F.col("doc_id").cast("long")
    return F.coalesce(F.pmod(F.xxhash64(own), F.lit(many)) == 0, F.lit(False))


def common_last(docs: DataFrame, sim: Similarity) -> Order:
    """The order that puts what ``common_from`` of the counted sets hold last, by that number;
    if this is more than ``most_common`` shingles, the ones of larger numbers."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(sim.words)
        for batch in batches:
            for grams in shingle(batch.column("text")):
                if len(grams):
                    yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], ["gram"])

    texts = docs.filter(one_id_in(COUNTED)).select("text").distinct()  # copies are one set
    held = texts.mapInArrow(shingles, "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("k"))
    held = materialize(held.filter(F.col("k") >= sim.common_from), "common")
    left, least = sim.most_common, sim.common_from
    for k, many in sorted(held.groupBy("k").agg(F.count(F.lit(1))).collect(), reverse=True):
        if many > left:
            least = k + 1
            break
        left -= many
    found = held.filter(F.col("k") >= least).toArrow()
    grams, rank = (np.asarray(found.column(c)) for c in ("gram", "k"))
    by_hash = np.argsort(grams.view(np.uint64))
    return Order(grams.view(np.uint64)[by_hash], rank[by_hash])


#: Bits of a set that pairs in tiles are compared by, and such pairs at a time.
MARK_BITS = 512
TILE_PAIRS = 1 << 17

#: Keys that go on together, beside those of the last set.
KEYS_AT_ONCE = 1 << 17

PROBED = 64  # of so many ids one shows its keys before all are made
COUNTED = 32  # and of so many one has its shingles counted


def sketch_sets(docs: DataFrame, sim: Similarity, order: Order = BY_HASH) -> DataFrame:
    """doc_id, n, digest (a, b), bitmaps (bits, mark), number of light keys, a sixteenth of the heavy keys
    (all entries of the lists kept) and, of some ids, all light and heavy keys (parts, probe) of every document."""
    bounds = np.array(sim.classes(1 << 40))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(sim.words)
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            probed = batch.column("probed").to_pylist()
            for grams, probe in zip(shingle(batch.column("text")), probed, strict=True):
                n, none = len(grams), np.empty(0, np.uint64)
                classes = sim.light_classes(bounds, n)
                heavy = prefix_keys(grams, sim, order) if classes else none
                light, probe = ([none], heavy) if probe and classes else ([none], none)
                if len(probe):
                    light = [part_keys(grams, c, int(bounds[c]), int(bounds[c + 1]), sim)[0] for c in classes]
                light = np.concatenate(light)
                count = sum(sim.parts(int(bounds[c]), int(bounds[c + 1]))[0] for c in classes)
                some = heavy[heavy & np.uint64(15) == 0]
                maps = (parity_bits(grams), parity_bits(grams, MARK_BITS)) if n else (None, None)
                lists = [x.view(np.int64) for x in (some, light, probe)]
                row = (n, *set_digest(grams), count, *lists, *maps)
                for store, value in zip(out, row, strict=True):
                    store.append(value)
            arrays = [pa.array(x, pa.int64()) for x in out[:4]] + [int_lists(x) for x in out[4:7]]
            arrays += [pa.array(x, pa.binary()) for x in out[7:]]
            names = ["doc_id", "n", "a", "b", "light", "heavy", "parts", "probe", "bits", "mark"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names)

    schema = "doc_id long, n long, a long, b long, light long, heavy array<long>, parts array<long>, probe array<long>, "
    schema += "bits binary, mark binary"
    own = F.col("doc_id").cast("long").alias("doc_id")
    return docs.select(own, "text", one_id_in(PROBED).alias("probed")).mapInArrow(sketched, schema)


def int_lists(values: list[np.ndarray]) -> pa.Array:
    bounds = np.cumsum([0, *map(len, values)])
    flat = np.concatenate([np.empty(0, np.int64), *values])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int64()))


def boundary(sets: DataFrame, sim: Similarity) -> int:
    """The size from which sets are heavy, by the counted cost of every class on both sides."""
    largest = sets.agg(F.max("n")).first()[0] or 0
    bounds = sim.classes(largest)
    size_class = F.lit(0)
    for i, low in enumerate(bounds):
        size_class = F.when(F.col("n") >= low, F.lit(i)).otherwise(size_class)
    sized = sets.filter(F.col("n") >= bounds[0]).select(size_class.alias("class"), "light", "heavy", "parts")
    light = {r[0]: r[1] for r in sized.groupBy("class").agg(F.sum("light")).collect()}

    def lengths(keys: str) -> DataFrame:
        lists = sized.select("class", F.explode(keys).alias("key"))
        return lists.groupBy("class", "key").agg(F.count(F.lit(1)).cast("double").alias("entries"))

    # List lengths from the keys of one in 16 lists, all entries of each of these lists.
    pairs = F.col("entries") * (F.col("entries") - 1) / 2 * sim.pair_cost
    cost = F.sum(F.col("entries") + pairs)
    heavy = {r[0]: 16 * r[1] for r in lengths("heavy").groupBy("class").agg(cost).collect()}
    # Both sets of a pair are probed in one of PROBED * PROBED cases.
    met = lengths("parts").groupBy("class").agg(F.sum(pairs))
    for c, some in met.collect():
        light[c] += PROBED * PROBED * some
    totals = [
        sum(light.get(c, 0) for c in range(x)) + sum(heavy.get(c, 0) for c in range(x, len(bounds)))
        for x in range(len(bounds) + 1)
    ]
    best = min(range(len(totals)), key=lambda x: (totals[x], -x))  # light if equal
    return bounds[best] if best < len(bounds) else 1 << 62


def key_rows(docs: DataFrame, heavy_from: int, sim: Similarity, order: Order = BY_HASH) -> DataFrame:
    """(key, a, id, n, class, need): every key of every set; ``need`` of its keys of that
    class a set shares with each set it links to. Heavy keys are class -1."""
    bounds = np.array(sim.classes(1 << 40))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(sim.words)
        for batch in batches:
            keys, rows, waiting = [], [], 0
            for doc_id, grams in zip(batch.column("id").to_pylist(), shingle(batch.column("text")), strict=True):
                n = len(grams)
                found = []
                if n < heavy_from:
                    classes = sim.light_classes(bounds, n)
                    found = [(*part_keys(grams, c, int(bounds[c]), int(bounds[c + 1]), sim), c) for c in classes]
                # A light set that may link to a heavy one has entries in the lists as well.
                if n >= bounds[0] and sim.largest_partner(n) >= heavy_from:
                    found.append((prefix_keys(grams, sim, order), sim.prefix(n)[1], -1))
                digest = set_digest(grams)[0] if found else 0
                for own, need, c in found:
                    keys.append(own)
                    rows.append((digest, doc_id, n, c, need))
                    waiting += len(own)
                if waiting >= KEYS_AT_ONCE:
                    yield flat(keys, rows)
                    keys, rows, waiting = [], [], 0
            if keys:
                yield flat(keys, rows)

    def flat(keys: list[np.ndarray], rows: list[tuple]) -> pa.RecordBatch:
        sizes = [len(k) for k in keys]
        columns = np.repeat(np.array(rows, dtype=np.int64).reshape(-1, 5), sizes, axis=0).T
        types = pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()
        arrays = [pa.array(np.concatenate(keys).view(np.int64))]
        arrays += [pa.array(x.astype(t.to_pandas_dtype())) for x, t in zip(columns, types)]
        return pa.RecordBatch.from_arrays(arrays, ["key", "a", "id", "n", "class", "need"])

    named = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter(F.col("id").isNotNull())
    return named.mapInArrow(made, "key long, a long, id long, n int, class int, need int")


def several_holders(rows: DataFrame) -> DataFrame:
    """The rows whose key several sets hold, one per key and set: that of the smallest id.

    Rows come sorted by key, set and id and stream through; of a key's sets only the first
    waits for a second."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_set = waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, own = (np.asarray(batch.column(c)) for c in ("key", "a"))
            new_key = np.r_[last_key is None or key[0] != last_key, key[1:] != key[:-1]]
            new_set = new_key | np.r_[last_set is None or own[0] != last_set, own[1:] != own[:-1]]
            at = np.flatnonzero(new_set)  # the first row of every set of a key
            heads = np.flatnonzero(new_key[at])
            second = np.zeros(len(at) + 1, dtype=bool)
            second[:-1] = ~new_key[at]
            keep = second[:-1] | (new_key[at] & second[1:])
            out = [batch.take(pa.array(at[keep]))]
            if len(at) and second[0] and waiting is not None:
                out.insert(0, waiting)
            # The last set's row waits if its key has no other set so far.
            if len(at):
                waiting = batch.slice(int(at[-1]), 1) if len(heads) and heads[-1] == len(at) - 1 else None
            last_key, last_set = key[-1], own[-1]
            yield from (b for b in out if b.num_rows)

    return rows.mapInArrow(kept, rows.schema)


def shared_keys(docs: DataFrame, sets: DataFrame, heavy_from: int, sim: Similarity, order: Order) -> DataFrame:
    """(key, id, n, class, need, c): the keys that c > 1 sets hold, with their holders, of the
    sets that share enough keys for a link."""
    probe = sets.select(F.explode(F.concat("parts", "probe")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("k"))
    # At most rows / hot_rows keys, give or take what the choice of ids does.
    hot = materialize(probe.filter(F.col("k") >= max(1, sim.hot_rows // PROBED)).select("key", F.lit(True).alias("hot")), "hot")
    rows = key_rows(docs, heavy_from, sim, order)
    if hot.isEmpty():
        moved = several_holders(rows.repartition("key").sortWithinPartitions("key", "a", "id"))
    else:
        marked = rows.join(F.broadcast(hot), "key", "left")
        cold = marked.filter(F.col("hot").isNull()).drop("hot")
        cold = several_holders(cold.repartition("key").sortWithinPartitions("key", "a", "id"))
        own = [F.min("id").alias("id"), *[F.max(c).alias(c) for c in ("n", "class", "need")]]
        moved = cold.unionByName(marked.filter("hot").groupBy("key", "a").agg(*own))
    return several_sets(enough_keys(materialize(moved.drop("a"), "keys")))


def enough_keys(buckets: DataFrame) -> DataFrame:
    """The rows of (key, id, n, class, need) of the sets that have ``need`` of them in a class:
    with fewer a set links to no other of these. Sets of one id and size count together."""
    counted = buckets.groupBy("id", "n", "class").agg(F.count(F.lit(1)).alias("k"), F.min("need").alias("least"))
    enough = counted.filter(F.col("k") >= F.col("least")).select("id", "n", "class")
    return buckets.join(enough, ["id", "n", "class"], "left_semi").select(*buckets.columns)


def several_sets(buckets: DataFrame) -> DataFrame:
    """The rows of keys that c > 1 sets hold, with that number."""
    rows = materialize(buckets, "rest")
    common = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1)
    return rows.join(common, "key")


def similar_sizes(a: Column, b: Column, sim: Similarity) -> Column:
    return 100 * F.least(a, b) >= sim.percent * F.greatest(a, b)


def parity_bits(grams: np.ndarray, size: int | None = None) -> bytes:
    """A bit per residue of the shingles: whether an odd number of them have it."""
    size = size or max(64, 1 << (2 * len(grams) - 1).bit_length())
    flips = np.bincount((grams >> np.uint64(7)).astype(np.int64) & (size - 1), minlength=size)
    return np.packbits((flips & 1).astype(np.uint8)).tobytes()


def folded(bitmaps: list[bytes]) -> np.ndarray:
    """The bitmaps as rows of 64-bit words; longer ones are folded to the shortest."""
    size = min(map(len, bitmaps))
    return np.stack(
        [np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, size // 8), axis=0) for x in bitmaps]
    )


def parity_distance(a: bytes, b: bytes) -> int:
    """At most the size of the symmetric difference of the two sets."""
    x, y = folded([a, b])
    return int(np.bitwise_count(x ^ y).sum())


def pairs_with(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (id, other) with the first column of both sets as x and y, a second as n, m."""
    left = sets.select("id", *[F.col(c).alias(x) for c, x in zip(columns, "xn")])
    right = sets.select(F.col("id").alias("other"), *[F.col(c).alias(y) for c, y in zip(columns, "ym")])
    return pairs.select("id", "other").join(left, "id").join(right, "other")


@dataclass(frozen=True)
class Held:
    """What pairs are compared by: marks (id, n, bits, mark) and texts (id, text), a row of each
    for every set of an id."""

    marks: DataFrame
    texts: DataFrame


def linked_pairs(pairs: DataFrame, held: Held, sim: Similarity) -> DataFrame:
    """The pairs (id, other) that link, by bitmaps and then by whole sets."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("n")) + np.asarray(batch.column("m"))
            most = sizes * (100 - sim.percent) // (100 + sim.percent)
            bits = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
            keep = np.fromiter((parity_distance(x, y) for x, y in bits), np.int64, batch.num_rows) <= most
            yield batch.select(["id", "other"]).filter(pa.array(keep))

    schema = "id long, other long"
    likely = materialize(pairs_with(pairs, held.marks, "bits", "n").mapInArrow(near, schema), "likely")
    return likely if likely.isEmpty() else exact_pairs(likely, held.texts, sim)


def exact_pairs(pairs: DataFrame, texts: DataFrame, sim: Similarity) -> DataFrame:
    """The pairs (id, other) that link, by their whole sets, made anew from the texts: a
    text in a shuffle takes about a third of the bytes of its shingle hashes."""

    def equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(sim.words)
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(shingle(batch.column("x")), shingle(batch.column("y")), strict=True)):
                overlap = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = sim.links(overlap, len(x) + len(y) - overlap)
            yield batch.select(["id", "other"]).filter(pa.array(keep))

    return pairs_with(pairs, texts, "text").mapInArrow(equal, "id long, other long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of ``edges`` (id, other) that are not the smallest."""
    ordered = edges.select(F.least("id", "other").alias("lo"), F.greatest("id", "other").alias("hi")).distinct()
    return star_components(ordered.filter("lo < hi")).select(F.col("hi").alias("id"), F.col("lo").alias("component"))


def joined_components(links: DataFrame, rows: DataFrame) -> DataFrame:
    """(component, joined): the components of ``rows`` (id, component) that ``links`` (id, other) put
    into one with a smaller id. Links are edges between components, so only new ones are labelled."""
    own = rows.select("id", "component").distinct()
    met = links.join(own.select("id", F.col("component").alias("x")), "id")
    met = met.join(own.select(F.col("id").alias("other"), F.col("component").alias("y")), "other")
    label = components(met.select(F.col("x").alias("id"), F.col("y").alias("other")))
    return label.select(F.col("id").alias("component"), F.col("component").alias("joined"))


def connect(buckets: DataFrame, held: Held, sim: Similarity) -> DataFrame:
    """Edges (id, other) that connect all sets linked in the buckets (key, id, n, class, need, c)."""
    spark = buckets.sparkSession
    popularity = materialize(buckets.groupBy("id").agg(F.sum("c").alias("weight")), "popularity")
    current = materialize(buckets.join(popularity, "id"), "buckets").withColumn("component", F.col("id"))
    edges, sets = spark.createDataFrame([], "id long, other long"), popularity.count()
    # The links of every round are a table of their own: none is written or labelled twice.
    for turn in count():
        if current.isEmpty():
            return edges
        if turn:
            inner = current.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"))
            sizes = inner.groupBy("key").agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("q"))
            total = sizes.agg(F.sum("s"), F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()
            if total[1] is None or total[1] <= sim.few * max(sets, sim.least_sets):
                break
        # The hub of a bucket: the set of most shared keys not yet a hub; ties to the smaller id.
        hubs = current.groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"), "n", "component")).alias("h"))
        hubs = hubs.select("key", (-F.col("h.minus")).alias("other"), F.col("h.n").alias("hub_n"), F.col("h.component").alias("hub_component"))
        hubs = materialize(hubs, "hubs")
        met = current.join(hubs, "key").filter(F.col("component") != F.col("hub_component"))
        met = met.filter(similar_sizes(F.col("n"), F.col("hub_n"), sim))
        pairs = met.groupBy("id", "other").agg(F.count(F.lit(1)).alias("shared"))
        if not turn:  # first, every set meets only the hub it shares most keys with
            best = pairs.groupBy("id").agg(F.max(F.struct("shared", (-F.col("other")).alias("minus"))).alias("b"))
            pairs = best.select("id", (-F.col("b.minus")).alias("other"))
        links = materialize(linked_pairs(pairs, held, sim), "links")
        # Later rounds have compared every member with the hub of its bucket, which leaves it.
        rest = current.join(hubs.select("key", "other"), "key").filter(F.col("id") != F.col("other")) if turn else current
        rest = rest.drop("other")
        if not links.isEmpty():
            edges = edges.unionByName(links)
            rest = rest.join(joined_components(links, current), "component", "left")
            rest = rest.withColumn("component", F.coalesce("joined", "component")).drop("joined")
        rest = materialize(rest, "rest")
        # Sets that still link to another component share all keys that takes in mixed buckets.
        last, current = current, materialize(mixed_buckets(enough_keys(mixed_buckets(rest))), "buckets")
        release(hubs, rest, last)
    # Marks grow with the input, so they are never broadcast.
    marked = current.join(held.marks.select("id", "n", "mark").hint("merge"), ["id", "n"])
    return edges.unionByName(linked_pairs(materialize(pairs_in_tiles(marked, sim), "pairs"), held, sim))


def mixed_buckets(buckets: DataFrame) -> DataFrame:
    """The rows of the keys that several components hold."""
    mixed = buckets.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    return buckets.join(mixed.filter(F.col("x") != F.col("y")).select("key"), "key", "left_semi")


def tiled_rows(buckets: DataFrame, sim: Similarity) -> DataFrame:
    """key, id, n, component, block, low, high: the rows of every tile (low, high).

    The largest component of a bucket above ``tile`` rows has blocks of its own, after the
    others', which face the blocks of the others only: rows are made in proportion to
    the pairs across components."""
    parts = buckets.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"))
    parts = parts.groupBy("key").agg(F.sum("k").alias("all"), F.max(F.struct("k", "component")).alias("top"))
    own = [c for c in ("class", "need", "mark") if c in buckets.columns]
    rows = buckets.select("key", "id", "n", "component", *own).join(parts, "key").filter(F.col("all") > F.col("top.k"))
    large = F.col("all") > sim.tile
    main = large & (F.col("component") == F.col("top.component"))
    others = F.when(large, F.ceil((F.col("all") - F.col("top.k")) / sim.tile)).otherwise(1).cast("int")
    mains = F.when(large, F.ceil(F.col("top.k") / sim.tile)).otherwise(0).cast("int")
    rows = rows.select("key", "id", "n", "component", *own, main.alias("main"), others.alias("others"), mains.alias("mains"))
    number = F.xxhash64("id")
    block = F.when(F.col("main"), F.col("others") + F.pmod(number, F.col("mains"))).otherwise(F.pmod(number, F.col("others")))
    last = F.when(F.col("main"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    rows = rows.withColumn("block", block.cast("int")).withColumn("facing", F.explode(F.sequence(F.lit(0), last)))
    tile = [F.least("block", "facing").alias("low"), F.greatest("block", "facing").alias("high")]
    return rows.select("key", "id", "n", "component", *own, "block", *tile)


def facing_rows(first: np.ndarray, low: np.ndarray, high: np.ndarray, block: np.ndarray, parts: np.ndarray):
    """Row numbers (i, j) of every pair of the tiles with bounds ``first``, about ``TILE_PAIRS``
    at a time; rows of a tile come by block. Tiles of one component have none."""
    starts, sizes, rows = first[:-1], np.diff(first), np.arange(first[-1])
    lower = block == low
    split = np.repeat(starts + np.add.reduceat(lower.astype(np.int64), starts), sizes)
    mixed = np.minimum.reduceat(parts, starts) != np.maximum.reduceat(parts, starts)
    # A row of the lower block faces all of the higher one; in a block, all that follow.
    begin = np.where(low == high, rows + 1, split)
    many = np.where(lower & np.repeat(mixed, sizes), np.repeat(first[1:], sizes) - begin, 0)
    before = np.r_[0, np.cumsum(many)]
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(before, before[at] + TILE_PAIRS, side="right")) - 1)
        i, each = np.repeat(rows[at:to], many[at:to]), many[at:to]
        yield i, np.arange(len(i)) + np.repeat(begin[at:to] - (before[at:to] - before[at]), each)
        at = to


def pairs_in_tiles(buckets: DataFrame, sim: Similarity) -> DataFrame:
    """The pairs (id, other) of two components that share enough keys and that sizes and marks
    allow.

    A bucket above ``tile`` rows is dealt into blocks, and pairs of blocks are tiles. A pair
    comes from every bucket that holds both, so the times it comes are its common keys."""
    rows = tiled_rows(buckets, sim)
    rows = rows.select("key", "low", "high", "block", "id", "n", "component", "class", "need", "mark")
    rows = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            tiles = np.stack([np.asarray(table.column(c)).astype(np.int64) for c in ("key", "low", "high")])
            first = np.flatnonzero(np.r_[True, (tiles[:, 1:] != tiles[:, :-1]).any(axis=0)])
            yield from compared(table, first)  # all but the last tile, which may go on
            held = table.slice(int(first[-1]))
        if held is not None and held.num_rows:
            yield from compared(held, np.array([0, held.num_rows]))

    def compared(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(first) < 2:
            return
        table = table.slice(0, int(first[-1]))
        low, high, block, ids, sizes, parts, kinds, needs = (
            np.asarray(table.column(c)).astype(np.int64)
            for c in ("low", "high", "block", "id", "n", "component", "class", "need")
        )
        marks = np.frombuffer(b"".join(table.column("mark").to_pylist()), np.uint64).reshape(-1, MARK_BITS // 64)
        for i, j in facing_rows(first, low, high, block, parts):
            n, m = sizes[i], sizes[j]
            ok = (parts[i] != parts[j]) & (100 * np.minimum(n, m) >= sim.percent * np.maximum(n, m))
            i, j, most = i[ok], j[ok], (n + m)[ok] * (100 - sim.percent) // (100 + sim.percent)
            ok = np.bitwise_count(marks[i] ^ marks[j]).sum(axis=1, dtype=np.int64) <= most
            i, j = i[ok], j[ok]
            if len(i):
                pair = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
                arrays = [*pair, kinds[i], np.maximum(needs[i], needs[j])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["id", "other", "class", "need"])

    met = rows.mapInArrow(compare, "id long, other long, class long, need long").groupBy("id", "other", "class")
    # The sets of one id have needs of their own: the least holds for all.
    met = met.agg(F.count(F.lit(1)).alias("k"), F.min("need").alias("need")).filter(F.col("k") >= F.col("need"))
    return met.select("id", "other").distinct()


def ngram_components(docs: DataFrame, sim: Similarity = Similarity()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) of every row.

    Runs jobs; the result is a scratch table, those before it are deleted."""
    with Scratch(docs.sparkSession) as scratch:
        rows = components_of(docs, sim)
    rows = materialize(rows, "ngram_components")
    scratch.drop()
    return rows


def components_of(docs: DataFrame, sim: Similarity) -> DataFrame:
    order = common_last(docs, sim)
    sets = materialize(sketch_sets(docs, sim, order), "sets")
    some = sets.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # Nodes are distinct sets, named by the smallest id that holds them.
    nodes = materialize(some.groupBy("a", "b").agg(F.min("doc_id").alias("id")), "nodes")
    holders = some.filter(F.col("n") >= sim.classes(0)[0]).withColumnRenamed("doc_id", "id")
    holders = holders.join(nodes, ["id", "a", "b"], "left_semi")
    # Keys are those of all rows, copies included; what several sets share names nodes only.
    buckets = shared_keys(docs, holders, boundary(holders, sim), sim, order).join(nodes.select("id"), "id", "left_semi")
    buckets = materialize(buckets, "shared")
    marks = holders.join(buckets.select("id").distinct(), "id", "left_semi")
    marks = materialize(marks.groupBy("id", "n", "a", "b").agg(F.first("bits").alias("bits"), F.first("mark").alias("mark")), "marks")
    # The same join at every size: wanted ids grow with the input, so they are never broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    texts = texts.join(marks.select("id", "a", "b").hint("merge"), "id")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Only the text whose set is the node's; ids may repeat with other texts."""
        shingle = Shingler(sim.words)
        for batch in batches:
            digests = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
            keep = [set_digest(g) == d for g, d in zip(shingle(batch.column("text")), digests, strict=True)]
            yield batch.select(["id", "a", "b", "text"]).filter(pa.array(keep, pa.bool_()))

    texts = texts.select("id", "a", "b", "text").mapInArrow(own, "id long, a long, b long, text string")
    texts = texts.groupBy("id", "a", "b").agg(F.first("text").alias("text"))  # repeated rows count once
    held = Held(marks, materialize(texts, "texts"))
    links = connect(buckets, held, sim).unionByName(same_ids(some, nodes))
    label = materialize(components(materialize(links, "links")), "components")
    return result_rows(sets, nodes, label)


def same_ids(some: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, other) between the nodes of rows that share an id but not a set."""
    shared = some.groupBy("doc_id").agg(F.min("a").alias("x"), F.max("a").alias("y")).filter(F.col("x") != F.col("y"))
    held = some.select("doc_id", "a", "b").join(shared.select("doc_id"), "doc_id").join(nodes, ["a", "b"])
    return held.select(F.col("doc_id").alias("id"), F.col("id").alias("other"))


def result_rows(sets: DataFrame, nodes: DataFrame, label: DataFrame) -> DataFrame:
    named = nodes.join(label, "id", "left").select("a", "b", F.coalesce("component", "id").alias("component"))
    rows = sets.select("doc_id", "n", "a", "b").join(named, ["a", "b"], "left")
    own = (F.col("n") == 0) | F.col("doc_id").isNull()
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(own, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    )
