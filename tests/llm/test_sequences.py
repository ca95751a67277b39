"""Benchmark decontamination, period runs, centroid clustering."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.llm import decontamination, lloyd, period_runs
from corpuscope.llm.decontamination import Limits
from corpuscope.llm.lloyd import Lloyd
from corpuscope.llm.period_runs import Periods
from corpuscope.llm.queries import QUERIES
from corpuscope.sources.tables import read_table

# --- period runs


def plain_runs(words, least=24, exponent=3):
    """All runs, by the definition: every period, word by word."""
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, exponent * q):
                s = words[i : i + size]
                if all(s[d:] != s[:-d] for d in range(1, q)):
                    found.append((i, size, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def periodic_words(rng, n):
    words = [rng.choice("abcdefghij"[: rng.choice([1, 2, 3, 10])]) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 40:
            q, a = rng.randint(1, n // 3), rng.randrange(n)
            for i in range(a + q, min(n, a + rng.randint(2 * q, 5 * q))):
                words[i] = words[i - q]
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_those_of_the_definition(seed):
    rng = random.Random(seed)
    for _ in range(30):
        texts = [periodic_words(rng, rng.choice([0, 1, 23, 24, 25, 60, 150, 400])) for _ in range(rng.randint(1, 5))]
        numbers = np.array([ord(w) for t in texts for w in t], dtype=np.int32)
        got = period_runs.runs_of(numbers, np.array([len(t) for t in texts], dtype=np.int64))
        assert [tuple(r) for r in got.tolist()] == [(d, *r) for d, t in enumerate(texts) for r in plain_runs(t)]


def test_every_period_up_to_some_hundred_is_found():
    for q in range(1, 400):
        rng = np.random.default_rng(q)
        size = max(24, 3 * q) + q % 3
        words = np.concatenate([[-1], np.resize(rng.permutation(q), size), [-2]]).astype(np.int32)
        runs = period_runs.runs_of(words, np.array([len(words)]))
        assert runs.tolist() == [[0, 1, size, q]], q


def test_a_text_of_one_word_a_million_times_is_quick():
    runs = period_runs.runs_of(np.zeros(1_000_000, dtype=np.int32), np.array([1_000_000]))
    assert runs.tolist() == [[0, 0, 1_000_000, 1]]


def test_find_runs_on_odd_rows(spark):
    rng = random.Random(7)
    texts = [" ".join(periodic_words(rng, 200)) for _ in range(40)]
    texts += [None, "", " \t\n\x0b\x0c\r ", "one", "ä ö " * 20, "a a " * 30, "x\n" * 24, "ab\tab " + "ab " * 30]
    texts += ["wort " * 200_000, texts[0], texts[0]]
    rows = [(i if i % 7 else None, t, "kept", "gone") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, runs string").repartition(3)
    got = period_runs.find_runs(docs)
    assert got.columns == ["doc_id", "text", "source", "runs", "collapsed"]
    found = got.collect()
    assert len(found) == len(rows) and {r.source for r in found} == {"kept"}
    for r in found:
        words = re.findall("[^\x20\x09-\x0d]+", r.text or "")
        if len(words) > 100_000:
            assert [tuple(x) for x in r.runs] == [(0, 200_000, 1)] and r.collapsed == "wort"
            continue
        want = plain_runs(words)
        assert [tuple(x) for x in r.runs] == want
        assert r.collapsed == (None if r.text is None else plain_collapsed(words, want))
    assert period_runs.find_runs(docs.limit(0)).count() == 0


def test_other_bounds():
    words = np.array([1, 2, 3] * 4, dtype=np.int32)
    assert period_runs.runs_of(words, np.array([12]), Periods(least_length=12)).tolist() == [[0, 0, 12, 3]]
    assert period_runs.runs_of(words, np.array([12]), Periods(least_length=13)).tolist() == []
    long = np.tile(np.arange(20, dtype=np.int32), 5)
    assert period_runs.runs_of(long, np.array([100]), Periods(least_exponent=5)).tolist() == [[0, 0, 100, 20]]
    assert period_runs.runs_of(long, np.array([100]), Periods(least_exponent=6)).tolist() == []


def plain_digest(doc_id, text):
    """The result columns of op12, from the words on."""
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    hashes = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, plain_collapsed(words, runs))]
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *hashes)


def test_op12_query_on_small_texts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(periodic_words(rng, rng.choice([1, 5, 30, 120, 300]))) + rng.choice(["", " ", "\n\n"])) for i in range(150)]
    rows += [(None, "a b " * 30), (160, None), (161, ""), (162, " \n "), (5, rows[5][1]), (-3, "q " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_period_runs"](spark, str(tmp_path)).collect()
    names = "n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert sorted(repr((r.doc_id, *(r[n] for n in names))) for r in got) == sorted(
        repr((i, *plain_digest(i, t))) for i, t in rows
    )
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5


# --- decontamination


def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def plain_hits(text, items, window):
    words, hit, found = plain_words(text), set(), set()
    for item, other in items:
        w = plain_words(other)
        size = min(window, len(w))
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1) if w else ():
            if tuple(words[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                found.add(item)
    return len(words), len(hit), sorted(x for x in found if x is not None)


@pytest.mark.parametrize("block_words", [250_000, 40])
def test_hits_are_those_of_all_windows(spark, block_words):
    rng = random.Random(block_words)
    vocabulary = ["wa", "Wb", "wc", "über", "d1"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))

    items = [(i if i % 9 else None, text(rng.choice([0, 1, 2, 3, 4, 5, 9, 30]))) for i in range(40)]
    items = [(i, t) for i, t in items if len(plain_words(t)) not in (1, 2)] + [(3, "wa wa Wb"), (3, "wa wa Wb"), (50, None)]
    texts = [text(rng.choice([0, 1, 3, 10, 40])) for _ in range(150)]
    texts += ["x " * 20 + items[7][1] + " x" * 20, None, "", "!?", texts[4], texts[4], items[8][1] * 30]
    rows = [(i if i % 10 else None, t, "mine", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, n_hit int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    limits = Limits(words=4, coverage=0.5, block_words=block_words)
    got = decontamination.decontaminate(docs, bench, limits)
    assert got.columns == ["doc_id", "text", "words", "n_words", "n_hit", "spans", "items", "cleaned"]
    found = got.collect()
    assert len(found) == len(rows) and {r.words for r in found} == {"mine"}
    for r in found:
        n, hit, ids = plain_hits(r.text, items, 4)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, sorted(set(ids)))
        assert sum(s.end - s.start for s in r.spans) == hit
        if r.text is None:
            assert r.cleaned is None
        elif hit > 0.5 * n:
            assert r.cleaned == ""
        else:
            inside = {i for s in r.spans for i in range(s.start, s.end)}
            assert plain_words(r.cleaned) == [w for i, w in enumerate(plain_words(r.text)) if i not in inside]
    assert sum(r.n_hit > 0 for r in found) > 20
    assert decontamination.decontaminate(docs.limit(0), bench, limits).count() == 0
    clean = decontamination.decontaminate(docs, bench.limit(0), limits)
    assert clean.filter("n_hit > 0 or cleaned <> text").count() == 0


def test_items_longer_than_a_piece_and_very_long_texts(spark):
    rng = random.Random(1)
    item = [f"w{rng.randrange(10_000)}" for _ in range(3 * decontamination.PIECE_WORDS + 5)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    pieces = decontamination.item_pieces(bench, Limits()).collect()
    assert max(len(r["words"]) for r in pieces) <= decontamination.PIECE_WORDS + 10
    filler = "nothing here " * 200_000
    cut = decontamination.PIECE_WORDS
    docs = [(i, filler + " ".join(item[at : at + 10]) + " " + filler) for i, at in enumerate([0, cut - 5, cut, 2 * cut - 9, len(item) - 10])]
    docs.append((9, filler + " ".join(item[5:14]) + " end"))
    found = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench, Limits(block_words=1_500))
    assert {r.doc_id: r.n_hit for r in found.select("doc_id", "n_hit").collect()} == {0: 10, 1: 10, 2: 10, 3: 10, 4: 10, 9: 0}


# --- clustering


def plain_lloyd(rows, p):
    kept = []
    for vec_id, vector in rows:
        if vector is not None and len(vector) == p.dimensions and all(x is not None and np.isfinite(x) for x in vector):
            key = None if vec_id is None else hashlib.sha256(f"{p.salt}{vec_id}".encode()).hexdigest()
            kept.append((vec_id, key, [int(np.floor(x * p.scale)) for x in vector]))
    kept.sort(key=lambda r: (r[1] is None, r[1] or "", r[2]))
    centers = [v for _, _, v in kept[: p.clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers))

    for _ in range(p.rounds):
        own = [nearest(v)[1] for _, _, v in kept]
        for n in range(len(centers)):
            mine = [v for (_, _, v), o in zip(kept, own) if o == n]
            if mine:
                centers[n] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *nearest(v)) for i, _, v in kept]
    sizes = {}
    for _, d, n in last:
        sizes[n] = sizes.get(n, 0) + d
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(repr((i, n, d, sizes[n], sum(sizes.values()), digests[n])) for i, d, n in last)


def clustered(spark, rows, p, parts=3):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
    names = "vec_id cluster distance cluster_inertia inertia centroid_sha256".split()
    got = lloyd.cluster_vectors(vectors.withColumn("cluster", F.lit("clash")).withColumn("block", F.lit(1)), p)
    return sorted(repr(tuple(r[n] for n in names)) for r in got.collect())


def test_clusters_are_those_of_plain_rounds(spark):
    rng = np.random.default_rng(5)
    p = Lloyd(clusters=6, rounds=3, dimensions=5, block_columns=2, chunk_rows=7)
    rows = [(i, rng.normal(0, 1, 5).tolist()) for i in range(60)]
    rows += [(7, [0.0] * 5), (7, [1.0] * 5), (7, [1.0] * 5), (None, [0.5] * 5), (None, [-0.5] * 5)]
    rows += [(70, None), (71, [1.0] * 4), (72, [1.0, None, 1.0, 1.0, 1.0]), (73, [float("nan")] * 5), (74, [float("inf")] * 5), (75, [])]
    assert clustered(spark, rows, p) == plain_lloyd(rows, p)


def test_fewer_vectors_than_clusters_large_numbers_and_ties(spark):
    p = Lloyd(clusters=6, rounds=2, dimensions=3, block_columns=2, chunk_rows=2)
    few = [(1, [1.0, 2.0, 3.0]), (2, [-1e5, 2e5, 3e5]), (3, [5e5, -5e5, 1.0]), (3, [5e5, -5e5, 1.0])]
    assert clustered(spark, few, p) == plain_lloyd(few, p)
    same = [(i, [0.25, 0.25, 0.25]) for i in range(30)]  # all centroids equal: the first takes all
    assert clustered(spark, same, p) == plain_lloyd(same, p)
    assert clustered(spark, [(1, None)], p) == []


def test_partial_distances_are_exact_on_both_paths():
    rng = np.random.default_rng(2)
    for peak in (200, 1 << 26):
        rows, centers = rng.integers(-peak, peak, (9, 4)), rng.integers(-peak, peak, (5, 4))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c)) for c in centers] for r in rows]
        assert lloyd.partial_distances(rows, centers).tolist() == want
    odd = np.array([[0, -5], [3, 1 << 40]])
    assert lloyd.unpacked(lloyd.packed(odd), 2, 2).tolist() == odd.tolist()


def test_op13_gives_a_row_per_vector(spark):
    folder = "/root/testdata/sf0.001"
    rows = QUERIES["op13_sharded_lloyd"](spark, folder).count()
    assert rows == read_table(spark, folder, "embeddings").count()
