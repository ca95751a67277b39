"""Exact groups, n-gram components, line spread: against brute force on literal tables."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuscope.llm import exact_dedup, line_dedup, ngram_join
from corpuscope.llm.exact_dedup import CountingQuotientFilter

DOCS = "doc_id long, text string, source string, keep_id string, n string, removed string"


def table(spark, rows):
    """Rows of (doc_id, text[, source]); three extra columns bear names of results."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "s", "x", "y", "z") for r in rows]
    return spark.createDataFrame(full, DOCS)


def upper_folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeéö") for _ in range(rng.randint(2, 7))) for _ in range(words))


EDGES = [
    (1, None),
    (2, ""),
    (3, "Same Text"),
    (4, "same text"),
    (5, "SAME TEXT"),
    (5, "SAME TEXT"),
    (6, "same text "),
    (7, "É"),
    (8, "é"),
    (None, "same text"),
    (None, "only a null id"),
    (9, prose(1, 60_000)),
    (10, prose(1, 60_000).upper().lower()),
]


def test_quotient_filters_merge_losslessly():
    rng = np.random.default_rng(3)
    values = rng.integers(-(2**63), 2**63 - 1, 5_000)
    values = np.concatenate([values, values[:700], values[:20], np.array([0, 0, -1, -1, 5])])
    parts = [CountingQuotientFilter.build(p, 12) for p in np.array_split(rng.permutation(values), 7)]
    pieces = defaultdict(list)
    for part in parts:
        for i, piece in part.cut(16):
            pieces[i].append(CountingQuotientFilter.load(piece.dump(), 12))
    found = np.concatenate([CountingQuotientFilter.merge(x).repeated() for x in pieces.values()])
    distinct, counts = np.unique(values, return_counts=True)
    assert sorted(found) == sorted(distinct[counts > 1])
    assert sum(x.counts.sum() for x in map(CountingQuotientFilter.merge, pieces.values())) == len(values)


def test_exact_groups(spark):
    got = [r.asDict() for r in exact_dedup.exact_groups(table(spark, EDGES)).collect()]
    assert len(got) == len(EDGES)
    groups = defaultdict(list)
    for doc_id, text in EDGES:
        groups[upper_folded(text)].append(doc_id)
    want = []
    for doc_id, text in EDGES:
        same = groups[upper_folded(text)]
        keep = max((x for x in same if x is not None), default=None)
        sha = hashlib.sha256(upper_folded(text).encode()).hexdigest()
        want.append((doc_id, keep, len(same), doc_id == keep, sha))
    key = lambda r: tuple(map(str, r))
    have = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got]
    assert sorted(have, key=key) == sorted(want, key=key)
    assert {r["n"] for r in got} == {"y"}


def test_exact_groups_verify_bytes_when_fingerprints_collide(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    got = exact_dedup.exact_groups(table(spark, EDGES[:9])).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {
        (1, 2, 2), (2, 2, 2), (3, 5, 4), (4, 5, 4), (5, 5, 4), (6, 6, 1), (7, 7, 1), (8, 8, 1)
    }


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", upper_folded(text))


def shingles(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    ids = [i for i, _ in rows]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(ids[i]), find(ids[j])))
                parent[b] = a
    return sorted((i, len(s), find(i)) for i, s in zip(ids, sets, strict=True))


def near_copies(seed, groups=12, copies=9):
    rng = random.Random(seed)
    rows, shared = [], prose(99, 60)
    for g in range(groups):
        base = prose(1000 * seed + g, rng.choice([3, 9, 10, 11, 12, 14, 20, 35, 60, 150, 400, 1500])).split()
        if g % 2:
            base += shared.split()
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = "x" + str(rng.randrange(10**6))
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("k", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (3, 90, 3)])
def test_components_equal_all_pairs(spark, k, percent, seed):
    rows = near_copies(seed) + [(900, None), (901, ""), (902, "One"), (903, "one"), (904, "one two"), (905, "ONE  two\n")]
    sim = ngram_join.Similarity(words=k, percent=percent)
    got = ngram_join.ngram_components(table(spark, rows), sim).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, k, percent)


@pytest.mark.parametrize("cost", [0.0, 1e9])
def test_heavy_and_light_sides_agree(spark, cost):
    rows = near_copies(5, groups=14, copies=6)
    sim = ngram_join.Similarity(pair_cost=cost, few=0)
    got = ngram_join.ngram_components(table(spark, rows), sim).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, 3, 90)


def test_one_component_and_a_stray_make_no_square(spark):
    """3,000 connected sets and two strays in a bucket, ten sets in a small one."""
    rows = [(1, i, 50, 3002, 7) for i in range(3_000)] + [(1, 5_000 + i, 50, 3002, 5_000 + i) for i in range(2)]
    rows += [(2, i, 50, 10, i % 3) for i in range(10)]
    sim = ngram_join.Similarity(tile=32)
    got = ngram_join.tiled_rows(spark.createDataFrame(rows, "key long, id long, n int, c long, component long"), sim).collect()
    tiles = defaultdict(set)
    for r in got:
        tiles[r.key, r.low, r.high].add(r.id)
    assert len(got) < 2 * len(rows)
    for stray in (5_000, 5_001):
        assert set().union(*(x for x in tiles.values() if stray in x)) == {*range(3_000), 5_000, 5_001}
    assert tiles[2, 0, 0] == set(range(10)) and not [t for t in tiles if t[0] == 2 and t != (2, 0, 0)]


@pytest.mark.parametrize("tile", [4, 1_024])
def test_tiles_of_any_size_agree(spark, tile):
    rows = near_copies(6, groups=6, copies=7)
    sim = ngram_join.Similarity(tile=tile, few=1 << 40)
    got = ngram_join.ngram_components(table(spark, rows), sim).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, 3, 90)


def test_pairs_of_tiles_come_in_bounded_lots(monkeypatch):
    """Every pair of rows of a tile's block or across its two blocks, once; none in one component."""
    monkeypatch.setattr(ngram_join, "TILE_PAIRS", 7)
    tiles = [(0, 0, 5, 0, 2), (0, 1, 4, 3, 2), (1, 1, 1, 0, 2), (1, 2, 3, 0, 2), (0, 0, 6, 0, 1), (0, 2, 1, 9, 3)]
    low, high, block, parts, first, want = [], [], [], [], [0], set()
    for a, b, ones, others, kinds in tiles:
        start = first[-1]
        blocks = [a] * ones + [b] * others
        for i in range(len(blocks)):
            for j in range(i + 1, len(blocks)):
                if kinds > 1 and len(blocks) > 1 and (a == b or blocks[i] != blocks[j]):
                    want.add((start + i, start + j))
        low += [a] * len(blocks)
        high += [b] * len(blocks)
        block += blocks
        parts += [i % kinds for i in range(len(blocks))]
        first.append(start + len(blocks))
    lots = list(ngram_join.facing_rows(*map(np.array, (first, low, high, block, parts))))
    got = [(int(i), int(j)) for lot in lots for i, j in zip(*lot, strict=True)]
    assert len(got) == len(set(got)) and set(got) == want
    assert max(len(i) for i, _ in lots) <= 9


@pytest.mark.parametrize("heavy_from", [1, 100, 1 << 62])
def test_keys_are_the_same_in_any_lots(spark, monkeypatch, heavy_from):
    docs = table(spark, near_copies(7, groups=8, copies=3) + [(900, None), (901, ""), (902, "one")])
    sim = ngram_join.Similarity()
    whole = sorted(map(tuple, ngram_join.key_rows(docs, heavy_from, sim).collect()))
    monkeypatch.setattr(ngram_join, "KEYS_AT_ONCE", 5)
    assert whole and sorted(map(tuple, ngram_join.key_rows(docs, heavy_from, sim).collect())) == whole


def test_sets_of_one_id_are_one_node(spark):
    a, b, c = prose(1, 30), prose(2, 30), prose(3, 30)
    rows = [(1, a), (2, b), (2, c), (3, c + " end"), (4, c + " end"), (None, a), (None, "zz"), (2, b)]
    got = {tuple(r) for r in ngram_join.ngram_components(table(spark, rows)).collect()}
    assert got == {(1, 28, 1), (2, 28, 2), (3, 29, 2), (4, 29, 2), (None, 28, None), (None, 1, None)}


def brute_lines(rows, sites):
    spread, where = defaultdict(set), {}
    for doc_id, text, source in rows:
        for n, line in enumerate((text or "").split("\n")):
            line = line.strip(line_dedup.BLANKS)
            if line and text is not None:
                if source is not None:
                    spread[line].add(source)
                if doc_id is not None:
                    where[line] = min(where.get(line, (doc_id, n)), (doc_id, n))
    out = []
    for doc_id, text, _ in rows:
        if text is None:
            out.append((doc_id, None))
            continue
        kept = []
        for n, line in enumerate(text.split("\n")):
            bare = line.strip(line_dedup.BLANKS)
            gone = bare and doc_id is not None and len(spread[bare]) >= sites and where[bare] != (doc_id, n)
            if not gone:
                kept.append(line)
        out.append((doc_id, "\n".join(kept)))
    return sorted(out, key=str)


def test_line_spread(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice([f"line {rng.randrange(25)} ", f"own {i} {j}", "", "  "]) for j in range(12)), f"s{rng.randrange(9)}") for i in range(60)]
    rows += [(100, None, "s1"), (101, "", "s2"), (102, "\n\n", "s3"), (103, "line 1\nline 1", None), (None, "line 1\nline 2", "s4")]
    rows += [(104, "\n".join(["line 3", "only"] * 4000), "s5"), (5, rows[5][1], rows[5][2])]
    for sites, margin in ((4, 2.0), (6, 100.0), (3, 1.0001)):
        spread = line_dedup.Spread(sites=sites, margin=margin)
        got = line_dedup.dedup_lines(table(spark, rows), spread)
        assert sorted(((r.doc_id, r.text) for r in got.select("doc_id", "text").collect()), key=str) == brute_lines(rows, sites)
    counts = {r.doc_id: (r.lines, r.removed_lines) for r in got.collect()}
    assert counts[100] == (0, 0) and counts[101] == (1, 0) and counts[102] == (3, 0)


def test_lines_of_few_words_can_be_left_alone(spark):
    long, once, short = prose(21, 50), prose(22, 60), prose(23, 49)
    rows = [(1, f"{long}\nown 1\n{short}", "s1"), (2, f"own 2\n  {long}\n{short}", "s2"), (3, f"{once}\n{long}", None)]
    rows += [(4, f"{once}\nown 4", "s3"), (5, f"own 5\n{once}", "s3"), (6, f"{short}\n{long}", "s2")]
    want = {1: rows[0][1], 2: f"own 2\n{short}", 3: once, 4: rows[3][1], 5: rows[4][1], 6: short}
    for margin in (2.0, 1.0001):
        got = line_dedup.dedup_lines(table(spark, rows), line_dedup.Spread(sites=2, margin=margin, least_words=50))
        assert {r.doc_id: r.text for r in got.collect()} == want
    assert line_dedup.dedup_lines(table(spark, rows)).filter("removed_lines > 0").count() == 0


def test_pipeline_keeps_a_passage_of_two_sources_once(spark):
    passage = prose(24, 55)
    rows = [(i, f"{prose(30 + i, 120)}\n{passage}", f"s{i % 2}") for i in range(4)]
    rows += [(9, f"{rows[0][1]} end", "s1")]  # a near copy goes as a whole
    docs = corpus_pipeline.stage_lines(spark, table(spark, rows), "")
    got = {r.doc_id: r.text for r in corpus_pipeline.stage_near_copies(spark, docs, "").collect()}
    assert got == {0: rows[0][1], **{i: prose(30 + i, 120) for i in (1, 2, 3)}}


def test_pipeline_keeps_one_row_of_repeated_and_null_ids(spark):
    a, b, c, d = (prose(40 + i, 100) for i in range(4))
    rows = [(5, a), (5, a), (5, b), (7, f"{b} end"), (None, c), (None, f"{c} end"), (None, a), (None, d), (8, d)]
    rows += [(9, ""), (9, ""), (None, None)]
    got = corpus_pipeline.stage_near_copies(spark, table(spark, rows), "").collect()
    near = {c: "c", f"{c} end": "c", a: "a", b: "b", d: "d"}
    want = [(5, "a"), (5, "b"), (None, "c"), (8, "d"), (9, ""), (9, ""), (None, None)]
    assert sorted(((r.doc_id, near.get(r.text, r.text)) for r in got), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    empty = table(spark, [])
    assert exact_dedup.exact_groups(empty).count() == 0
    assert ngram_join.ngram_components(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    nothing = table(spark, [(1, None), (2, "")])
    assert [tuple(r) for r in ngram_join.ngram_components(nothing).orderBy("doc_id").collect()] == [(1, 0, 1), (2, 0, 2)]


def test_parity_distance_never_exceeds_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64)
        b = np.concatenate([rng.choice(a, rng.integers(0, len(a) + 1), replace=False), rng.integers(0, 2**63, rng.integers(1, 60), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        distance = ngram_join.parity_distance(ngram_join.parity_bits(a), ngram_join.parity_bits(b))
        assert distance <= len(np.setxor1d(a, b))


def test_hot_keys_are_combined_where_they_are(spark):
    """A third of all rows near copies of one text, some of them exact, and small groups."""
    base = prose(50, 90).split()
    rows = [" ".join(base[: i % 40] + [f"x{i % 40}"] + base[i % 40 + 1 :]) for i in range(120)]
    rows = list(enumerate(rows + [t for _, t in near_copies(9, groups=6, copies=5)]))
    want = brute_components(rows, 3, 90)
    for hot_rows in (64, 1_000_000):
        got = ngram_join.ngram_components(table(spark, rows), ngram_join.Similarity(hot_rows=hot_rows)).collect()
        assert sorted(map(tuple, got)) == want


def test_keys_of_one_set_only_go(spark):
    rng = random.Random(3)
    rows = sorted((rng.randrange(60), rng.randrange(4), rng.randrange(50)) for _ in range(300))
    data = [(k, a, i, 9, 0, 1) for k, a, i in rows]
    table_ = spark.createDataFrame(data, "key long, a long, id long, n int, class int, need int")
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = ngram_join.several_holders(table_.coalesce(1).sortWithinPartitions("key", "a", "id")).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        first = {}
        for k, a, i in rows:
            first.setdefault(k, {}).setdefault(a, i)
        want = sorted((k, a, i) for k, own in first.items() if len(own) > 1 for a, i in own.items())
        assert sorted((r.key, r.a, r.id) for r in got) == want
