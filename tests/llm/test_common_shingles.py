"""The n-gram join where many texts quote the same passages: lists stay short, links all found."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.llm import line_dedup, ngram_join
from corpuscope.llm.packing import word_count
from tests.llm.test_copies import brute_components, near_copies, prose, table

NEAR = ngram_join.Similarity(words=5, percent=80)


def quoting(texts, seed=1):
    """Texts of their own words, each with one of two passages; every twentieth has a near copy."""
    passages, rows = [prose(seed * 77 + i, 40) for i in range(2)], []
    for i in range(texts):
        own = prose(10_000 * seed + i, 50).split()
        rows.append(" ".join([*own[:20], passages[i % 2], *own[20:]]))
        if i % 20 == 0:
            rows.append(rows[-1] + " more")
    return list(enumerate(rows))


def test_quoted_passages_make_no_long_lists(spark, monkeypatch):
    met, connect = [], ngram_join.connect

    def seen(buckets, held, sim):
        met.append(buckets.agg(F.max("c")).first()[0])
        return connect(buckets, held, sim)

    monkeypatch.setattr(ngram_join, "connect", seen)
    rows = quoting(500)
    got = ngram_join.ngram_components(table(spark, rows), NEAR).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, 5, 80)
    assert met[0] < 20  # 50 before


@pytest.mark.parametrize(("k", "percent", "most"), [(3, 90, 30), (5, 80, 0), (5, 80, 1 << 16)])
def test_any_order_gives_the_same_links(spark, monkeypatch, k, percent, most):
    monkeypatch.setattr(ngram_join, "COUNTED", 1)
    rows = near_copies(11, groups=8, copies=5) + [(1_000 + i, t) for i, t in quoting(30, seed=2)]
    sim = ngram_join.Similarity(words=k, percent=percent, common_from=2, most_common=most)
    order = ngram_join.common_last(table(spark, rows), sim)
    assert len(order.last) <= most and (np.diff(order.last.astype(object)) > 0).all()
    got = ngram_join.ngram_components(table(spark, rows), sim).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, k, percent)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_linked_sets_share_what_both_need(percent):
    rng, sim = np.random.default_rng(percent), ngram_join.Similarity(percent=percent)
    pool = rng.integers(0, 1 << 63, 5_000, dtype=np.int64).astype(np.uint64)
    last = np.sort(rng.choice(pool, 1_500, replace=False))
    order = ngram_join.Order(last, rng.integers(2, 9, len(last)))
    linked = 0
    for _ in range(600):
        n = int(rng.choice([1, 4, 9, 10, 49, 50, 51, 120, 700]))
        a = rng.choice(pool, n, replace=False)
        gone = int(rng.integers(0, n * (100 - percent) // 100 + 2))
        b = np.unique(np.concatenate([a[gone:], rng.choice(pool, int(rng.integers(0, n // 5 + 1)))]))
        overlap = len(np.intersect1d(a, b))
        if len(b) and sim.links(overlap, len(a) + len(b) - overlap):
            linked += 1
            both = np.intersect1d(*(ngram_join.prefix_keys(np.sort(x), sim, order) for x in (a, b)))
            assert len(both) >= max(sim.prefix(len(a))[1], sim.prefix(len(b))[1])
    assert linked > 50


def test_light_pairs_count_in_the_boundary(spark):
    """200 probed sets of one size that share a part: as many keys as heavy ones would have, more pairs."""
    schema = "n long, light long, heavy array<long>, parts array<long>, probe array<long>"
    for shared, heavy in ((True, True), (False, False)):
        rows = [(50, 10, [i * 16 + 7 * 10**6, i * 16 + 8 * 10**6], [1 if shared else i], []) for i in range(200)]
        found = ngram_join.boundary(spark.createDataFrame(rows, schema), NEAR)
        assert (found <= 50) == heavy


def test_the_sets_of_an_id_need_their_own(spark):
    """Id 1 is a small set with the two keys it needs and a large one with one of 21."""
    rows = [(1, 1, 50, -1, 2), (2, 1, 50, -1, 2), (3, 1, 1_000, -1, 21), (1, 2, 51, -1, 2), (2, 2, 51, -1, 2)]
    buckets = spark.createDataFrame(rows, "key long, id long, n int, class int, need int")
    got = sorted(map(tuple, ngram_join.enough_keys(buckets).collect()))
    assert got == sorted(r for r in rows if r[2] != 1_000)


def test_lines_of_enough_words(spark):
    rng = random.Random(4)
    lines = ["", " ", "a b", "a  b\tc", "\x0ba\x0cb\rc d", "a b c", "a b\u0085c d e", "é ö ü", "\U0001f600 x y z"]
    lines += ["".join(rng.choice("ab \t\r\x0b\x0c é") for _ in range(rng.randint(1, 30))) for _ in range(400)]
    docs = spark.createDataFrame([(i, x, "s") for i, x in enumerate(lines)], "doc_id long, text string, source string")
    for least in (2, 3, 7):
        got = {r.doc_id for r in line_dedup.lines_of(docs, line_dedup.Spread(least_words=least)).collect()}
        want = {r.doc_id for r in docs.filter(word_count(F.col("text")) >= least).collect()}
        assert got == want and got
