"""Sharding, nearest neighbours, URL rules, packing, encoding."""

import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.llm import block_ann, bpe, packing, sharding, url_rules
from corpuscope.llm.block_ann import Blocks
from corpuscope.llm.url_rules import Mining

# --- sharding


def sharded(spark, rows, tree, grown=None):
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, size string")
    return sharding.assign_shards(docs, tree, grown).collect()


def test_growth_moves_rows_into_the_new_shard_only(spark):
    rows = [(i, f"text {i}", "x", "y") for i in range(6_000)] + [(None, None, "x", "y"), (7, "twice", "x", "y"), (8, "", "x", "y")]
    tree = sharding.even_tree(40)
    got = sharded(spark, rows, tree, tree.grown("region3", "rack19", (40, 1.0)))
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(40)) and max(counts.values()) < 1.5 * min(counts.values())
    moved = [r for r in got if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {40} and 0.5 < len(moved) / (len(rows) / 41) < 1.5
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        text = next(t for i, t, *_ in rows if i == r.doc_id) if r.doc_id not in (7, 8) else None
        if text is not None:
            assert r.size == len(text.encode()) + 16 and r.text_crc32 == zlib.crc32(text.encode())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    null = next(r for r in got if r.doc_id is None)
    assert (null.size, null.text_crc32, null.slot) == (16, 0, 0)
    again = {(r.doc_id, r.text_crc32): r.slot for r in sharded(spark, rows[::-1], tree)}
    assert again == {(r.doc_id, r.text_crc32): r.slot for r in got}


def test_weights_and_later_epochs(spark):
    tree = sharding.Tree(({"a": {"r": ((0, 3.0), (1, 1.0))}, "b": {"s": ((2, 2.0),)}},))
    rows = [(i, "", "", "") for i in range(9_000)]
    counts = Counter(r.shard for r in sharded(spark, rows, tree))
    for shard, weight in ((0, 3), (1, 1), (2, 2)):
        assert counts[shard] == pytest.approx(9_000 * weight / 6, rel=0.08)
    one = tree.grown("a", "r", (3, 1.0))
    got = sharded(spark, rows, one, one.grown("c", "t", (4, 2.0), (5, 1.0)))
    assert {r.grown_shard for r in got if r.shard != r.grown_shard} == {4, 5}
    assert sharded(spark, [], tree) == []


# --- nearest neighbours


def brute_nearest(rows, k):
    seen, out = {}, []
    for i, v in rows:
        ok = i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if ok:
            seen[(i, tuple(v))] = np.asarray(v, dtype=np.float32).astype(float)
    for (i, _), q in seen.items():
        if i % 50:
            continue
        near = []
        for (j, _), v in seen.items():
            if j != i and len(v) == len(q):
                near.append((-float(q @ v / (np.sqrt(q @ q) * np.sqrt(v @ v))), j))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted((round(s, 12), j) for s, j in near)[:k])]
    return sorted(out)


def test_block_join_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(400)]
    rows += [(1000 + i, [float(x) for x in rows[50][1]]) for i in range(150)]  # one common vector
    rows += [(2000, None), (2050, []), (2100, [0.0] * 16), (2150, [float("nan")] * 16), (2200, [None] + [1.0] * 15), (None, [1.0] * 16)]
    rows += [(2250, [1.0, 2.0]), (2251, [2.0, 1.0]), (2300, [float("inf")] + [1.0] * 15), (2350, [1e-30] * 16), (2400, [1e30] * 16), (3, rows[3][1])]
    frame = spark.createDataFrame([(i, v, 0, "q") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string")
    for blocks in (Blocks(), Blocks(query_block=4, candidate_block=60, strip=3, survivors=17)):
        got = block_ann.nearest(frame, F.col("vec_id") % 50 == 0, 5, blocks).collect()
        want = brute_nearest(rows, 5)
        assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [w[:3] for w in want]
        scores = {(r.query_id, r.rank): r.score for r in got}
        assert all(abs(scores[w[:2]] - w[3]) < 1e-9 for w in want)
    assert block_ann.nearest(frame.filter("vec_id < 0"), F.lit(True), 5).count() == 0


# --- URL rules


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("allow", "com/fr/"), ("block", "com/de/")]


def judged(spark, urls, labels=(), mining=Mining()):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in urls], "page_id long, url string, host string, rule string")
    marks = spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int")
    return {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, marks, RULES, mining).collect()}


def test_site_rules(spark):
    urls = [
        (1, "http://A.Example.ORG/es/1?x=1"),
        (2, "https://example.org/en/"),
        (3, "https://badexample.org/es/"),
        (4, "x://org"),
        (5, "no scheme"),
        (6, None),
        (7, ""),
        (8, "http://de.com/de/#a://b/c"),
        (9, "http://x.com:80/fr/"),
        (10, "http://com/fr/\nline"),
        (None, "http://com/fr/"),
    ]
    assert judged(spark, urls) == {
        (1, "a.example.org", "/es/1", "example.org/es/", "block"),
        (2, "example.org", "/en/", "org/", "allow"),
        (3, "badexample.org", "/es/", "org/", "allow"),
        (4, "org", "", None, "allow"),
        (5, "", "", None, "allow"),
        (6, "", "", None, "allow"),
        (7, "", "", None, "allow"),
        (8, "de.com", "/de/", "com/de/", "block"),
        (9, "x.com:80", "/fr/", None, "allow"),
        (10, "com", "/fr/\nline", "com/fr/", "allow"),
        (None, "com", "/fr/", "com/fr/", "allow"),
    }
    assert judged(spark, []) == set()


def tokens_of(url):
    """The token rule, told in Python, for URLs of plain letters and digits."""
    rest = url.split("://", 1)[1]
    host, _, path = rest.partition("/")
    labels = host.split(".")
    out = {"host:" + ".".join(labels[i:]) for i in range(len(labels))}
    return out | {"path:" + p for p in __import__("re").sub(r"\d+", "#", path).replace(".", "/").split("/") if p}


def test_mined_rules_equal_brute_force(spark):
    from itertools import combinations

    rng = random.Random(2)
    urls, labels = [], []
    for i in range(400):
        host, lang = rng.choice(["shop.win", "blog.win", "news.net", "www.net"]), rng.choice(["en", "zh"])
        urls.append((i, f"http://{host}/{lang}/p{rng.randrange(3)}/{i}"))
        if i < 300:
            bad = rng.random() < (0.95 if host.endswith("win") and lang == "zh" else 0.2 if lang == "zh" else 0.1)
            labels.append((i, int(not bad), 0))
    mining = Mining(support=0.05, least_pages=10, confidence=0.75)
    marked = [(tokens_of(urls[i][1]), not good) for i, good, _ in labels]
    rules = []
    sets = {c for t, _ in marked for n in range(1, len(t) + 1) for c in combinations(sorted(t), n)}
    for c in sets:
        hits = [bad for t, bad in marked if t.issuperset(c)]
        for verdict, n in (("block", sum(hits)), ("allow", len(hits) - sum(hits))):
            if n >= 0.05 * 300 and n / len(hits) >= 0.75:
                rules.append((frozenset(c), verdict, n / len(hits), n / 300))
    kept = [r for r in rules if not any(s[0] < r[0] and s[1] == r[1] and s[2] >= r[2] for s in rules)]
    assert any(r[1] == "block" and len(r[0]) > 1 for r in kept)
    verdicts = {p: v for p, *_, v in judged(spark, urls, labels, mining)}
    for i, url in urls:
        firing = [(c, s, -len(t), " ".join(sorted(t)), v) for t, v, c, s in kept if tokens_of(url) >= t]
        assert verdicts[i] == (max(firing)[-1] if firing else "allow"), url


def test_small_share_of_a_large_table_becomes_a_rule(spark):
    """Production parameters: 40 of 4,000 labelled pages are one bad host, 24 another one."""
    urls = [(i, f"http://host{i % 7}.net/en/{i}") for i in range(3_936)]
    urls += [(10_000 + i, f"http://all.bad.win/en/{i}") for i in range(41)]
    urls += [(20_000 + i, f"http://few.org/en/{i}") for i in range(25)]
    labels = [(i, int(i % 10 > 0), 0) for i in range(3_936)]
    labels += [(10_000 + i, 0, 0) for i in range(40)] + [(20_000 + i, 0, 0) for i in range(24)]
    verdicts = {(host, v) for _, host, _, _, v in judged(spark, urls, labels)}
    assert verdicts == {*((f"host{i}.net", "allow") for i in range(7)), ("all.bad.win", "block"), ("few.org", "allow")}


def test_tokens_that_occur_together_do_not_multiply(spark):
    """Thirty tokens on every page of a site of mixed labels: no set of two is extended."""
    tokens = sorted(f"path:p{i:02}" for i in range(30))
    rows = [(tokens, i % 8 == 0) for i in range(400)]
    rules = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"))
    assert sorted((r.tokens, r.verdict) for r in rules.collect()) == [([t], "allow") for t in tokens]


def test_rules_match_through_their_rarest_item_and_all_of_the_rest(spark):
    """Two tokens that only together are bad, with repeated rows, null and repeated labels."""
    urls = [(i, f"http://a{i % 5}.net/{'x' if i % 2 else 'y'}/{'u' if i % 3 else 'v'}/{i}") for i in range(1200)]
    labels = [(i, int(not (i % 2 and i % 3)), 0) for i in range(900)] + [(1, 0, 0), (2, None, 0), (None, 0, 1)]
    rows = [(i, u, "h", "r") for i, u in urls + urls[:50]]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = url_rules.judge_urls(pages, marks, []).collect()
    assert len(got) == 1250
    assert all((r.verdict == "block") == bool(r.page_id % 2 and r.page_id % 3) for r in got)
    rules = url_rules.mine(spark.createDataFrame([(sorted(tokens_of(u)), bool(i % 2 and i % 3)) for i, u in urls], "tokens array<string>, blocked boolean"))
    assert [sorted(r.tokens) for r in rules.collect() if r.verdict == "block"] == [["path:u", "path:x"]]


def test_labels_are_met_by_the_given_key(spark):
    """The number of the path names the label: beyond a long, none, or absent, there is none."""
    urls = [(i, f"http://{'bad' if i < 40 else 'good'}.net/p/{5000 + i}.html?id=7") for i in range(80)]
    urls += [(90, "http://bad.net/" + "9" * 30), (91, "http://bad.net/"), (92, None), (93, "http://bad.net/" + "a/" * 20_000)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    marks = spark.createDataFrame([(5000 + i, int(i >= 40), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    verdicts = {
        r.page_id: r.verdict
        for r in url_rules.judge_urls(pages, marks, [], label_key=url_rules.path_number(F.col("url"))).collect()
    }
    assert verdicts == {**{i: "block" if i < 40 else "allow" for i in range(80)}, 90: "block", 91: "block", 92: "allow", 93: "block"}
    assert {v for *_, v in judged(spark, [(i, u) for i, u in urls if u])} == {"allow"}  # without labels


# --- packing


def test_bins_hold_no_conflict_and_fit_best(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 60, 90, 250])) + (f" u{i}" if i % 4 else ""), f"s{rng.choice([0, 0, 0, 1, 2, 3, 4])}", "b") for i in range(500)]
    rows += [(1000, None, None, "b"), (1001, "", None, "b"), (None, "a b", "s1", "b"), (3, rows[3][1], rows[3][2], "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bin_id string")
    got = packing.pack(docs, p=packing.Packing(capacity=100, group_rows=150)).collect()
    text = {r[0]: (r[1] or "", r[2]) for r in rows}
    held = Counter()
    bins = defaultdict(list)
    for r in got:
        held[r.doc_id] += r.tokens
        bins[r.bin_id].append(r)
    assert all(held[i] == len((t or "").split()) * (2 if i == 3 else 1) for i, t, *_ in rows)
    for items in bins.values():
        assert sum(r.tokens for r in items) == items[0].bin_fill <= 100
        assert len({text[r.doc_id][1] for r in items}) == len(items)
        assert len({text[r.doc_id][0].lower() for r in items}) == len(items)
        spans = sorted((r.bin_offset, r.bin_offset + r.tokens) for r in items)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert packing.pack(docs.filter("doc_id < 0")).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(9)
    bins, plain = packing.Bins(100), []
    for _ in range(1500):
        size, source, cluster = rng.randint(0, 60), 1 << rng.choice([0, 0, 0, 1, 2, 3]), rng.choice([0, 0, 1 << rng.randrange(9)])
        fits = [b for b in plain if b[0] >= size and not b[1] & source and not b[2] & cluster]
        number, offset = bins.place(size, source, cluster)
        if fits:
            assert plain[number] in fits and plain[number][0] == min(b[0] for b in fits)
        else:
            assert number == len(plain)
            plain.append([100, 0, 0])
        assert offset == 100 - plain[number][0]
        plain[number] = [plain[number][0] - size, plain[number][1] | source, plain[number][2] | cluster]


# --- encoding

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


def odd_texts():
    rng = random.Random(7)
    texts = ["", "  ", "Hello, World! it's 123  élan\n\tœuvre İstanbul <|endoftext|> ok<|startoftext|>", "ΟΔΟΣ Σας ẞ ﬁ é", "a\x00b\x1c c\x85d", "it'S they'RE ''s", "½²③ 一二三", "<|endoftext", "😀👩‍👩‍👧 ™…", "<|endoftext|>" * 3, "x" * 5000]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéÉß'<|>.!? \n") for _ in range(300)) for _ in range(300)]
    return texts + [" ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 14))) for _ in range(40)) for _ in range(300)]


@needs_vocabulary
def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    texts = [*odd_texts(), None, "again", "again"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = bpe.encode_texts(docs, bpe.load_vocabulary(VOCABULARY), decode=True).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_texts(docs.limit(0), bpe.load_vocabulary(VOCABULARY)).count() == 0


@needs_vocabulary
def test_verified_cuts_are_the_exact_merges(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 50)  # words move between the generations
    encoder = bpe.Encoder(bpe.load_vocabulary(VOCABULARY))
    texts = odd_texts()[11:]
    first = [x for i in range(0, len(texts), 20) for x in encoder.encode(texts[i : i + 20])]
    assert len(encoder.good) and len(encoder.bad)
    for text, ids in zip(texts, first, strict=True):
        spelt = [w.encode().decode("latin-1").translate(encoder.letters) for w in encoder.words(text)]
        exact = [t for w in spelt for t in encoder.merged([*(encoder.inner[c] for c in w[:-1]), encoder.final[w[-1]]])]
        assert np.frombuffer(ids, "<u4").tolist() == exact


@needs_vocabulary
def test_long_words_and_forgotten_pairs(monkeypatch):
    """Words of 200,000 letters in seconds, equal to the library's; caches stay small."""
    import time

    from tokenizers import Tokenizer

    rng = random.Random(8)
    words = ["".join(rng.choices(letters, k=200_000)) for letters in ("etaoinshrdlu", "abcdefghijklmnopqrstuvwxyz", "éèa", "!?.-")]
    words.append("ab" * 100_000)
    encoder, library = bpe.Encoder(bpe.load_vocabulary(VOCABULARY)), Tokenizer.from_file(VOCABULARY)
    started = time.monotonic()
    ids = encoder.encode(words)
    assert time.monotonic() - started < 5 * len(words)
    for word, got in zip(words, ids, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(word, add_special_tokens=False).ids
    for word in words[:2]:
        symbols = [encoder.inner[c] for c in word[:300]]
        heap = encoder.merged_by_heap(symbols)
        monkeypatch.setattr(bpe, "SCANNED", 1_000)
        assert encoder.merged(symbols) == heap
    monkeypatch.setattr(bpe, "CACHED_LETTERS", 1_000)
    monkeypatch.setattr(bpe, "KNOWN_PAIRS", 200)
    texts = odd_texts()[11:]
    again = [x for i in range(0, len(texts), 20) for x in encoder.encode(texts[i : i + 20])]
    assert len(encoder.good) + len(encoder.bad) < 5_000 and len(encoder.cache) < 2_000
    for text, got in zip(texts, again, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@needs_vocabulary
def test_a_column_named_decoded_is_replaced(spark):
    docs = spark.createDataFrame([(1, "Word", "mine", "x")], "doc_id long, text string, decoded string, other string")
    tables = bpe.load_vocabulary(VOCABULARY)
    row = bpe.encode_texts(docs, tables, decode=True).first()
    assert row.other == "x" and row.decoded == "word</w>"
    assert bpe.encode_texts(docs, tables).first().decoded == "mine"
