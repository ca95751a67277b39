"""URL filters: given site rules, then association rules mined from labelled URLs.

A URL is a set of tokens: its host suffixes, path parts with digits folded, the words of
its query and fragment. Spark's FP-growth mines the frequent combinations of tokens and
the label, which is one more item of the basket. A rule needs ``least_pages`` labelled
pages that bear it out, a count that does not rise with the table, and the confidence;
rules are pruned to those that no shorter rule with at least their confidence covers.

What such pruning would remove anyway is kept from FP-growth: tokens that stand on the
same pages (the suffixes of a host) are one item, and items whose pages all bear one
label, or that every page holds, are rules by themselves and in no combination. Items on
nearly, but not quite, the same pages still combine.

Rules match through an inverted index on the rarest item of each; the others are verified.
The firing rule with the highest confidence, then support, then fewest items gives the
verdict, ``allow`` if none fires.

Everything is column expressions, joins, aggregates and Spark's FP-growth. URLs with the
same token set are decided once. The index is broadcast up to ``index_rows``; above, a
shuffled join takes over.

Defined results: a null URL, or one without ``://``, has empty host and path, no rule and
is decided by its tokens (none: allow). Rows repeat in the output as in the input; labels
that are null do not count; without usable labels nothing is mined. Extra columns are
ignored."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .exact_dedup import LOWER, UPPER


@dataclass(frozen=True)
class Mining:
    #: Least share of all labelled pages, beside the count; a share above 0 hides small sites of a large table.
    support: float = 0.0
    #: Fewer pages are no evidence, and would make every URL of a small table a rule.
    least_pages: int = 25
    confidence: float = 0.8
    index_rows: int = 100_000


#: The label as an item of a basket, and the verdict; tokens have a colon and never equal it.
BLOCK, ALLOW = "block", "allow"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def path_number(url: Column) -> Column:
    """The first number of the path, null without one or beyond a long."""
    return F.regexp_extract(path_of(url), r"([0-9]+)", 1).try_cast("long")


def suffixes(host: Column) -> Column:
    """a.b.c, b.c and c of host a.b.c."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))),
        )
    )


def url_tokens(url: Column) -> Column:
    host, path = host_of(url), path_of(url)
    parts = F.filter(F.split(F.regexp_replace(path, r"\d+", "#"), r"[/.]"), lambda x: x != "")
    tail = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(.*)$", 1), F.lit(""))
    words = F.filter(F.split(F.regexp_replace(tail, r"\d+", "#"), r"[?&#=]+"), lambda x: x != "")
    folded = lambda kind, items: F.transform(
        items, lambda x: F.concat(F.lit(kind), F.regexp_replace(x, r"\s+", "_"))
    )
    return F.array_sort(
        F.array_distinct(F.concat(folded("host:", suffixes(host)), folded("path:", parts), folded("query:", words)))
    )


def split_rule(rule: str) -> tuple[str, str]:
    """Host and path of a rule like ``example.org/es/``."""
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def site_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest (verdict, rule) that fits, as columns rule and verdict, null if none."""
    rule = verdict = F.lit(None).cast("string")
    for given, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        site, start = split_rule(text)
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(start)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(given)).otherwise(verdict)
    return rule, verdict


def token_items(usable: DataFrame, least: float) -> DataFrame:
    """(token, item, n, bad) of the tokens that ``least`` pages of one label hold.

    ``item`` is the smallest of the tokens that stand on the very same pages, told by two
    64-bit digests of the page numbers beside the two counts."""
    held = usable.select("page", "blocked", F.explode(F.array_distinct("tokens")).alias("token"))
    counts = held.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("blocked").cast("long")).alias("bad"),
        F.bit_xor(F.xxhash64("page")).alias("one"),
        F.bit_xor(F.xxhash64(F.lit("again"), "page")).alias("two"),
    )
    counts = materialize(counts.filter(F.greatest("bad", F.col("n") - F.col("bad")) >= least), "token-counts")
    pages = ["n", "bad", "one", "two"]
    firsts = counts.groupBy(*pages).agg(F.min("token").alias("item"))
    return materialize(counts.join(firsts, pages).select("token", "item", "n", "bad"), "token-items")


def frequent_sets(usable: DataFrame, items: DataFrame, pages: int, least: float) -> DataFrame:
    """(items, verdict, hits, n) of the combinations of two items or more that ``least``
    pages of the verdict hold, by FP-growth over baskets of items and the label."""
    # An item of one label, or on all pages, is a rule of its own that covers all it is part of.
    open_ = items.filter((F.col("bad") > 0) & (F.col("bad") < F.col("n")) & (F.col("n") < pages))
    held = usable.select("page", "blocked", F.explode("tokens").alias("token")).join(open_.select("token", "item"), "token")
    label = F.when(F.col("blocked"), BLOCK).otherwise(ALLOW)
    baskets = held.groupBy("page", "blocked").agg(F.collect_set("item").alias("items"))
    baskets = materialize(baskets.select(F.array_append("items", label).alias("items")), "baskets")
    # Half a page below the count, so that no rounding of the share asks for one page more.
    share = (math.ceil(least) - 0.5) / max(baskets.count(), 1)
    if share > 1:
        schema = "items array<string>, verdict string, hits long, n long"
        return usable.sparkSession.createDataFrame([], schema)
    found = FPGrowth(itemsCol="items", minSupport=max(share, 0.0)).fit(baskets).freqItemsets
    labels = F.array(F.lit(BLOCK), F.lit(ALLOW))
    sets = found.select(
        F.array_sort(F.array_except("items", labels)).alias("items"),
        F.array_join(F.array_intersect("items", labels), "").alias("verdict"),
        "freq",
    )
    sets = materialize(sets.filter(F.size("items") > 1), "item-sets")
    whole = sets.filter(F.col("verdict") == "").select("items", F.col("freq").alias("n"))
    marked = sets.filter(F.col("verdict") != "").withColumnRenamed("freq", "hits")
    return marked.join(whole, "items").select("items", "verdict", "hits", "n")


def keyed(rules: DataFrame, items: DataFrame) -> DataFrame:
    """``rules`` with ``key``, the item of each that the fewest pages hold: what is looked up
    in the index, so that a common item leads to the rules that have no rarer one only."""
    sizes = items.filter(F.col("token") == F.col("item")).select("item", F.col("n").alias("pages"))
    parts = rules.select("items", "verdict", F.explode("items").alias("item")).join(sizes, "item")
    keys = parts.groupBy("items", "verdict").agg(F.min(F.struct("pages", "item"))["item"].alias("key"))
    return rules.join(keys, ["items", "verdict"])


def mine_items(labelled: DataFrame, p: Mining = Mining()) -> tuple[DataFrame, DataFrame]:
    """(items, verdict, confidence, support, key) of the kept rules, and (token, item, n, bad)
    of the tokens; ``labelled`` has tokens, blocked."""
    usable = labelled.filter(F.col("blocked").isNotNull() & F.col("tokens").isNotNull())
    usable = usable.select("tokens", "blocked", F.monotonically_increasing_id().alias("page"))
    usable = materialize(usable, "labelled-urls")
    pages = usable.count()
    least = max(p.least_pages, p.support * pages, 1)
    items = token_items(usable, least)
    sets = frequent_sets(usable, items, pages, least)
    for verdict, hits in ((BLOCK, F.col("bad")), (ALLOW, F.col("n") - F.col("bad"))):
        single = items.filter(F.col("token") == F.col("item"))
        sets = sets.unionByName(single.select(F.array("item").alias("items"), F.lit(verdict).alias("verdict"), hits.alias("hits"), "n"))
    rules = sets.select(
        "items", "verdict", "hits",
        (F.col("hits") / F.col("n")).alias("confidence"),
        (F.col("hits") / F.lit(max(pages, 1))).alias("support"),
    )
    rules = rules.filter((F.col("hits") >= least) & (F.col("confidence") >= p.confidence)).drop("hits")
    rules = materialize(keyed(rules, items), "rules")
    # A rule goes if one with fewer of its items, the same verdict and no less confidence stays.
    parts = rules.select("items", "verdict", "confidence", F.explode("items").alias("key"))
    short = rules.select("key", "verdict", F.col("items").alias("of"), F.col("confidence").alias("c"))
    covered = parts.join(short, ["key", "verdict"]).filter(
        (F.size("of") < F.size("items")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("of", "items")) == 0)
    )
    kept = rules.join(covered.select("items", "verdict").distinct(), ["items", "verdict"], "left_anti")
    return materialize(kept, "pruned"), items


def mine(labelled: DataFrame, p: Mining = Mining()) -> DataFrame:
    """(tokens, verdict, confidence, support): the kept rules spelt out, one for every choice
    of a token for each item. For reading; matching works on the items."""
    rules, items = mine_items(labelled, p)
    members = items.groupBy("item").agg(F.collect_set("token").alias("members"))
    parts = rules.select("*", F.explode("items").alias("item")).join(members, "item")
    parts = parts.groupBy("items", "verdict", "confidence", "support").agg(F.collect_list("members").alias("choices"))
    spelt = F.aggregate(
        "choices",
        F.array(F.array().cast("array<string>")),
        lambda done, more: F.flatten(F.transform(done, lambda x: F.transform(more, lambda y: F.array_append(x, y)))),
    )
    parts = parts.select(F.explode(spelt).alias("tokens"), "verdict", "confidence", "support")
    return parts.withColumn("tokens", F.array_sort("tokens"))


def match(token_sets: DataFrame, rules: DataFrame, items: DataFrame, p: Mining = Mining()) -> DataFrame:
    """(tokens, mined) for every distinct token set on which a rule fires: one with all its
    items among those of the set. A rule is looked up by its key alone and then verified."""
    used = rules.select(F.explode("items").alias("item")).distinct()
    names = items.select("token", "item").join(used, "item")
    worth = F.struct("confidence", "support", (-F.size("items")).alias("short"), F.array_join("items", " ").alias("name"), "verdict")
    index = rules.select("key", F.col("items").alias("need"), worth.alias("worth"))

    def bounded(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if table.limit(p.index_rows + 1).count() <= p.index_rows else table

    held = token_sets.select("tokens", F.explode("tokens").alias("token")).join(bounded(names), "token")
    held = held.groupBy("tokens").agg(F.collect_set("item").alias("items"))
    fired = held.select("tokens", "items", F.explode("items").alias("key")).join(bounded(index), "key")
    fired = fired.filter(F.size(F.array_except("need", "items")) == 0)
    return fired.groupBy("tokens").agg(F.max("worth")["verdict"].alias("mined"))


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[tuple[str, str]],
    p: Mining = Mining(),
    label_key: Column | None = None,
) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    ``labels`` (doc_id, quality, toxic) marks the pages whose ``label_key`` (by default the
    page_id) is its id; one of poor quality or toxic is an example for blocking."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, given = site_rule(F.col("host"), F.col("path"), rules)
    judged = pages.select(
        "page_id", host.alias("host"), path.alias("path"), url_tokens(F.col("url")).alias("tokens"),
        (F.col("page_id") if label_key is None else label_key).alias("label_key"),
    )
    judged = judged.select(
        "page_id", "host", "path", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"),
        "label_key", rule.alias("rule"), given.alias("given"),
    )
    judged = materialize(judged, "urls")
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy(F.col("doc_id").alias("label_key")).agg(
        F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked")
    )
    mined, items = mine_items(judged.select("label_key", "tokens").join(known, "label_key"), p)
    verdicts = match(judged.select("tokens").distinct(), mined, items, p)
    return judged.join(verdicts, "tokens", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("given", "mined", F.lit(ALLOW)).alias("verdict")
    )
