"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A row descends the tree; at each level every child draws ``-ln(u) / weight`` with u a hash
of (doc_id, child), and the smallest draw wins, so a child is chosen in proportion to its
weight (weighted rendezvous hashing, as in the straw buckets of Weil et al., "CRUSH", 2006).

Growth is kept as epochs: an epoch is a tree of the shards added at one time. The first
draw is among the (region, epoch) pairs, each with the weight its region gained in that
epoch; from there a row descends only that epoch's racks and shards. Old pairs keep their
draws when an epoch is added, so rows move only if the new pair of the grown region wins,
and then they land in the new shards: no other subtree is touched. Choosing in one step
among all pairs gives every shard its due share.

All expressions are built-in column functions. Slots number the rows of each shard from 0
in order of doc_id, by a range sort and the sizes of its partitions.

Defined results: null text has size 16 and the checksum of the empty text; a null id draws
as the empty string and sorts first; rows with equal ids go to one shard, numbered by
checksum and size; extra columns are ignored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import number_rows

#: Bits of the hash that make the uniform number of a draw.
DRAW_DIGITS = 13
ROOT = "root"


@dataclass(frozen=True)
class Tree:
    """``epochs``: for each epoch its regions, of racks, of (shard, weight)."""

    epochs: tuple[dict[str, dict[str, tuple[tuple[int, float], ...]]], ...]

    def grown(self, region: str, rack: str, *shards: tuple[int, float]) -> Tree:
        return Tree((*self.epochs, {region: {rack: shards}}))

    def children(self) -> dict[str, list[tuple[str, float]]]:
        """Every inner node's children with their weights; the root's are the pairs of
        epoch and region."""
        found: dict[str, list[tuple[str, float]]] = {ROOT: []}
        for number, epoch in enumerate(self.epochs):
            for region, racks in epoch.items():
                top = f"{number}/{region}"
                found[top] = []
                for rack, shards in racks.items():
                    found[f"{top}/{rack}"] = [(f"{top}/{rack}/{s}", w) for s, w in shards]
                    found[top].append((f"{top}/{rack}", sum(w for _, w in shards)))
                found[ROOT].append((top, sum(w for _, w in found[top])))
        return found


def even_tree(shards: int, regions: int = 4, racks: int = 5) -> Tree:
    """``shards`` of weight 1 dealt to ``regions`` x ``racks``, filled in order."""
    tree: dict[str, dict[str, tuple[tuple[int, float], ...]]] = {}
    places = min(shards, regions * racks)
    for shard in range(shards):
        place = shard * places // shards
        region, rack = f"region{place * regions // places}", f"rack{place}"
        held = tree.setdefault(region, {})
        held[rack] = (*held.get(rack, ()), (shard, 1.0))
    return Tree((tree,))


def draw(key: Column, name: Column, weight: Column) -> Column:
    """An exponential variate of rate ``weight``: the smallest of several wins."""
    digits = F.substring(F.md5(F.concat_ws("/", name, key)), 1, DRAW_DIGITS)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**DRAW_DIGITS)
    return -F.log(uniform) / weight


def place(key: Column, tree: Tree) -> Column:
    """The shard of ``key``: one contest of draws per level on the way down the tree."""
    entries = []
    for node, below in tree.children().items():
        held = [F.struct(F.lit(name).alias("name"), F.lit(float(w)).alias("weight")) for name, w in below]
        entries += [F.lit(node), F.array(*held)]
    children, node = F.create_map(*entries), F.lit(ROOT)
    for _ in ("region", "rack", "shard"):
        draws = F.transform(
            F.element_at(children, node),
            lambda child: F.struct(draw(key, child["name"], child["weight"]).alias("draw"), child["name"].alias("name")),
        )
        node = F.array_min(draws)["name"]
    return F.substring_index(node, "/", -1).cast("int")


def assign_shards(docs: DataFrame, tree: Tree, grown: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and, with ``grown``, grown_shard."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text).alias("text_crc32"),
        place(key, tree).alias("shard"),
        (place(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    order = [F.col(c) for c in ("shard", "doc_id", "text_crc32", "size")]
    numbered = number_rows(rows, order, "_place")
    starts = numbered.groupBy("shard").agg(F.min("_place").alias("_start"))  # a row per shard
    return numbered.join(F.broadcast(starts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("_place") - F.col("_start")).cast("long").alias("slot"),
        "grown_shard",
    )


def write_shards(docs: DataFrame, tree: Tree, folder: str, files_per_shard: int = 1) -> None:
    """The documents as parquet, a folder per shard."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.withColumn("shard", place(key, tree))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(files_per_shard))
    rows.repartition("shard", salt).write.partitionBy("shard").parquet(folder)
