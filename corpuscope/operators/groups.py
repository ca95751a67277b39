"""Cross-document rules: duplicate components, keepers and version families.

Text never shuffles here: the inputs are fingerprints, keys and ``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rulepack as rp
from ..rulepack import RulePack
from ..session import materialize
from .components import star_components
from .skew import HOT_ROWS, number_rows, split_join

ORDER = ("path_key", "name_key", "doc_id")
FAMILY = ("root_key", "parent_key", "version_key")


def signatures(docs: DataFrame, pack: RulePack) -> DataFrame:
    """(doc_id, signature): up to two rows per document, 33 bytes each."""
    binary = F.when(
        (F.col("size_bytes") > 0) & F.col("binary_fp").isNotNull(),
        F.concat(F.unhex(F.lit("00")), F.unhex("binary_fp")),
    )
    text = F.when(
        (F.col("text_fp") != "") & (F.col("content_length") >= pack.min_duplicate_text),
        F.concat(F.unhex(F.lit("01")), F.unhex("text_fp")),
    )
    return docs.select("doc_id", F.explode(F.array_compact(F.array(binary, text))).alias("signature"))


def signature_groups(docs: DataFrame, pack: RulePack) -> DataFrame:
    """Signatures shared by two or more documents, with size and smallest doc_id."""
    return (
        signatures(docs, pack)
        .groupBy("signature")
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("rep"))
        .filter(F.col("n") > 1)
    )


def duplicate_members(docs: DataFrame, pack: RulePack, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, component) of every document in a duplicate component.

    A shared signature is represented by its smallest doc_id. Most documents
    see one representative and are done; only those whose two signatures have
    different representatives contribute an edge to the components step."""
    shared = materialize(signature_groups(docs, pack), "shared")
    linked = split_join(signatures(docs, pack), shared, ["signature"], "n", hot_rows=hot_rows)
    members = materialize(
        linked.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")),
        "members",
    )
    edges = members.filter(F.col("rep") != F.col("other")).select(
        F.col("rep").alias("lo"), F.col("other").alias("hi")
    )
    if edges.isEmpty():
        return members.select("doc_id", F.col("rep").alias("component"))
    stars = star_components(edges.distinct(), hot_rows)
    sized = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    roots = sized.join(stars, sized["rep"] == stars["hi"]).select("rep", "n", F.col("lo").alias("root"))
    rooted = split_join(members.select("doc_id", "rep"), roots, ["rep"], "n", "left", hot_rows)
    return rooted.select("doc_id", F.coalesce("root", "rep").alias("component"))


def elect_primary(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Per component: size, first member in inventory order and the copy to keep."""
    facts = docs.select(
        "doc_id",
        F.struct(*ORDER).alias("place"),
        F.struct(
            (F.col("parse_status") == rp.DIRECT).alias("direct"),
            (~F.col("copy_named")).alias("original"),
            F.col("modified_at"),
            F.col("content_length"),
            F.col("path_key"),
            (-F.col("doc_id")).alias("neg_id"),
        ).alias("merit"),
    )
    return (
        members.join(facts, "doc_id")
        .groupBy("component")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("place").alias("first"),
            (-F.max("merit")["neg_id"]).alias("primary_id"),
        )
    )


def group_label(pattern: str, number: Column) -> Column:
    """``重复组001`` style id: the number padded to three digits, longer ones whole."""
    text = number.cast("string")
    return F.format_string(pattern, F.when(number < 1000, F.lpad(text, 3, "0")).otherwise(text))


def duplicate_marks(docs: DataFrame, pack: RulePack, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, duplicate_group, is_primary)."""
    members = duplicate_members(docs, pack, hot_rows)
    groups = number_rows(elect_primary(members, docs), [F.col("first")], "number")
    keys = groups.select(
        "component", "n", "primary_id", group_label(rp.DUPLICATE_ID, F.col("number")).alias("duplicate_group")
    )
    return split_join(members, keys, ["component"], "n", hot_rows=hot_rows).select(
        "doc_id", "duplicate_group", (F.col("doc_id") == F.col("primary_id")).alias("is_primary")
    )


def version_families(docs: DataFrame, pack: RulePack) -> DataFrame:
    """Families per (root, folder, title key). Two or more distinct values are told by
    min <> max, so the aggregation combines on the map side without expanding."""
    fp = F.nullif("text_fp", F.lit(""))
    name = F.col("name_key")
    return (
        docs.filter(F.length("version_key") >= pack.min_version_key)
        .groupBy(*FAMILY)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.bool_or("version_marker").alias("marked"),
            (F.min(name) != F.max(name)).alias("names_differ"),
            (F.min(fp) != F.max(fp)).alias("texts_differ"),
            F.min(fp).isNull().alias("no_text"),
            F.min(F.struct(*ORDER)).alias("first"),
        )
        .filter(
            (F.col("n") > 1)
            & F.col("marked")
            & F.col("names_differ")
            & (F.col("no_text") | F.col("texts_differ"))
        )
        .select(*FAMILY, "n", "first")
    )


def version_marks(docs: DataFrame, pack: RulePack, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, version_group)."""
    families = number_rows(version_families(docs, pack), [F.col("first")], "number")
    keys = families.select(
        *FAMILY, "n", group_label(rp.VERSION_ID, F.col("number")).alias("version_group")
    )
    return split_join(docs.select("doc_id", *FAMILY), keys, list(FAMILY), "n", hot_rows=hot_rows).select(
        "doc_id", "version_group"
    )


def cross_document_marks(docs: DataFrame, pack: RulePack, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Both kinds of membership as one row per marked document, so the wide
    document table is joined once."""
    both = duplicate_marks(docs, pack, hot_rows).unionByName(
        version_marks(docs, pack, hot_rows), allowMissingColumns=True
    )
    return both.groupBy("doc_id").agg(
        F.max("duplicate_group").alias("duplicate_group"),
        F.max("is_primary").alias("is_primary"),
        F.max("version_group").alias("version_group"),
    )
