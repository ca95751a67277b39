"""Corpus inventory: manifest tables, or a distributed listing of a file tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rulepack as rp
from ..functions import paths
from ..session import materialize
from .tree import Splits, list_tree, open_root


def is_ignored(component: Column) -> Column:
    """System or temporary file or folder, by its name alone."""
    low = F.lower(component)
    junk = low.isin(*rp.JUNK_NAMES, *rp.JUNK_DIRECTORIES) | low.startswith(".")
    for prefix in rp.JUNK_PREFIXES:
        junk = junk | low.startswith(prefix)
    return junk


def ignored_prefix(path: Column) -> Column:
    """Path up to its first ignored component; null when nothing is ignored."""
    parts = paths.parts_of(path)
    flags = F.transform(parts, is_ignored)
    cut = F.array_position(flags, True)
    return F.when(cut > 0, F.array_join(F.slice(parts, F.lit(1), cut.cast("int")), "/"))


def ignore_filter(files: DataFrame) -> DataFrame:
    """Keep the files no component of whose path is ignored. A manifest may carry
    ``is_hidden`` for attributes a name does not show."""
    kept = files.filter(~F.exists(paths.parts_of(F.col("relative_path")), is_ignored))
    return kept.filter(~F.coalesce("is_hidden", F.lit(False))) if "is_hidden" in files.columns else kept


def skipped_count(files: DataFrame) -> DataFrame:
    """One row: what was skipped, an ignored folder counting once whatever it holds."""
    prefix = ignored_prefix(F.col("relative_path"))
    if "is_hidden" in files.columns:
        prefix = F.coalesce(prefix, F.when(F.col("is_hidden"), F.col("relative_path")))
    return (
        files.select(prefix.alias("skipped"))
        .filter(F.col("skipped").isNotNull())
        .distinct()
        .agg(F.count(F.lit(1)).alias("skipped_system_files"))
    )


def classify_file(suffix: Column) -> dict[str, Column]:
    """category, display_type and scan_note of an extension ('' for none)."""
    types = {**rp.SUPPORTED, **rp.LEGACY, **rp.OTHER_BUSINESS}
    display = F.when(suffix == "", F.lit("无扩展名文件"))
    for ext, label in types.items():
        display = display.when(suffix == ext, F.lit(label))
    supported, legacy = suffix.isin(*rp.SUPPORTED), suffix.isin(*rp.LEGACY)
    other = suffix.isin(*rp.OTHER_BUSINESS)
    return {
        "category": F.when(supported, "首批支持文档")
        .when(legacy, "待转换文档")
        .when(other, "其他业务文件")
        .otherwise("其他文件"),
        "display_type": display.otherwise(F.lit("其他")),
        "scan_note": F.when(supported, "")
        .when(legacy, "建议转换为常用格式")
        .when(other, "第一版暂不读取正文")
        .when(suffix == "", "需要人工确认文件类型")
        .otherwise("第一版仅盘点，不读取正文"),
    }


def record_projection(files: DataFrame) -> DataFrame:
    """The 23-column audit row with every verdict column at its default."""
    name = paths.name_of(F.col("relative_path"))
    kind = classify_file(paths.suffix(name))
    return files.select(
        "doc_id",
        name.alias("file_name"),
        "relative_path",
        kind["category"].alias("category"),
        kind["display_type"].alias("display_type"),
        paths.extension(name).alias("extension"),
        "size_bytes",
        "modified_at",
        F.lit(rp.SCANNED).alias("scan_status"),
        kind["scan_note"].alias("scan_note"),
        F.lit(rp.UNPARSED).alias("parse_status"),
        F.lit(0).alias("content_length"),
        F.lit(0).alias("document_scale"),
        F.lit("").alias("scale_unit"),
        F.lit("").alias("parse_issue"),
        F.lit(rp.UNJUDGED).alias("use_status"),
        F.lit("").alias("issues"),
        F.lit("").alias("priority"),
        F.lit("").alias("recommendation"),
        F.lit("").alias("duplicate_group"),
        F.lit("").alias("version_group"),
        F.lit("").alias("sensitive_risks"),
        F.lit(0).alias("sensitive_risk_count"),
        F.lit(rp.PENDING).alias("suggested_knowledge_base"),
    )


def sort_inventory(records: DataFrame) -> DataFrame:
    """Inventory order: path, then name, both lower-cased; doc_id makes it total."""
    return records.orderBy(F.lower("relative_path"), F.lower("file_name"), "doc_id")


def inventory_only(files: DataFrame) -> DataFrame:
    """Audit rows without reading any content: unread columns are pruned."""
    return record_projection(ignore_filter(files))


# --- file trees ------------------------------------------------------------


class Listing:
    """Result of ``scan_corpus``: the files to audit and the side counts."""

    def __init__(self, files: DataFrame, skipped: DataFrame, errors: DataFrame):
        self.files = files
        self.skipped = skipped
        self.errors = errors


def scan_corpus(spark: SparkSession, root: str, splits: Splits = Splits()) -> Listing:
    """Inventory of a file tree (a mounted path or the URI of a store): (doc_id, root_path,
    root_name, path, relative_path, size_bytes, modified_at) of the files, the skipped count
    and the errors."""
    tree = open_root(root)
    tree.check()
    above, _, own = tree.root.rpartition("/")
    entries = list_tree(spark, root, splits)
    name = F.element_at(F.split("relative_path", "/"), -1)
    dropped = is_ignored(name) & F.col("kind").isin("file", "dir") | (F.col("kind") == "dirlink")
    files = entries.filter((F.col("kind") == "file") & ~is_ignored(name)).select(
        F.monotonically_increasing_id().alias("doc_id"),
        F.lit(above).alias("root_path"),
        F.lit(own).alias("root_name"),
        "path",
        "relative_path",
        "size_bytes",
        "modified_at",
    )
    skipped = entries.filter(dropped).agg(F.count(F.lit(1)).alias("skipped_system_files"))
    return Listing(materialize(files, "inventory"), skipped, access_errors(entries))


def access_errors(entries: DataFrame) -> DataFrame:
    """(path, message) of every file that could not be read; the batch goes on."""
    return entries.filter(F.col("error").isNotNull()).select("path", F.col("error").alias("message"))
