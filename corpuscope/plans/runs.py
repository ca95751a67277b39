"""From a folder, a store or a manifest to verdicts in one call."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession

from ..operators.assemble import Elements, assemble_documents
from ..rulepack import DEFAULT_PACK, RulePack
from ..session import materialize
from ..sources.content import read_documents
from ..sources.inventory import access_errors, ignore_filter, scan_corpus, skipped_count
from ..sources.tree import Splits
from .audit import Audit, analyze


def audit_folder(
    spark: SparkSession,
    root: str,
    as_of: Column | datetime | str | None = None,
    elements: Elements | None = None,
    pack: RulePack = DEFAULT_PACK,
    splits: Splits = Splits(),
) -> Audit:
    """Audit of every file below ``root`` (a mounted path or the URI of a store).

    ``elements`` are the pages, cells, shapes and so on of office and PDF files; they name
    their document by ``relative_path``, since the listing numbers the documents. The result
    carries the skipped count and the errors of the listing; files that could not be read
    are rows with a status."""
    listing = scan_corpus(spark, root, splits)
    docs = read_documents(listing.files)
    if elements is not None:
        docs = assemble_documents(docs, elements.numbered(listing.files))
    audit = analyze(docs, as_of, pack)
    audit.skipped, audit.errors = materialize(listing.skipped, "skipped"), materialize(listing.errors, "errors")
    return audit


def audit_manifest(
    manifest: DataFrame,
    as_of: Column | datetime | str | None = None,
    elements: Elements | None = None,
    pack: RulePack = DEFAULT_PACK,
) -> Audit:
    """Audit of a table of documents as it comes from a crawl or a store's inventory: the
    columns of ``analyze`` and, optionally, ``is_hidden`` and ``error`` (why a row's file
    could not be looked at, else null).

    Ignored rows are counted, not audited; rows with an error go to the error table. Both read
    only the path columns of ``manifest``; the texts are read by the audit alone."""
    failed = "error" in manifest.columns
    kept = ignore_filter(manifest)
    errors = None
    if failed:
        named = kept.withColumn("path", kept["relative_path"]) if "path" not in kept.columns else kept
        errors = materialize(access_errors(named), "errors")
        kept = kept.filter("error IS NULL").drop("error")
    docs = kept if elements is None else assemble_documents(kept, elements)
    audit = analyze(docs, as_of, pack)
    audit.skipped, audit.errors = materialize(skipped_count(manifest), "skipped"), errors
    return audit
