"""The audit: documents in, one verdict row per document out.

Stage 1 reads each text once and keeps about twenty narrow features. Stage 2
works on those: duplicate components, version families, topic consolidation.
Text is never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rulepack as rp
from ..functions import normalize, paths, risks, text
from ..operators import findings as rules
from ..operators import groups, topics
from ..operators.elements import extract_dispatch
from ..operators.skew import HOT_ROWS
from ..rulepack import DEFAULT_PACK, RulePack
from ..session import Scratch, materialize
from ..sources.inventory import classify_file

RECORD_COLUMNS = (
    "doc_id",
    "file_name",
    "relative_path",
    "category",
    "display_type",
    "extension",
    "size_bytes",
    "modified_at",
    "scan_status",
    "scan_note",
    "parse_status",
    "content_length",
    "document_scale",
    "scale_unit",
    "parse_issue",
    "use_status",
    "issues",
    "priority",
    "recommendation",
    "duplicate_group",
    "version_group",
    "sensitive_risks",
    "sensitive_risk_count",
    "suggested_knowledge_base",
)


def as_timestamp(as_of: Column | datetime | str | None) -> Column:
    if as_of is None:
        return F.current_timestamp()
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def _with_defaults(docs: DataFrame) -> DataFrame:
    """Fill in the optional input columns."""
    have = set(docs.columns)

    def optional(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in have else default

    file_name = paths.name_of(F.col("relative_path"))
    suffix = paths.suffix(file_name)
    none = F.lit(None).cast("string")
    missing = F.when(F.col("text").isNull(), F.lit("missing"))
    status, issue = extract_dispatch(suffix, missing, none)
    if "content_sha256" in have:
        binary = F.when(F.col("size_bytes") > 0, F.col("content_sha256"))
    elif "content" in have:
        binary = text.binary_fingerprint(F.col("content"), F.col("size_bytes"))
    else:
        binary = F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "relative_path",
        file_name.alias("file_name"),
        suffix.alias("suffix"),
        optional("root_name", F.lit("")).alias("root_name"),
        optional("root_path", F.lit("")).alias("root_path"),
        F.col("size_bytes").cast("long").alias("size_bytes"),
        "modified_at",
        F.coalesce("text", F.lit("")).alias("text"),
        binary.alias("binary_fp"),
        optional("parse_status", status).alias("parse_status"),
        optional("parse_issue", issue).alias("parse_issue"),
        optional("document_scale", F.lit(0)).cast("long").alias("document_scale"),
        optional("scale_unit", F.lit("")).alias("scale_unit"),
        optional("layout_warnings", F.array().cast("array<string>")).alias("layout_warnings"),
    )


def _measure_text(docs: DataFrame, pack: RulePack) -> DataFrame:
    """Everything that needs the text, computed in the JVM; the text column ends
    here, except for the few rows whose folding needs Python."""
    body = F.col("text")
    # A NUL cannot occur in a path, so one string carries all names through folding.
    names = F.concat_ws(
        "\x00",
        F.col("root_name"),
        paths.stem(F.col("file_name")),
        F.array_join(paths.folders_of(F.col("relative_path")), "\x00"),
    )
    kept = [c for c in docs.columns if c != "text"]
    odd, rest, far = F.col("odd"), F.col("rest"), F.col("far")
    # Most tests look for what is neither an ASCII letter nor a space, so they scan the rest,
    # and most of those for what is not ASCII at all, so they scan what is left of it then.
    flagged = docs.select("*", normalize.residue(body).alias("rest"), names.alias("names"))
    flagged = flagged.select("*", normalize.far_residue(rest).alias("far"))
    flagged = flagged.select("*", normalize.is_odd(far).alias("odd"))
    # Case mapping keeps positions and counted characters; white space goes once
    # for the fingerprint, the content length and the garbled ratio.
    flagged = flagged.select(
        "*",
        F.when(~odd, F.lower(body)).alias("low"),
        # Digits on both sides of what the rest lacks may be none in a row.
        (risks.has_digit_run(rest, odd, far) & risks.has_digit_run(body, odd, far)).alias("digit_run"),
    )
    low, unspaced, bare = F.col("low"), F.col("unspaced"), F.col("bare")
    flagged = flagged.select("*", F.replace(low, F.lit(" "), F.lit("")).alias("unspaced"))
    flagged = flagged.select("*", normalize.drop_jvm_spaces(unspaced, rest, far).alias("bare"))
    words = normalize.spell_out(normalize.words_to_half_width(low, far), far)
    folded_bare = normalize.spell_out(normalize.to_half_width(bare, far), far)
    measured = flagged.select(
        *kept,
        F.when(odd, text.content_length(body))
        .otherwise(text.content_of_residue(body, rest, F.octet_length(low) - F.octet_length(unspaced), far))
        .alias("content_length"),
        F.when(odd, text.garbled_ratio(body))
        .otherwise(text.replacement_ratio(far, bare))
        .alias("garbled"),
        risks.risk_counts(body, F.col("digit_run"), rest, far).alias("risk_counts"),
        normalize.digest_of_bare(folded_bare).alias("jvm_fp"),
        F.when(~odd, topics.keyword_hits(words, pack, far)).alias("jvm_hits"),
        F.when(odd, body).alias("odd_text"),
        "names",
        normalize.is_odd(F.col("names")).alias("names_odd"),
    )
    # One Python node for the rare rows; it sees nulls for all others.
    odd_folded = normalize.fold_odd(F.col("odd_text"))
    names_folded = normalize.fold_odd(F.when(F.col("names_odd"), F.col("names")))
    folded_rows = measured.select(
        *kept,
        "content_length",
        "garbled",
        "risk_counts",
        "jvm_fp",
        "jvm_hits",
        F.col("odd_text").isNotNull().alias("is_odd"),
        odd_folded.alias("odd_folded"),
        F.when(F.col("names_odd"), names_folded)
        .otherwise(normalize.fold_jvm(F.col("names")))
        .alias("names_folded"),
    )
    return folded_rows.select(
        *kept,
        "content_length",
        "garbled",
        "risk_counts",
        F.when(F.col("is_odd"), normalize.digest_of_folded(F.col("odd_folded")))
        .otherwise(F.col("jvm_fp"))
        .alias("text_fp"),
        F.when(F.col("is_odd"), topics.keyword_hits(F.col("odd_folded"), pack))
        .otherwise(F.col("jvm_hits"))
        .alias("body_hits"),
        F.split("names_folded", "\x00").alias("folded"),
    )


def _name_features(docs: DataFrame, pack: RulePack) -> DataFrame:
    parts = paths.parts_of(F.col("relative_path"))
    folders = paths.folders_of(F.col("relative_path"))
    folded_root = F.get("folded", F.lit(0))
    folded_stem = F.get("folded", F.lit(1))
    folded_folders = F.slice(F.col("folded"), F.lit(3), F.greatest(F.size(folders), F.lit(0)))
    generic = folded_root.isin(*[normalize.python_fold(g) for g in pack.generic_folders])
    # Folding works name by name, so the folded anchor is the anchor of folded names.
    folded_anchor = F.when(
        generic, F.when(F.size(parts) > 1, F.get("folded", F.lit(2))).otherwise(F.lit(""))
    ).otherwise(folded_root)
    above = F.concat(paths.parts_of(F.col("root_path")), F.array("root_name"), folders)
    return docs.select(
        *[c for c in docs.columns if c != "folded"],
        folded_stem.alias("folded_stem"),
        folded_anchor.alias("folded_anchor"),
        topics.folder_text(folded_folders, pack).alias("folder_text"),
        paths.bad_name(F.col("file_name"), above, pack.bad_folders).alias("bad_name"),
        paths.version_key(folded_stem).alias("version_key"),
        paths.has_version_marker(folded_stem).alias("version_marker"),
        F.lower(F.concat_ws("/", "root_path", "root_name")).alias("root_key"),
        paths.parent_key(F.col("relative_path")).alias("parent_key"),
        paths.looks_like_copy(F.col("file_name")).alias("copy_named"),
        F.lower("relative_path").alias("path_key"),
        F.lower("file_name").alias("name_key"),
    )


def document_features(docs: DataFrame, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """Stage 1 without the verdict columns: text, name and path features."""
    return _name_features(_measure_text(_with_defaults(docs), pack), pack)


def document_rules(as_of: Column, pack: RulePack) -> list[Column]:
    """The rules that look at one document, in reporting order."""
    suffix, status = F.col("suffix"), F.col("parse_status")
    return [
        rules.rule_unreadable(status, F.col("parse_issue")),
        rules.rule_length(status, F.col("content_length"), suffix, pack),
        rules.rule_garbled(F.col("garbled"), pack),
        rules.rule_age(text.age_years(F.col("modified_at"), as_of), pack),
        rules.rule_name(F.col("bad_name")),
        *rules.rules_layout(suffix, F.col("layout_warnings")),
        rules.rule_attachment(paths.attachment_or_template(F.col("folded_stem"))),
        rules.rule_sensitive(F.col("risk_counts")),
    ]


def extract_features(
    docs: DataFrame, as_of: Column | datetime | str | None = None, pack: RulePack = DEFAULT_PACK
) -> DataFrame:
    """Stage 1: narrow, lazy, no shuffle. One row per document.

    Input columns: doc_id, relative_path, size_bytes, modified_at, text and,
    optionally, root_name, root_path, content or content_sha256, parse_status,
    parse_issue, document_scale, scale_unit, layout_warnings."""
    base = document_features(docs, pack)
    base = topics.with_topic_choice(topics.with_topic_scores(base, pack), pack)
    dropped = {"suffix", "garbled", "bad_name", "layout_warnings", "root_name", "root_path"}
    dropped |= {"folded_stem", "folded_anchor", "folder_text", "body_hits", "topic"}
    kind = classify_file(F.col("suffix"))
    return base.select(
        *[c for c in base.columns if c not in dropped],
        kind["category"].alias("category"),
        kind["display_type"].alias("display_type"),
        kind["scan_note"].alias("scan_note"),
        F.coalesce(F.nullif("suffix", F.lit("")), F.lit(rp.NO_EXTENSION)).alias("extension"),
        rules.fired(document_rules(as_timestamp(as_of), pack)).alias("findings"),
        topics.specialise_topic(F.col("topic"), F.col("folded_anchor"), pack).alias("topic"),
    )


def finalize_verdicts(features: DataFrame, marks: DataFrame) -> DataFrame:
    """Add the cross-document rules and write ids, risks and counts to the row."""
    joined = features.join(marks, "doc_id", "left")
    found = F.concat(
        F.col("findings"),
        rules.fired(
            [
                rules.rule_duplicate(F.col("duplicate_group").isNotNull(), F.col("is_primary")),
                rules.rule_version(F.col("version_group").isNotNull()),
            ]
        ),
    )
    flat = joined.withColumn("findings", found)
    verdict = rules.accumulate(F.col("findings"))
    return flat.select(
        *[c for c in RECORD_COLUMNS if c in features.columns],
        F.lit(rp.SCANNED).alias("scan_status"),
        *[column.alias(name) for name, column in verdict.items()],
        F.coalesce("duplicate_group", F.lit("")).alias("duplicate_group"),
        F.coalesce("version_group", F.lit("")).alias("version_group"),
        risks.risk_text(F.col("risk_counts")).alias("sensitive_risks"),
        risks.risk_total(F.col("risk_counts")).alias("sensitive_risk_count"),
        "topic",
        "path_key",
        "name_key",
    )


@dataclass
class Audit:
    """Verdict rows plus what the reports need besides them."""

    records: DataFrame
    pack: RulePack
    skipped: DataFrame | None = None
    errors: DataFrame | None = None
    scratch: Scratch | None = None

    def table(self) -> DataFrame:
        """The audit row of every document, without the engine's sort keys."""
        return self.records.select(*RECORD_COLUMNS)

    def close(self) -> None:
        """Delete the audit's scratch tables; its records cannot be read afterwards."""
        if self.scratch:
            self.scratch.drop()


def analyze(
    docs: DataFrame,
    as_of: Column | datetime | str | None = None,
    pack: RulePack = DEFAULT_PACK,
    hot_rows: int = HOT_ROWS,
) -> Audit:
    """Audit a table of documents (see ``extract_features`` for its columns).

    Runs jobs: features, group tables and verdicts are written to the shared
    scratch area once each, so no later report reads a text again."""
    with Scratch(docs.sparkSession) as scratch:
        features = materialize(extract_features(docs, as_of, pack), "features")
        marks = groups.cross_document_marks(features, pack, hot_rows)
        assigned = topics.assign_topics(finalize_verdicts(features, marks), pack, features)
        return Audit(materialize(assigned, "verdicts"), pack, scratch=scratch)
