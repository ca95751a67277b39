"""Report datasets over the verdict table.

Every dataset is an aggregate of a few rows, or the first few documents per
label; no document list is ever gathered. Numbers are joined as scalar
subqueries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rulepack as rp
from ..functions import display
from ..operators import groups
from ..rulepack import DEFAULT_PACK, RulePack
from ..session import materialize

ORDER = groups.ORDER


def _any_marker(issues: Column, markers) -> Column:
    return reduce(lambda a, b: a | b, [issues.contains(m) for m in markers])


def _rows(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed dimension (labels of the rule pack)."""
    return df.sparkSession.createDataFrame(rows, schema)


# --- totals and distributions ------------------------------------------------


def total_counts(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"),
    )


def category_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def type_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("display_type").agg(F.count(F.lit(1)).alias("n"))


class Rollup:
    """Every count the report shows, one row per topic (see ``rollup``)."""

    def __init__(self, table: DataFrame):
        self.table = table


def rollup(records: DataFrame, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """One pass over the verdicts: conditional aggregates per topic.

    All of them add up (or take a minimum or maximum) over topics, so one result of
    a few rows serves every chart, metric, plan and sentence of the report."""
    parse, use, issues = F.col("parse_status"), F.col("use_status"), F.col("issues")
    place = F.struct(*ORDER)
    kind = display.document_kind(F.col("display_type"))
    direct = parse == rp.DIRECT
    scanned = F.col("display_type").startswith("PDF") & F.col("parse_issue").contains("疑似扫描文件")

    counts = {
        "direct": direct,
        "special": parse == rp.SPECIAL,
        "unavailable": parse == rp.UNAVAILABLE,
        "ready": use == rp.READY,
        "work": use == rp.NEEDS_WORK,
        "blocked": use == rp.NOT_READY,
        "duplicates": (F.col("duplicate_group") != "") | (F.col("version_group") != ""),
        "scanned": scanned,
    }
    counts |= {f"k{i}": kind == k for i, k in enumerate(rp.DOCUMENT_KINDS)}
    bin_label = length_bin(F.col("content_length"), pack)
    counts |= {f"b{i}": direct & (bin_label == b[0]) for i, b in enumerate(pack.length_bins)}
    counts |= {
        f"r{i}": (issues != "") & (F.col("priority") == p) for i, (p, _) in enumerate(rp.PRIORITY_NOTES)
    }
    counts |= {f"p{i}": _any_marker(issues, p.markers) for i, p in enumerate(pack.problems)}
    votes = [(i, _any_marker(issues, x.markers)) for i, x in enumerate(pack.main_issues)]
    by_topic = records.groupBy(F.col("suggested_knowledge_base").alias("topic")).agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(F.when(scanned, F.col("document_scale"))), F.lit(0)).alias("pages"),
        F.min(place).alias("first"),
        *[F.count_if(test).alias(name) for name, test in counts.items()],
        *[F.count_if(hit).alias(f"n{i}") for i, hit in votes],
        *[F.min(F.when(hit, place)).alias(f"f{i}") for i, hit in votes],
    )

    def groups_of(column: str) -> Column:
        """Groups seen in these records, whatever their numbers; topics may share one."""
        named = records.select(column).filter(F.col(column) != "")
        return named.agg(F.countDistinct(column)).scalar()

    return by_topic.withColumns(
        {"duplicate_groups": groups_of("duplicate_group"), "version_groups": groups_of("version_group")}
    )


def _topics(data: DataFrame | Rollup, pack: RulePack) -> DataFrame:
    return data.table if isinstance(data, Rollup) else rollup(data, pack)


def _totals(data: DataFrame | Rollup, pack: RulePack) -> DataFrame:
    """The rollup over all topics: one row, also for an empty corpus."""
    table = _topics(data, pack)
    keep_max = ("duplicate_groups", "version_groups")
    sums = [c for c, t in table.dtypes if t == "bigint" and c not in keep_max]
    return table.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in keep_max],
    )


def _listed(totals: DataFrame, labels: list[tuple[str, Column]], keep_zero: bool) -> DataFrame:
    """(ord, label, n) of labelled counts of the one-row totals, in list order."""
    rows = [
        F.struct(F.lit(i).alias("ord"), F.lit(label).alias("label"), n.alias("n"))
        for i, (label, n) in enumerate(labels, start=1)
    ]
    listed = totals.select(F.inline(F.array(*rows)))
    return listed if keep_zero else listed.filter(F.col("n") > 0)


def key_metrics(data: DataFrame | Rollup, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """(ord, metric, value, note): six headline numbers."""
    total = F.col("total")

    def docs(count: str) -> Column:
        return F.concat(display.grouped(F.col(count)), F.lit("份"))

    def share(count: str) -> Column:
        return F.concat(F.lit("占全部资料的"), display.percent(F.col(count), total))

    rows = [
        (F.lit("总文档数"), docs("total"), F.lit("本次盘点的全部资料")),
        (F.lit("总数据量"), display.format_size(F.col("bytes")), F.lit("资料占用的本地空间")),
        (F.lit("可直接解析"), docs("direct"), share("direct")),
        (F.lit("需特殊处理"), docs("special"), F.lit("含扫描、加密、损坏或旧格式")),
        (
            F.lit("疑似重复文档"),
            docs("duplicates"),
            F.concat(F.lit("涉及"), display.grouped(F.col("duplicate_groups") + F.col("version_groups")), F.lit("组重复或多版本资料")),
        ),
        (F.lit("暂无法解析"), docs("unavailable"), share("unavailable")),
    ]
    structs = [
        F.struct(F.lit(i).alias("ord"), m.alias("metric"), v.alias("value"), n.alias("note"))
        for i, (m, v, n) in enumerate(rows, start=1)
    ]
    return _totals(data, pack).select(F.inline(F.array(*structs)))


def _donut(counts: DataFrame, total: Column) -> DataFrame:
    """Adds the percent text, share and running offset of shares.
    Windows run over the labels of one chart."""
    before = Window.partitionBy(F.lit(0)).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)

    def share(n: Column) -> Column:
        return F.coalesce(F.when(F.col("total") > 0, n / F.col("total")), F.lit(0.0))

    return (
        counts.withColumn("total", total)
        .withColumn("percent", display.percent(F.col("n"), F.col("total")))
        .withColumn("share", share(F.col("n")))
        .withColumn("offset", share(F.sum("n").over(before)))
        .drop("total")
    )


def _bars(counts: DataFrame) -> DataFrame:
    """Adds the share of the largest value."""
    largest = F.max("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("of_max", F.when(largest > 0, F.col("n") / largest).otherwise(F.lit(0.0)))


def format_distribution(data: DataFrame | Rollup, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """(ord, label, n): five document kinds and the rest, empty ones dropped."""
    counts = [(k, F.col(f"k{i}")) for i, k in enumerate(rp.DOCUMENT_KINDS)]
    return _listed(_totals(data, pack), counts, keep_zero=False)


def length_bin(length: Column, pack: RulePack = DEFAULT_PACK) -> Column:
    out = F.lit(pack.length_bins[-1][0])
    for label, _, upper in reversed(pack.length_bins[:-1]):
        out = F.when(length < upper, F.lit(label)).otherwise(out)
    return out


def length_distribution(data: DataFrame | Rollup, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """(ord, label, n): every bin, also empty, then the uncountable ones if any."""
    counts = [(b[0], F.col(f"b{i}")) for i, b in enumerate(pack.length_bins)]
    counts.append((rp.UNCOUNTED_BIN, F.col("total") - F.col("direct")))
    rows = _listed(_totals(data, pack), counts, keep_zero=True)
    return rows.filter((F.col("label") != rp.UNCOUNTED_BIN) | (F.col("n") > 0))


def length_note(data: DataFrame | Rollup, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """(note): one sentence on what the length chart leaves out."""
    uncounted = F.col("total") - F.col("direct")
    return _totals(data, pack).select(
        F.when(
            F.col("scanned") > 0,
            F.format_string(
                "其中%,d份扫描版PDF共%,d页，因没有可读取的文字层，单独列为“暂无法统计”，不计入500字以内。",
                "scanned",
                "pages",
            ),
        )
        .when(
            uncounted > 0,
            F.format_string(
                "有%,d份资料暂时无法可靠统计字数，已单独列出。其余篇幅按工具能够读取到的文字统计。",
                uncounted,
            ),
        )
        .otherwise("篇幅根据工具能够读取到的文字统计，仅用于了解资料的大致情况。")
        .alias("note")
    )


def _status_counts(data: DataFrame | Rollup, pack: RulePack) -> DataFrame:
    counts = list(zip(rp.USE_STATUSES, (F.col("ready"), F.col("work"), F.col("blocked"))))
    return _listed(_totals(data, pack), counts, keep_zero=True)


def _total(data: DataFrame | Rollup, pack: RulePack) -> Column:
    return _totals(data, pack).select("total").scalar()


def status_distribution(data: DataFrame | Rollup, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """(ord, label, n, percent): the three use statuses, empty ones kept."""
    return (
        _status_counts(data, pack)
        .withColumn("total", _total(data, pack))
        .select("ord", "label", "n", display.percent(F.col("n"), F.col("total")).alias("percent"))
    )


def chart_series(data: DataFrame | Rollup, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """(chart, ord, label, n, percent, share, offset, of_max): the format and status
    charts show shares of the whole, the length and problem charts bars."""
    total = _total(data, pack)
    charts = {
        "format": _donut(format_distribution(data, pack), total),
        "status": _donut(_status_counts(data, pack), total),
        "length": _bars(length_distribution(data, pack)),
        "problem": _bars(top_problems(data, pack).drop("advice")),
    }
    named = [df.select(F.lit(name).alias("chart"), "*") for name, df in charts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


# --- problems ----------------------------------------------------------------


def problem_labels(issues: Column, pack: RulePack = DEFAULT_PACK) -> Column:
    """Array of the problems a document has."""
    return F.array_compact(
        F.array(*[F.when(_any_marker(issues, p.markers), F.lit(p.label)) for p in pack.problems])
    )


def affected_records(records: DataFrame, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """(label, document columns…): one row per document and problem it has."""
    return records.select(F.explode(problem_labels(F.col("issues"), pack)).alias("label"), "*")


def _matching(parts: Column, markers) -> Column:
    return F.array_join(F.filter(parts, lambda x: _any_marker(x, markers)), "；")


def example_detail(label: Column, pack: RulePack = DEFAULT_PACK) -> Column:
    """What to show for a document under a problem (expects record columns)."""
    issues, parts = F.col("issues"), F.split("issues", "；")
    group = F.coalesce(
        F.nullif("duplicate_group", F.lit("")), F.nullif("version_group", F.lit("")), F.lit("")
    )
    matching = F.lit(None).cast("string")
    for p in pack.problems:
        matching = F.when(label == p.label, _matching(parts, p.markers)).otherwise(matching)
    return (
        F.when(
            label == rp.PROBLEM_SENSITIVE,
            F.coalesce(F.nullif("sensitive_risks", F.lit("")), F.lit("检测到敏感信息特征")),
        )
        .when(
            label == rp.PROBLEM_DUPLICATES,
            F.concat(issues, F.when(group != "", F.concat(F.lit("；所属"), group)).otherwise("")),
        )
        .when(
            label.isin(rp.PROBLEM_SCANNED, rp.PROBLEM_UNREADABLE) & (F.col("parse_issue") != ""),
            F.col("parse_issue"),
        )
        .otherwise(F.coalesce(F.nullif(matching, F.lit("")), issues))
    )


def problem_counts(data: DataFrame | Rollup, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """(label, n, advice): documents per problem, zero ones dropped."""
    rows = F.array(
        *[
            F.struct(F.lit(p.label).alias("label"), F.col(f"p{i}").alias("n"), F.lit(p.advice).alias("advice"))
            for i, p in enumerate(pack.problems)
        ]
    )
    return _totals(data, pack).select(F.inline(rows)).filter(F.col("n") > 0)


def top_problems(data: DataFrame | Rollup, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """(ord, label, n, advice): the largest problems; the forced one replaces the
    last when it would not be among them. Windows run over the problem labels."""
    whole = Window.partitionBy(F.lit(0))
    ranked = problem_counts(data, pack).withColumn(
        "rn", F.row_number().over(whole.orderBy(F.desc("n"), "label"))
    )
    forced = F.max(F.when(F.col("label") == pack.forced_problem, F.col("rn"))).over(whole)
    is_forced = F.col("label") == pack.forced_problem
    room = F.when(F.coalesce(F.col("forced"), F.lit(0)) > pack.top_problems, pack.top_problems - 1)
    chosen = ranked.withColumn("forced", forced).filter(
        is_forced | (F.col("rn") <= F.coalesce(room, F.lit(pack.top_problems)))
    )
    return chosen.withColumn("ord", F.row_number().over(whole.orderBy("rn"))).select(
        "ord", "label", "n", "advice"
    )


def _first_per_label(rows: DataFrame, label: str, limit: int) -> DataFrame:
    """First ``limit`` rows per label in inventory order. The rank stands alone in
    its projection so each input partition keeps only ``limit`` rows per label
    before anything is shuffled."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*ORDER))
    return rows.withColumn("ord", rank).filter(F.col("ord") <= limit)


def problem_examples(
    records: DataFrame, pack: RulePack = DEFAULT_PACK, data: Rollup | None = None
) -> DataFrame:
    """(label, ord, relative_path, detail, remaining): first documents per problem."""
    shown = _first_per_label(affected_records(records, pack), "label", pack.problem_examples)
    shown = shown.select("label", "ord", "relative_path", example_detail(F.col("label"), pack).alias("detail"))
    counts = problem_counts(data or records, pack).select("label", "n")
    limit = pack.problem_examples
    return shown.join(F.broadcast(counts), "label").select(
        "label",
        "ord",
        "relative_path",
        "detail",
        F.greatest(F.col("n") - limit, F.lit(0)).alias("remaining"),
    )


def status_detail() -> Column:
    """First non-empty explanation of a record, with its risks when sensitive."""
    detail = F.coalesce(
        F.nullif("issues", F.lit("")),
        F.nullif("parse_issue", F.lit("")),
        F.nullif("scan_note", F.lit("")),
        F.lit("需要人工确认"),
    )
    risks = F.col("sensitive_risks")
    return F.when(
        (risks != "") & detail.contains("敏感信息"), F.concat(detail, F.lit("（"), risks, F.lit("）"))
    ).otherwise(detail)


def status_examples(
    records: DataFrame, pack: RulePack = DEFAULT_PACK, data: Rollup | None = None
) -> DataFrame:
    """(use_status, ord, relative_path, detail, remaining) of the two statuses that
    need work."""
    pending = records.filter(F.col("use_status").isin(*rp.STATUS_SUFFIX))
    suffix = F.lit("")
    for status, words in rp.STATUS_SUFFIX.items():
        suffix = F.when(F.col("use_status") == status, F.lit(words)).otherwise(suffix)
    shown = _first_per_label(pending, "use_status", pack.status_examples).select(
        "use_status",
        "ord",
        "relative_path",
        F.concat(status_detail(), F.lit("，"), suffix, F.lit("。")).alias("detail"),
    )
    counts = _status_counts(data or records, pack).select(F.col("label").alias("use_status"), "n")
    return shown.join(F.broadcast(counts), "use_status").select(
        "use_status",
        "ord",
        "relative_path",
        "detail",
        F.greatest(F.col("n") - pack.status_examples, F.lit(0)).alias("remaining"),
    )


# --- topics ------------------------------------------------------------------


def situation(ready: Column, blocked: Column, total: Column) -> Column:
    return (
        F.when(ready / total >= 0.7, rp.SITUATION_READY)
        .when(blocked / total >= 0.3, rp.SITUATION_BLOCKED)
        .otherwise(rp.SITUATION_PARTLY)
    )


def _main_issue(pack: RulePack) -> Column:
    """Most frequent label; ties go to the label met first in inventory order."""
    labels = [
        F.struct(
            F.lit(label.friendly).alias("friendly"),
            F.col(f"n{i}").alias("n"),
            F.col(f"f{i}").alias("first"),
            F.lit(i).alias("ord"),
        )
        for i, label in enumerate(pack.main_issues)
    ]
    seen = F.filter(F.array(*labels), lambda x: x["n"] > 0)
    ranked = F.array_sort(
        F.transform(
            seen,
            lambda x: F.struct(
                (-x["n"]).alias("neg"), x["first"].alias("first"), x["ord"].alias("ord"), x["friendly"].alias("friendly")
            ),
        )
    )
    best = F.get(ranked, F.lit(0))
    return F.when(
        F.size(ranked) > 0,
        F.concat(best["friendly"], F.lit("（"), (-best["neg"]).cast("string"), F.lit("份）")),
    ).otherwise(rp.NO_MAIN_ISSUE)


def topic_situation(data: DataFrame | Rollup, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """(topic, situation)."""
    state = situation(F.col("ready"), F.col("blocked"), F.col("total"))
    return _topics(data, pack).select("topic", state.alias("situation"))


def main_issue(data: DataFrame | Rollup, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """(topic, main_issue)."""
    return _topics(data, pack).select("topic", _main_issue(pack).alias("main_issue"))


def category_lookup(topics: DataFrame, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """Adds the description of each topic name from the rule pack."""
    known = {**pack.descriptions, rp.PENDING: rp.PENDING_DESCRIPTION}
    dim = _rows(topics, sorted(known.items()), "topic string, description string")
    return topics.join(F.broadcast(dim), "topic", "left")


def topic_plan(data: DataFrame | Rollup, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """(ord, name, description, document_count, current_situation, main_issue): the
    proposed collections by size, pending documents included."""
    facts = category_lookup(_topics(data, pack), pack)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("total"), "first")
    state = situation(F.col("ready"), F.col("blocked"), F.col("total"))
    return facts.select(
        F.row_number().over(order).alias("ord"),
        F.col("topic").alias("name"),
        "description",
        F.col("total").alias("document_count"),
        F.when(F.col("topic") == rp.PENDING, rp.PENDING_SITUATION).otherwise(state).alias("current_situation"),
        _main_issue(pack).alias("main_issue"),
    )


# --- sentences, lists, summary -------------------------------------------------


def _joined(rows: DataFrame, text: Column, empty: str) -> Column:
    """Ordered '、' list of a handful of labelled rows as a scalar."""
    parts = F.transform(
        F.sort_array(F.collect_list(F.struct("ord", text.alias("text")))), lambda x: x["text"]
    )
    return rows.agg(
        F.coalesce(F.nullif(F.array_join(parts, "、"), F.lit("")), F.lit(empty))
    ).scalar()


def conclusions(data: DataFrame | Rollup, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """(ord, paragraph): five sentences."""
    top = top_problems(data, pack).filter(F.col("ord") <= 3)
    plan = topic_plan(data, pack).filter(F.col("name") != rp.PENDING)
    facts = _totals(data, pack).select(
        "*",
        _joined(top, F.concat("label", F.lit("（"), display.grouped(F.col("n")), F.lit("份）")), rp.NO_MAIN_ISSUE).alias(
            "problem_text"
        ),
        _joined(plan, F.col("name"), "暂未形成明确建议").alias("plan_text"),
    )
    n = {c: display.grouped(F.col(c)) for c in ("total", "direct", "special", "duplicates", "unavailable", "ready", "work", "blocked")}
    p = {c: display.percent(F.col(c), F.col("total")) for c in ("ready", "work", "blocked")}
    sentences = [
        F.format_string("本次共检查%s份资料，总数据量%s。", n["total"], display.format_size(F.col("bytes"))),
        F.format_string(
            "从读取情况看：%s份可直接解析，%s份需特殊处理，%s份疑似重复，%s份暂时无法解析。",
            n["direct"],
            n["special"],
            n["duplicates"],
            n["unavailable"],
        ),
        F.format_string(
            "从入库情况看：%s份（%s）未发现明显阻碍；%s份（%s）需要先整理；%s份（%s）不建议现在进入知识库。",
            n["ready"],
            p["ready"],
            n["work"],
            p["work"],
            n["blocked"],
            p["blocked"],
        ),
        F.format_string("其中最需要处理的问题是：%s。", "problem_text"),
        F.format_string("建议规划知识库：%s。", "plan_text"),
    ]
    rows = [F.struct(F.lit(i).alias("ord"), s.alias("paragraph")) for i, s in enumerate(sentences, start=1)]
    return facts.select(F.inline(F.array(*rows)))


def use_standards(data: DataFrame | Rollup, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """(ord, label, n, percent, description): what each status means."""
    return _described(status_distribution(data, pack), rp.STATUS_STANDARDS)


def priority_overview(data: DataFrame | Rollup, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """(ord, label, n, description) over the documents with issues."""
    counts = [(p, F.col(f"r{i}")) for i, (p, _) in enumerate(rp.PRIORITY_NOTES)]
    return _described(_listed(_totals(data, pack), counts, keep_zero=True), rp.PRIORITY_NOTES)


def _described(rows: DataFrame, notes) -> DataFrame:
    text = F.lit("")
    for label, description in notes:
        text = F.when(F.col("label") == label, F.lit(description)).otherwise(text)
    return rows.withColumn("description", text)


def rectification_list(records: DataFrame) -> DataFrame:
    """Documents with issues in inventory order, ready for a spreadsheet."""
    guard = display.formula_guard
    return records.filter(F.col("issues") != "").orderBy(*ORDER).select(
        guard(F.col("file_name")).alias("file_name"),
        guard(F.col("relative_path")).alias("relative_path"),
        "use_status",
        guard(F.col("issues")).alias("issues"),
        guard(F.col("recommendation")).alias("recommendation"),
        "priority",
        "suggested_knowledge_base",
    )


def inventory_list(records: DataFrame) -> DataFrame:
    """Every document in inventory order, ready for a spreadsheet."""
    guard = display.formula_guard
    return records.orderBy(*ORDER).select(
        guard(F.col("file_name")).alias("file_name"),
        guard(F.col("relative_path")).alias("relative_path"),
        "display_type",
        display.size_mb(F.col("size_bytes")).alias("size_mb"),
        F.col("modified_at").cast("timestamp_ntz").alias("modified_at"),
        "use_status",
        guard(F.col("issues")).alias("issues"),
        "suggested_knowledge_base",
    )


def run_summary(records: DataFrame, skipped: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """One row: totals, counts per status as maps, skipped and failed files."""

    def counts(column: str) -> Column:
        grouped = records.groupBy(F.col(column).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        return grouped.agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n"))))
        ).scalar()

    def number(df: DataFrame | None, value: Column) -> Column:
        return F.lit(0).cast("long") if df is None else df.agg(value).scalar()

    return total_counts(records).select(
        "total_files",
        "total_size_bytes",
        counts("parse_status").alias("parse_counts"),
        counts("use_status").alias("use_counts"),
        number(skipped, F.sum("skipped_system_files")).alias("skipped_system_files"),
        number(errors, F.count(F.lit(1))).alias("access_errors_count"),
    )


def summary_json(summary: DataFrame) -> DataFrame:
    return summary.select(F.to_json(F.struct("*")).alias("summary"))


def build_report(records: DataFrame, pack: RulePack = DEFAULT_PACK) -> dict[str, DataFrame]:
    """All report datasets by name (``records`` as returned by ``analyze``).

    Runs one job for the rollup; besides it only the two example lists read the
    verdicts again."""
    data = Rollup(materialize(rollup(records, pack), "rollup"))
    return {
        "conclusions": conclusions(data, pack),
        "key_metrics": key_metrics(data, pack),
        "format_distribution": format_distribution(data, pack),
        "length_distribution": length_distribution(data, pack),
        "length_note": length_note(data, pack),
        "status_distribution": status_distribution(data, pack),
        "use_standards": use_standards(data, pack),
        "status_examples": status_examples(records, pack, data),
        "top_problems": top_problems(data, pack),
        "problem_examples": problem_examples(records, pack, data),
        "chart_series": chart_series(data, pack),
        "topic_plan": topic_plan(data, pack),
        "priority_overview": priority_overview(data, pack),
    }


def report_datasets(records: DataFrame, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """The report as one table (section, ord, label, value, note)."""

    def part(section: str, df: DataFrame, ord_: str, label: Column, value: Column, note: Column) -> DataFrame:
        return df.select(
            F.lit(section).alias("section"),
            F.col(ord_).cast("int").alias("ord"),
            label.alias("label"),
            value.cast("string").alias("value"),
            note.alias("note"),
        )

    d = build_report(records, pack)
    none = F.lit("")
    numbered_note = d["length_note"].select(F.lit(1).alias("ord"), "note")
    sections = [
        part("conclusions", d["conclusions"], "ord", none, F.col("paragraph"), none),
        part("key_metrics", d["key_metrics"], "ord", F.col("metric"), F.col("value"), F.col("note")),
        part("format_distribution", d["format_distribution"], "ord", F.col("label"), F.col("n"), none),
        part("length_distribution", d["length_distribution"], "ord", F.col("label"), F.col("n"), none),
        part("length_note", numbered_note, "ord", none, F.col("note"), none),
        part("status_distribution", d["use_standards"], "ord", F.col("label"), F.col("n"), F.col("description")),
        part("status_examples", d["status_examples"], "ord", F.col("use_status"), F.col("relative_path"), F.col("detail")),
        part("top_problems", d["top_problems"], "ord", F.col("label"), F.col("n"), F.col("advice")),
        part("problem_examples", d["problem_examples"], "ord", F.col("label"), F.col("relative_path"), F.col("detail")),
        part("topic_plan", d["topic_plan"], "ord", F.col("name"), F.col("document_count"), F.col("main_issue")),
        part("priority_overview", d["priority_overview"], "ord", F.col("label"), F.col("n"), F.col("description")),
    ]
    return reduce(DataFrame.unionByName, sections)
