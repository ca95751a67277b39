"""Per-document rules: each rule is one struct-valued column, null when it does
not fire. A document's findings are the ordered array of its fired rules, so
the whole rule set is evaluated in one projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rulepack as rp
from ..functions import risks
from ..rulepack import RulePack

STATUS_RANK = {s: i for i, s in enumerate(rp.USE_STATUSES)}
PRIORITY_RANK = {p: i for i, p in enumerate(rp.PRIORITIES)}


def finding(issue, advice: str, status: str, priority: str) -> Column:
    return F.struct(
        (issue if isinstance(issue, Column) else F.lit(issue)).alias("issue"),
        F.lit(advice).alias("advice"),
        F.lit(STATUS_RANK[status]).alias("status_rank"),
        F.lit(PRIORITY_RANK[priority]).alias("priority_rank"),
    )


def _or(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def rule_unreadable(parse_status: Column, parse_issue: Column) -> Column:
    special = _or(parse_issue, rp.ISSUE_SPECIAL_DEFAULT)
    retry = "请按问题说明处理后重新体检"
    return (
        F.when(
            parse_status == rp.UNAVAILABLE,
            finding(
                _or(parse_issue, rp.ISSUE_UNREADABLE_DEFAULT),
                "请转换为工具支持的常用文档格式",
                rp.NOT_READY,
                rp.HIGH,
            ),
        )
        .when(
            (parse_status == rp.SPECIAL) & special.rlike("|".join(rp.BLOCKING_WORDS)),
            finding(special, retry, rp.NOT_READY, rp.HIGH),
        )
        .when(parse_status == rp.SPECIAL, finding(special, retry, rp.NEEDS_WORK, rp.MEDIUM))
    )


def rule_length(parse_status: Column, content_length: Column, suffix: Column, pack: RulePack) -> Column:
    direct = parse_status == rp.DIRECT
    return (
        F.when(
            direct & (content_length == 0),
            finding(
                "没有读取到有效内容", "请确认文件是否为空，或重新提供包含正文的版本", rp.NOT_READY, rp.HIGH
            ),
        )
        .when(
            direct & (content_length < pack.min_text),
            finding("有效内容过少", "请确认内容是否完整、是否需要保留", rp.NEEDS_WORK, rp.MEDIUM),
        )
        .when(
            direct & (content_length < pack.short_text) & (suffix != ".xlsx"),
            finding("内容较短", "建议人工确认内容是否完整", rp.NEEDS_WORK, rp.LOW),
        )
    )


def rule_garbled(ratio: Column, pack: RulePack) -> Column:
    return F.when(
        ratio >= pack.garbled_block,
        finding("内容主要是乱码", "建议重新导出或转换文件格式", rp.NOT_READY, rp.HIGH),
    ).when(
        ratio >= pack.garbled_warn,
        finding("部分文字可能是乱码", "建议检查正文并重新导出文件", rp.NEEDS_WORK, rp.MEDIUM),
    )


def rule_age(years: Column, pack: RulePack) -> Column:
    return F.when(
        years >= pack.old_years,
        finding("超过5年未更新", "请确认资料目前是否仍然有效", rp.NEEDS_WORK, rp.LOW),
    ).when(
        years >= pack.aging_years,
        finding("超过3年未更新", "建议确认资料目前是否仍在使用", rp.NEEDS_WORK, rp.LOW),
    )


def rule_name(is_bad: Column) -> Column:
    return F.when(
        is_bad,
        finding(
            "文件名称或归档位置不清楚", "建议改成能够说明内容和版本的名称", rp.NEEDS_WORK, rp.LOW
        ),
    )


def rules_layout(suffix: Column, warnings: Column) -> list[Column]:
    """Up to two findings: light and complex spreadsheet layout, or slide layout."""
    light = F.filter(warnings, lambda w: w.contains(rp.PREHEADER_MARK))
    heavy = F.filter(warnings, lambda w: ~w.contains(rp.PREHEADER_MARK))

    def text(prefix: str, items: Column) -> Column:
        return F.concat(F.lit(prefix + "（"), F.array_join(items, "、"), F.lit("）"))

    return [
        F.when(
            (suffix == ".xlsx") & (F.size(light) > 0),
            finding(
                text("Excel表头前有标题或说明", light),
                "建议把表格标题写入文件名或单独的资料说明，并让正式数据区域从单行表头开始；删除表头前不必要的空行，确保每行是一条完整记录",
                rp.NEEDS_WORK,
                rp.LOW,
            ),
        ),
        F.when(
            (suffix == ".xlsx") & (F.size(heavy) > 0),
            finding(
                text("Excel排版较复杂", heavy),
                "建议整理成单行表头、每行一条记录的明细表；公式列应补充字段说明或保留可核对的结果值，复杂原表可作为附件下载",
                rp.NEEDS_WORK,
                rp.MEDIUM,
            ),
        ).when(
            (suffix == ".pptx") & (F.size(warnings) > 0),
            finding(
                text("PPT排版较复杂", warnings),
                "建议按页面补充标题和文字摘要；重要流程、图表和图片另写文字说明，复杂原PPT可作为参考附件下载",
                rp.NEEDS_WORK,
                rp.MEDIUM,
            ),
        ),
    ]


def rule_attachment(is_attachment: Column) -> Column:
    return F.when(
        is_attachment,
        finding(
            "附件/模板资料，建议单独管理",
            "建议集中放到附件/模板下载区，并在相关知识说明中补充下载地址或获取路径；不建议把附件正文作为主要检索内容",
            rp.READY,
            rp.MEDIUM,
        ),
    )


def rule_sensitive(counts: Column) -> Column:
    return F.when(
        risks.has_high_impact(counts),
        finding("可能包含敏感信息", "请确认资料的使用对象和访问范围", rp.NEEDS_WORK, rp.MEDIUM),
    ).when(
        risks.risk_total(counts) > 0,
        finding(
            "包含联系方式，建议确认展示范围",
            "如属于公开业务联系方式可直接保留，否则建议脱敏或限制展示",
            rp.READY,
            rp.LOW,
        ),
    )


def rule_duplicate(is_member: Column, is_primary: Column) -> Column:
    return F.when(
        is_member & is_primary,
        finding(rp.ISSUE_DUPLICATE_KEEP, rp.ADVICE_DUPLICATE_KEEP, rp.NEEDS_WORK, rp.MEDIUM),
    ).when(
        is_member,
        finding(rp.ISSUE_DUPLICATE_DROP, rp.ADVICE_DUPLICATE_DROP, rp.NOT_READY, rp.MEDIUM),
    )


def rule_version(is_member: Column) -> Column:
    return F.when(
        is_member, finding(rp.ISSUE_VERSION, rp.ADVICE_VERSION, rp.NEEDS_WORK, rp.MEDIUM)
    )


def fired(rules: list[Column]) -> Column:
    """Ordered array of the rules that fired."""
    return F.array_compact(F.array(*rules))


def accumulate(findings: Column) -> dict[str, Column]:
    """Issues and advice once each in rule order; the highest status and priority."""
    return {
        "issues": F.array_join(F.array_distinct(F.transform(findings, lambda f: f["issue"])), "；"),
        "recommendation": F.array_join(
            F.array_distinct(
                F.filter(F.transform(findings, lambda f: f["advice"]), lambda a: a != "")
            ),
            "；",
        ),
        "use_status": _label(rp.USE_STATUSES, findings, "status_rank"),
        "priority": _label(rp.PRIORITIES, findings, "priority_rank"),
    }


def _label(labels: tuple[str, ...], findings: Column, rank: str) -> Column:
    top = F.coalesce(F.array_max(F.transform(findings, lambda f: f[rank])), F.lit(0))
    return F.get(F.array(*[F.lit(x) for x in labels]), top)
