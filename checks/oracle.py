"""DuckDB SQL that computes each registered query in its own way.

The SQL is assembled from common table expressions; a query includes the ones
it needs. Word lists come from the rule pack as data.
"""

from __future__ import annotations

import re

from corpuscope import rulepack as rp
from corpuscope.rulepack import DEFAULT_PACK as PACK

from . import fixtures


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
FULL = "，；：（）￥"
HALF = ",;:()¥"


def content_length(col: str) -> str:
    return f"length(regexp_replace({col}, '[^A-Za-z0-9㐀-鿿]', '', 'g'))"


def garbled(col: str) -> str:
    bad = rf"length(regexp_replace({col}, '[^\x{{fffd}}\x01-\x08\x0e-\x1b\x7f-\x84\x86-\x9f]', '', 'g'))"
    seen = f"length(regexp_replace({col}, '{SPACE}', '', 'g'))"
    return f"CASE WHEN {seen} = 0 THEN 0.0::DOUBLE ELSE {bad}::DOUBLE / {seen} END"


def packed(col: str) -> str:
    folded = f"translate(replace(lower({col}), 'ß', 'ss'), '{FULL}', '{HALF}')"
    return f"regexp_replace({folded}, '{SPACE}', '', 'g')"


def text_fp(col: str) -> str:
    return f"CASE WHEN {packed(col)} = '' THEN '' ELSE sha256({packed(col)}) END"


PHONE = "len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: regexp_full_match(x, '1[3-9][0-9]{9}')))"
ID = """len(list_filter(regexp_extract_all(text, '[0-9]+[Xx]?'), lambda r:
  length(rtrim(r, 'Xx')) = 15 OR (length(r) = 18 AND length(rtrim(r, 'Xx')) >= 17 AND
  substr('10X98765432', list_sum(list_transform(range(1, 18), lambda i: TRY_CAST(substr(rtrim(r, 'Xx'), i, 1) AS INT) *
  [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2][i]))::INT % 11 + 1, 1) = upper(substr(r, 18, 1)))))"""
EMAIL = r"len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?:[^A-Za-z0-9_.-]|$)'))"
SECRECY = (
    r"len(regexp_extract_all(text, '(?m)(?:(?:文件)?密级|保密级别)\s*[:：]\s*(?:绝密|机密|秘密)"
    r"|^\s*[【\[]?(?:绝密|机密|秘密)[】\]]?\s*[★☆]\s*(?:\d+年)?\s*$"
    r"|^\s*(?:内部机密|仅限内部使用|仅限内部传阅|禁止外传|严禁外传)\s*$'))"
)
SALARY = (
    "len(regexp_extract_all(text, '(?:" + rp.SALARY_TERMS + ")"
    r"[^\n。；;]{0,20}(?:\d[\d,.]*\s*(?:元|万元|人民币|(?i:RMB)|￥|¥))'))"
)
CONTRACT = (
    "len(regexp_extract_all(text, '(?:" + rp.CONTRACT_TERMS + ")"
    r"\s*(?:为|是|[:：=])\s*(?:人民币\s*)?(?:(?i:RMB)\s*)?[￥¥]?\s*"
    r"(?:\d[\d,.]*\s*(?:万元|元)|[￥¥]\s*\d[\d,.]*)'))"
)
RISKS = ("phone", "id", "card", "email", "secrecy", "salary", "contract")

# Card numbers: digit runs with single separators, placed in the text, then the
# 18 characters on both sides and the Luhn sum.
CARDS = r"""
card_docs AS (
  SELECT doc_id, text, regexp_extract_all(text, '[0-9](?:[ -]?[0-9])*[ -]?') AS runs,
    regexp_split_to_array(text, '[0-9](?:[ -]?[0-9])*[ -]?') AS pieces
  FROM corpus WHERE regexp_matches(text, '银行卡|银行账号|银行账户|卡号|账户号码|收款账号')
),
card_runs AS (
  SELECT doc_id, text, runs[i] AS run,
    regexp_replace(runs[i], '[^0-9]', '', 'g') AS d,
    1 + length(array_to_string(runs[1:i - 1], '')) + length(array_to_string(pieces[1:i], '')) AS pos
  FROM (SELECT *, unnest(range(1, len(runs) + 1)) AS i FROM card_docs)
),
cards AS (
  SELECT doc_id, count(*) AS card FROM card_runs
  WHERE length(d) BETWEEN 16 AND 19 AND replace(d, d[1], '') <> ''
    AND (regexp_matches(substr(text, greatest(1, pos - 18), least(18, pos - 1)), '银行卡|银行账号|银行账户|卡号|账户号码|收款账号')
      OR regexp_matches(substr(text, pos + length(run), 18), '银行卡|银行账号|银行账户|卡号|账户号码|收款账号'))
    AND list_sum(list_transform(range(1, length(d) + 1), lambda i:
      CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(d), i, 1) AS INT)
           ELSE CAST(substr(reverse(d), i, 1) AS INT) * 2 - CASE WHEN CAST(substr(reverse(d), i, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
  GROUP BY doc_id
)"""

MEASURED = f"""
measured AS (
  SELECT c.*, coalesce(k.card, 0) AS card, {PHONE} AS phone, {ID} AS id, {EMAIL} AS email,
    {SECRECY} AS secrecy, {SALARY} AS salary, {CONTRACT} AS contract,
    {content_length('c.text')} AS content_length, {garbled('c.text')} AS garbled,
    {text_fp('c.text')} AS text_fp,
    CASE WHEN size_bytes > 0 THEN sha256(content) END AS binary_fp
  FROM corpus c LEFT JOIN cards k USING (doc_id)
)"""

_WORDS = rp.VERSION_WORDS
_OPEN = r"[\s_\-（(\[]*"
VERSION = (
    "(?:" + rf"{_OPEN}(?:{_WORDS})\s*\d*"
    + rf"|{_OPEN}v(?:er(?:sion)?)?\.?\s*\d+(?:\.\d+)*"
    + rf"|{_OPEN}(?:19|20)\d{{2}}(?:[-_.年]\d{{1,2}})?(?:[-_.月]\d{{1,2}})?日?版?"
    + rf"|{_OPEN}第?\d+(?:\.\d+)*版)[\s_\-）)\]]*"
)

LABELS = dict(zip(RISKS, rp.RISK_ORDER))
RISK_TEXT = "concat_ws('；', " + ", ".join(
    f"CASE WHEN {r} > 0 THEN '{LABELS[r]}（' || {r} || '处）' END" for r in RISKS
) + ")"
RISK_TOTAL = "(" + " + ".join(RISKS) + ")"
HIGH = "(" + " OR ".join(f"{r} > 0" for r in ("id", "card", "secrecy", "salary", "contract")) + ")"
FOLDERS = "string_split(relative_path, '/')[1:-2]"
SUFFIX = r"lower(regexp_extract(file_name, '^.+(\.[^.]+)$', 1))"
STEM = r"substr(file_name, 1, length(file_name) - length(regexp_extract(file_name, '^.+(\.[^.]+)$', 1)))"
AS_OF = f"TIMESTAMP '{fixtures.AS_OF}'"


def display_type(ext: str) -> str:
    types = {**rp.SUPPORTED, **rp.LEGACY, **rp.OTHER_BUSINESS}
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in types.items())
    return f"CASE {ext} WHEN '' THEN '无扩展名文件' {cases} ELSE '其他' END"


def category(ext: str) -> str:
    return (
        f"CASE WHEN {ext} IN ('.docx', '.pdf', '.xlsx', '.pptx', '.txt', '.md') THEN '首批支持文档' "
        f"WHEN {ext} IN ('.doc', '.xls', '.ppt') THEN '待转换文档' "
        f"WHEN {ext} IN ('.csv', '.rtf', '.odt', '.ods', '.odp') THEN '其他业务文件' ELSE '其他文件' END"
    )


def scan_note(ext: str) -> str:
    return (
        f"CASE {category(ext)} WHEN '首批支持文档' THEN '' WHEN '待转换文档' THEN '建议转换为常用格式' "
        f"WHEN '其他业务文件' THEN '第一版暂不读取正文' ELSE CASE WHEN {ext} = '' THEN '需要人工确认文件类型' "
        f"ELSE '第一版仅盘点，不读取正文' END END"
    )


NAMED = rf"""
named AS (
  SELECT *, {SUFFIX} AS suffix, {STEM} AS stem, lower({STEM}) AS fstem,
    {FOLDERS} AS folders,
    CASE WHEN extension IN ('.doc', '.xls', '.ppt') THEN '需特殊处理'
         WHEN extension IN ('.docx', '.pdf', '.xlsx', '.pptx', '.txt', '.md') THEN '可直接解析'
         ELSE '暂无法解析' END AS parse_status,
    CASE WHEN extension IN ('.doc', '.xls', '.ppt') THEN {q(rp.ISSUE_LEGACY)}
         WHEN extension IN ('.docx', '.pdf', '.xlsx', '.pptx', '.txt', '.md') THEN ''
         ELSE {q(rp.ISSUE_UNSUPPORTED)} END AS parse_issue,
    lower(relative_path) AS path_key, lower(file_name) AS name_key,
    lower(array_to_string({FOLDERS}, '/')) AS parent_key,
    regexp_replace(regexp_replace(lower({STEM}), {q(VERSION)}, '', 'g'), '[^㐀-鿿A-Za-z0-9]+', '', 'g') AS version_key,
    regexp_matches(lower({STEM}), {q(VERSION)}) AS version_marker,
    regexp_matches(lower({STEM}), '副本|复件|备份|copy|旧版|历史版|废弃') AS copy_named,
    greatest(0.0, floor(epoch({AS_OF} - modified_at) / 86400) / 365.25) AS age,
    regexp_full_match(trim({STEM}), '(?i)(新建(文档|文件|文件夹)?|未命名|副本|复件)(\s*\(\d+\)|\s*\d+)?|\d{{1,4}}|(最终|最新版|新版本|final)(版)?\s*\d*')
      OR len(list_filter({FOLDERS}, lambda f: lower(trim(f)) IN ({', '.join(q(b) for b in rp.BAD_FOLDERS)}))) > 0
      OR root_name IN ({', '.join(q(b) for b in rp.BAD_FOLDERS)}) AS bad_name,
    regexp_matches({STEM}, '附件|模[板版]') AS attachment
  FROM measured
)"""

# rule -> (condition, issue, advice, status rank, priority rank); first match per rule.
RULES = {
    "rule_unreadable": [
        ("parse_status = '暂无法解析'", "parse_issue", "请转换为工具支持的常用文档格式", 2, 3),
        ("parse_status = '需特殊处理' AND regexp_matches(parse_issue, '损坏|加密|无法访问')", "parse_issue", "请按问题说明处理后重新体检", 2, 3),
        ("parse_status = '需特殊处理'", "parse_issue", "请按问题说明处理后重新体检", 1, 2),
    ],
    "rule_length": [
        ("parse_status = '可直接解析' AND content_length = 0", "'没有读取到有效内容'", "请确认文件是否为空，或重新提供包含正文的版本", 2, 3),
        ("parse_status = '可直接解析' AND content_length < 50", "'有效内容过少'", "请确认内容是否完整、是否需要保留", 1, 2),
        ("parse_status = '可直接解析' AND content_length < 200 AND suffix <> '.xlsx'", "'内容较短'", "建议人工确认内容是否完整", 1, 1),
    ],
    "rule_garbled": [
        ("garbled >= 0.3", "'内容主要是乱码'", "建议重新导出或转换文件格式", 2, 3),
        ("garbled >= 0.1", "'部分文字可能是乱码'", "建议检查正文并重新导出文件", 1, 2),
    ],
    "rule_age": [
        ("age >= 5", "'超过5年未更新'", "请确认资料目前是否仍然有效", 1, 1),
        ("age >= 3", "'超过3年未更新'", "建议确认资料目前是否仍在使用", 1, 1),
    ],
    "rule_name": [
        ("bad_name", "'文件名称或归档位置不清楚'", "建议改成能够说明内容和版本的名称", 1, 1),
    ],
    "rule_attachment": [
        ("attachment", "'附件/模板资料，建议单独管理'", "建议集中放到附件/模板下载区，并在相关知识说明中补充下载地址或获取路径；不建议把附件正文作为主要检索内容", 0, 2),
    ],
    "rule_sensitive": [
        (HIGH, "'可能包含敏感信息'", "请确认资料的使用对象和访问范围", 1, 2),
        (f"{RISK_TOTAL} > 0", "'包含联系方式，建议确认展示范围'", "如属于公开业务联系方式可直接保留，否则建议脱敏或限制展示", 0, 1),
    ],
    "rule_duplicate": [
        ("is_primary", q(rp.ISSUE_DUPLICATE_KEEP), rp.ADVICE_DUPLICATE_KEEP, 1, 2),
        ("NOT is_primary", q(rp.ISSUE_DUPLICATE_DROP), rp.ADVICE_DUPLICATE_DROP, 2, 2),
    ],
    "rule_version": [
        ("version_group IS NOT NULL", q(rp.ISSUE_VERSION), rp.ADVICE_VERSION, 1, 2),
    ],
}


def rule_sql(name: str, source: str, seq: int = 0) -> str:
    branches = RULES[name]
    when = " ".join(f"WHEN {c} THEN {i}" for i, (c, *_) in enumerate(branches))

    def pick(values) -> str:
        return "CASE b " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"

    return (
        f"SELECT doc_id, {seq} AS seq, {pick([b[1] for b in branches])} AS issue, "
        f"{pick([q(b[2]) for b in branches])} AS advice, {pick([b[3] for b in branches])} AS status_rank, "
        f"{pick([b[4] for b in branches])} AS priority_rank "
        f"FROM (SELECT *, CASE {when} END AS b FROM {source}) WHERE b IS NOT NULL"
    )


SIGNATURES = """
signatures AS (
  SELECT doc_id, 'b' || binary_fp AS signature FROM named WHERE size_bytes > 0
  UNION ALL
  SELECT doc_id, 't' || text_fp FROM named WHERE text_fp <> '' AND content_length >= 20
),
shared AS (
  SELECT signature, count(*) AS n, min(doc_id) AS rep FROM signatures GROUP BY signature HAVING count(*) > 1
),
linked AS (SELECT s.doc_id, s.signature FROM signatures s JOIN shared USING (signature)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM linked
  UNION
  SELECT r.doc_id, b.doc_id FROM reach r JOIN linked a ON a.doc_id = r.other JOIN linked b ON a.signature = b.signature
),
members AS (SELECT doc_id, min(other) AS component FROM reach GROUP BY doc_id)"""

ELECTION = """
ranked_members AS (
  SELECT component, doc_id, path_key, name_key,
    row_number() OVER (PARTITION BY component ORDER BY (parse_status = '可直接解析') DESC, copy_named ASC,
      modified_at DESC, content_length DESC, path_key DESC, doc_id ASC) AS merit,
    row_number() OVER (PARTITION BY component ORDER BY path_key, name_key, doc_id) AS place
  FROM members JOIN named USING (doc_id)
),
primaries AS (
  SELECT component, count(*) AS n, max(CASE WHEN merit = 1 THEN doc_id END) AS primary_id,
    max(CASE WHEN place = 1 THEN path_key END) AS p, max(CASE WHEN place = 1 THEN name_key END) AS f,
    max(CASE WHEN place = 1 THEN doc_id END) AS first_id
  FROM ranked_members GROUP BY component
),
duplicate_marks AS (
  SELECT m.doc_id, '重复组' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS duplicate_group,
    m.doc_id = primary_id AS is_primary
  FROM members m JOIN (SELECT *, row_number() OVER (ORDER BY p, f, first_id) AS k FROM primaries) USING (component)
)"""

FAMILIES = """
families AS (
  SELECT parent_key, version_key, count(*) AS n FROM named
  WHERE length(version_key) >= 3
  GROUP BY parent_key, version_key
  HAVING count(*) > 1 AND bool_or(version_marker) AND count(DISTINCT name_key) > 1
    AND (count(DISTINCT nullif(text_fp, '')) > 1 OR count(nullif(text_fp, '')) = 0)
),
family_rows AS (
  SELECT doc_id, parent_key, version_key,
    row_number() OVER (PARTITION BY parent_key, version_key ORDER BY path_key, name_key, doc_id) AS place, path_key, name_key
  FROM named JOIN families USING (parent_key, version_key)
),
version_marks AS (
  SELECT r.doc_id, '版本组' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS version_group
  FROM family_rows r JOIN (
    SELECT parent_key, version_key, row_number() OVER (ORDER BY path_key, name_key, doc_id) AS k
    FROM family_rows WHERE place = 1) USING (parent_key, version_key)
)"""

ORDERED_RULES = (
    "rule_unreadable", "rule_length", "rule_garbled", "rule_age", "rule_name", "rule_attachment", "rule_sensitive",
)
BASE_FINDINGS = "base_findings AS (" + " UNION ALL ".join(
    rule_sql(r, "named", i) for i, r in enumerate(ORDERED_RULES)
) + ")"
MARKED = """
marked AS (
  SELECT n.*, d.duplicate_group, d.is_primary, v.version_group
  FROM named n LEFT JOIN duplicate_marks d USING (doc_id) LEFT JOIN version_marks v USING (doc_id)
)"""
FINDINGS = "findings AS (SELECT * FROM base_findings UNION ALL " + " UNION ALL ".join(
    [rule_sql("rule_duplicate", "(SELECT * FROM marked WHERE duplicate_group IS NOT NULL)", 10), rule_sql("rule_version", "marked", 11)]
) + ")"
JUDGED = f"""
judged AS (
  SELECT doc_id, string_agg(issue, '；' ORDER BY seq) AS issues, string_agg(advice, '；' ORDER BY seq) AS recommendation,
    max(status_rank) AS s, max(priority_rank) AS p
  FROM findings GROUP BY doc_id
),
verdicts AS (
  SELECT m.doc_id, file_name, relative_path, {category('m.suffix')} AS category, {display_type('m.suffix')} AS display_type,
    extension, size_bytes, modified_at, '已盘点' AS scan_status, {scan_note('m.suffix')} AS scan_note, parse_status,
    content_length, 0 AS document_scale, '' AS scale_unit, parse_issue,
    CASE coalesce(j.s, 0) WHEN 0 THEN '可直接使用' WHEN 1 THEN '整理后使用' ELSE '暂不能使用' END AS use_status,
    coalesce(issues, '') AS issues,
    CASE coalesce(j.p, 0) WHEN 0 THEN '' WHEN 1 THEN '后续优化' WHEN 2 THEN '建议处理' ELSE '优先处理' END AS priority,
    coalesce(recommendation, '') AS recommendation, coalesce(duplicate_group, '') AS duplicate_group,
    coalesce(version_group, '') AS version_group, {RISK_TEXT} AS sensitive_risks, {RISK_TOTAL} AS sensitive_risk_count,
    path_key, name_key
  FROM marked m LEFT JOIN judged j USING (doc_id)
)"""

# --- topics ---------------------------------------------------------------------


def _hits(col: str, keywords) -> str:
    terms = []
    for k in keywords:
        low = k.lower()
        if re.fullmatch("[a-z0-9]+", low):
            terms.append(f"regexp_matches({col}, '(^|[^a-z0-9]){low}([^a-z0-9]|$)')::INT")
        else:
            terms.append(f"contains({col}, {q(low)})::INT")
    return "(" + " + ".join(terms) + ")"


GENERIC = ", ".join(q(g) for g in rp.GENERIC_FOLDERS)
ANCHOR = f"CASE WHEN root_name IN ({GENERIC}) THEN CASE WHEN len(folders) > 0 THEN folders[1] ELSE '' END ELSE root_name END"
FOLDER_TEXT = f"array_to_string(list_filter(folders, lambda f: f NOT IN ({GENERIC})), ' ')"
SCORES = (
    f"topic_src AS (SELECT doc_id, lower({ANCHOR}) AS anchor, lower({FOLDER_TEXT}) AS folder, fstem, "
    f"translate(lower(text), '{FULL}', '{HALF}') AS body FROM named),\n"
    "scores AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, anchor, {q(t.name)} AS topic, 20 * {_hits('anchor', t.keywords)} + 8 * {_hits('folder', t.keywords)} "
        f"+ 5 * {_hits('fstem', t.keywords)} + least({_hits('body', t.keywords)}, 5) AS score FROM topic_src"
        for t in rp.TOPICS
    )
    + ")"
)
CHOSEN = f"""
ranked_scores AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic) AS rn,
    lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, topic) AS second FROM scores
),
chosen AS (
  SELECT doc_id, anchor, CASE WHEN score < 3 OR (score = second AND score < 8) THEN '待确认资料' ELSE topic END AS topic
  FROM ranked_scores WHERE rn = 1
),
special AS (
  SELECT doc_id, CASE WHEN topic = '销售与客户服务知识库' AND contains(anchor, '经销商') THEN '经销商与客户服务知识库'
    WHEN topic = '销售与客户服务知识库' AND contains(anchor, '销售助手') THEN '门店销售助手知识库' ELSE topic END AS topic
  FROM chosen
)"""
TOPIC_COUNTS = """
topic_docs AS (SELECT s.doc_id, s.topic, row_number() OVER (ORDER BY path_key, name_key, doc_id) AS pos FROM special s JOIN named USING (doc_id)),
topic_n AS (SELECT topic, count(*) AS n, min(pos) AS first FROM topic_docs GROUP BY topic),
official AS (SELECT sum(n) AS total, max(n) AS lead_n, arg_max(topic, n) AS lead FROM topic_n WHERE topic <> '待确认资料'),
absorbed AS (
  SELECT t.topic, t.n, t.first,
    CASE WHEN o.total >= 10 AND o.lead_n / o.total >= 0.8 AND t.topic <> '待确认资料' AND t.n <= greatest(1, floor(o.total * 0.03))
      THEN o.lead ELSE t.topic END AS absorbed
  FROM topic_n t, official o
),
capped AS (
  SELECT absorbed, CAST(sum(n) AS BIGINT) AS n, min(first) AS first FROM absorbed WHERE absorbed <> '待确认资料'
  GROUP BY absorbed ORDER BY n DESC, first LIMIT 6
),
final_topics AS (
  SELECT topic, CASE WHEN absorbed IN (SELECT absorbed FROM capped) THEN absorbed ELSE '待确认资料' END AS final_topic FROM absorbed
)"""
RECORDS = """
records AS (
  SELECT v.*, f.final_topic AS suggested_knowledge_base, t.pos
  FROM verdicts v JOIN topic_docs t USING (doc_id) JOIN final_topics f ON t.topic = f.topic
)"""


def marker(col: str, markers) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(m)})" for m in markers) + ")"


MAIN_ISSUE = (
    "labels AS ("
    + " UNION ALL ".join(
        f"SELECT suggested_knowledge_base AS topic, pos, {i} AS ord, {q(x.friendly)} AS friendly FROM records WHERE {marker('issues', x.markers)}"
        for i, x in enumerate(rp.MAIN_ISSUES)
    )
    + """),
label_n AS (SELECT topic, ord, friendly, count(*) AS n, min(pos) AS first FROM labels GROUP BY ALL),
main_issues AS (
  SELECT topic, friendly || '（' || n || '份）' AS main_issue FROM (
    SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, first, ord) AS rn FROM label_n) WHERE rn = 1
),
plan AS (
  SELECT r.suggested_knowledge_base AS topic, count(*) AS document_count, min(pos) AS first,
    count(*) FILTER (use_status = '可直接使用') AS ready, count(*) FILTER (use_status = '暂不能使用') AS blocked
  FROM records r GROUP BY 1
)"""
)
DESCRIPTIONS = "(VALUES " + ", ".join(
    f"({q(n)}, {q(d)})" for n, d in {**PACK.descriptions, rp.PENDING: rp.PENDING_DESCRIPTION}.items()
) + ") AS x(topic, description)"
SITUATION = (
    "CASE WHEN ready / document_count >= 0.7 THEN '大部分可以使用' "
    "WHEN blocked / document_count >= 0.3 THEN '需要优先整理' ELSE '部分资料需要整理' END"
)

PROBLEMS = "problem_rows AS (" + " UNION ALL ".join(
    f"SELECT {q(p.label)} AS label, {q(p.advice)} AS advice, records.*, "
    f"array_to_string(list_filter(string_split(issues, '；'), lambda x: {marker('x', p.markers)}), '；') AS matching "
    f"FROM records WHERE {marker('issues', p.markers)}"
    for p in rp.PROBLEMS
) + """),
problem_n AS (SELECT label, advice, count(*) AS n FROM problem_rows GROUP BY ALL),
problem_rank AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS rn FROM problem_n),
top_problems AS (
  SELECT row_number() OVER (ORDER BY rn) AS ord, label, n, advice FROM problem_rank
  WHERE label = '可能包含敏感信息' OR rn <= CASE WHEN (SELECT rn FROM problem_rank WHERE label = '可能包含敏感信息') > 5 THEN 4 ELSE 5 END
)"""
GROUP_TEXT = "coalesce(nullif(duplicate_group, ''), version_group)"
DETAIL = f"""CASE WHEN label = '可能包含敏感信息' THEN coalesce(nullif(sensitive_risks, ''), '检测到敏感信息特征')
  WHEN label = '重复或多个版本' THEN issues || CASE WHEN {GROUP_TEXT} <> '' THEN '；所属' || {GROUP_TEXT} ELSE '' END
  WHEN label IN ('扫描文件', '无法正常读取') AND parse_issue <> '' THEN parse_issue
  ELSE coalesce(nullif(matching, ''), issues) END"""
STATUS_DETAIL = """(SELECT CASE WHEN sensitive_risks <> '' AND contains(d, '敏感信息') THEN d || '（' || sensitive_risks || '）' ELSE d END
  FROM (SELECT coalesce(nullif(issues, ''), nullif(parse_issue, ''), nullif(scan_note, ''), '需要人工确认') AS d))"""


def percent(n: str, total: str) -> str:
    return f"CAST(CASE WHEN {total} = 0 THEN 0 ELSE round_even({n} * 100 / {total}, 0) END AS INT) || '%'"


def commas(n: str) -> str:
    return f"format('{{:,}}', CAST({n} AS BIGINT))"


def size_text(b: str) -> str:
    out = f"CASE WHEN {b} < 1024 THEN {commas(b)} || ' B'"
    for i, unit in enumerate(("KB", "MB", "GB"), start=1):
        out += f" WHEN {b} < {1024 ** (i + 1)} THEN printf('%.1f', round_even({b} / {1024 ** i}, 1)) || ' {unit}'"
    return out + f" ELSE printf('%.1f', round_even({b} / {1024 ** 4}, 1)) || ' TB' END"


def kind(t: str) -> str:
    base = f"string_split({t}, '（')[1]"
    return f"CASE WHEN {base} IN ('Word', 'PDF', 'Excel', 'PPT', '文本') THEN {base} ELSE '其他' END"


FACTS = """
facts AS (
  SELECT count(*) AS total, CAST(sum(size_bytes) AS BIGINT) AS bytes,
    count(*) FILTER (parse_status = '可直接解析') AS direct, count(*) FILTER (parse_status = '需特殊处理') AS special,
    count(*) FILTER (parse_status = '暂无法解析') AS unavailable, count(*) FILTER (use_status = '可直接使用') AS ready,
    count(*) FILTER (use_status = '整理后使用') AS work, count(*) FILTER (use_status = '暂不能使用') AS blocked,
    count(*) FILTER (duplicate_group <> '' OR version_group <> '') AS duplicates,
    count(DISTINCT nullif(duplicate_group, '')) + count(DISTINCT nullif(version_group, '')) AS groups
  FROM records
)"""


def values(rows, names: str) -> str:
    body = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else q(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS x({names})"


_LENGTH_BIN = (
    "CASE WHEN parse_status <> '可直接解析' THEN '暂无法统计' WHEN content_length < 500 THEN '500字以内' "
    "WHEN content_length < 2000 THEN '500～2,000字' WHEN content_length < 5000 THEN '2,000～5,000字' "
    "WHEN content_length < 10000 THEN '5,000～10,000字' ELSE '10,000字以上' END"
)
_BINS = [(i, b) for i, b in enumerate([x[0] for x in rp.LENGTH_BINS] + [rp.UNCOUNTED_BIN], start=1)]
DISTRIBUTIONS = f"""
format_n AS (
  SELECT x.ord, x.label, count(*) AS n FROM records JOIN {values(list(enumerate(rp.DOCUMENT_KINDS, 1)), 'ord, label')}
    ON x.label = {kind('display_type')} GROUP BY ALL
),
length_n AS (
  SELECT x.ord, x.label, count(doc_id) AS n FROM {values(_BINS, 'ord, label')}
    LEFT JOIN records ON x.label = {_LENGTH_BIN} GROUP BY ALL HAVING x.label <> '暂无法统计' OR count(doc_id) > 0
),
status_n AS (
  SELECT x.ord, x.label, count(doc_id) AS n FROM {values(list(enumerate(rp.USE_STATUSES, 1)), 'ord, label')}
    LEFT JOIN records ON x.label = use_status GROUP BY ALL
)"""

_STAGES = {
    "corpus": [],
    "measured": [CARDS, MEASURED],
    "named": [NAMED],
    "dups": [SIGNATURES, ELECTION],
    "versions": [FAMILIES],
    "verdicts": [BASE_FINDINGS, MARKED, FINDINGS, JUDGED],
    "topics": [SCORES, CHOSEN, TOPIC_COUNTS],
    "records": [RECORDS],
    "plan": [MAIN_ISSUE],
    "problems": [PROBLEMS],
    "facts": [FACTS],
    "distributions": [DISTRIBUTIONS],
}
_CHAIN = {
    "corpus": [],
    "measured": ["measured"],
    "named": ["measured", "named"],
    "dups": ["measured", "named", "dups"],
    "versions": ["measured", "named", "versions"],
    "verdicts": ["measured", "named", "dups", "versions", "verdicts"],
    "topics": ["measured", "named", "topics"],
    "records": ["measured", "named", "dups", "versions", "verdicts", "topics", "records"],
}


def sql(upto: str, select: str, *extra: str) -> str:
    """The stages up to ``upto``, further stages by name, then the query."""
    parts = [f"corpus AS ({fixtures.duck_sql('corpus')})"]
    for stage in (*_CHAIN[upto], *extra):
        parts += _STAGES[stage]
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts) + "\n" + select


def table_sql(name: str, select: str, ctes: str = "") -> str:
    return f"WITH {name} AS ({fixtures.duck_sql(name)}){ctes}\n{select}"
