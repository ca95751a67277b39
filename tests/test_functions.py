"""Column functions against plain Python on literal and random text."""

import hashlib
import random
import re
import unicodedata
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from corpuscope.functions import display, normalize, paths, risks, text
from corpuscope.operators import topics
from corpuscope.rulepack import DEFAULT_PACK as PACK

PIECES = (
    list("abcXYZ 0159\n\t,.;:()-_@+%") + list("合同密级机密秘绝：；。，（）【】★☆ 员工系统１２ＡＢ") + [" ", "\x0b", "\x1c", "\x85", "　", "ß", "é", "ﬁ", "①", "…", "😀", "�", "\x01", "", "İ", "Σ", "ς"]
    + ["13800138000", "19912345678", "11010519491231002X", "110105194912310", "4111111111111111", "4111 1111 1111 1111", "6222-0200-0000-0000"]
    + ["银行卡号", "卡号", "收款账号", "密级：机密", "禁止外传", "机密★\n", "月薪8,000元", "年薪", "本合同总金额为", "￥100", "RMB 5万元", "a.b@example.com", "x@y.cn", "１３８"]
)


def random_texts(count: int, seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(count)]


def column(spark, values, expression):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, t string")
    return [r[1] for r in sorted(df.select("i", expression(F.col("t"))).collect())]


def python_digest(value):
    packed = "".join(c for c in unicodedata.normalize("NFKC", value).casefold() if not c.isspace())
    return hashlib.sha256(packed.encode()).hexdigest() if packed else ""


#: Texts and what each counter finds in them.
COUNTED = {
    risks.phone_count: {
        "": 0,
        "13800138000": 1,
        "138001380001": 0,
        "12800138000": 0,
        "a13800138000b19912345678": 2,
        "１３８００１３８０００": 0,
        "13８00138000": 1,
    },
    risks.email_count: {
        "a.b@example.com": 1,
        "A.B+c%d@EXAMPLE.CO": 1,
        "a@b": 0,
        "a@b.c": 0,
        "x@y.cn z@w.org": 2,
        "写信到 a.b@example.com.": 0,
        "写信到 a.b@example.com": 1,
        "a@b.com+c@d.com": 2,
        "a@b@c.com": 1,
    },
    risks.secrecy_count: {
        "密级：机密": 1,
        "文件密级:绝密": 1,
        "保密级别 ： 秘密": 1,
        "★机密": 0,
        "机密★": 1,
        "机密": 0,
        "【绝密】☆10年": 1,
        "内部机密": 1,
        "内部机密。": 0,
        "禁止外传 后文": 0,
        "秘密★\n禁止外传\n严禁外传 x": 2,
        "第一行\n 禁止外传 \n\n机密\n★": 2,
        "密级 : 秘密": 1,
    },
    risks.salary_count: {
        "月薪8,000元": 1,
        "年薪：人民币20万元": 1,
        "月薪。8000元": 0,
        "基本工资 RMB 5000": 0,
        "岗位工资 5000 RMB": 1,
        "月薪8000元；年薪10万元": 2,
        "月薪8000元，年薪10万元": 1,
        "工资 100元": 0,
        "月薪" + "字" * 20 + "1元": 1,
        "月薪" + "字" * 21 + "1元": 0,
    },
    risks.contract_count: {
        "本合同总金额为￥100": 1,
        "本合同金额：人民币 5万元": 1,
        "本协议总金额=RMB 3,000.50元": 1,
        "本合同总价是100": 0,
        "合同金额为100元": 0,
        "双方约定的合同金额 : ¥ 20": 1,
    },
    risks.id_count: {
        "110105194912310": 1,
        "11010519491231002X": 1,
        "11010519491231002x": 1,
        "110105194912310021": 0,
        "110105194912310038": 1,
        "1101051949123100211": 0,
        "440308199901010012,310101198506151238": 2,
        "440308199901010013": 0,
        "510102197002284562x": 1,
    },
    risks.card_count: {
        "卡号4111111111111111": 1,
        "4111111111111111": 0,
        "卡号1111111111111111": 0,
        "卡号：" + "字" * 17 + "4111111111111111": 0,
        "4111 1111 1111 1111是我的卡号": 1,
        "卡号6222020000000007": 1,
        "卡号6222020000000008": 0,
        "银行卡 6217001234567890122": 1,
        "收款账号：622848000000000015": 1,
        "卡号 411111111111111": 0,
        "卡号4111111111111111 卡号6222-0200-0000-0007": 2,
    },
    text.garbled_ratio: {
        "": 0.0,
        " \n": 0.0,
        "\x1c\x1d": 0.0,
        "abcd": 0.0,
        "中文字符": 0.0,
        "a\u200b": 0.0,
        "\x85x": 0.0,
        "ab�d": 0.25,
        "a\x01": 0.5,
        "a\x7f": 0.5,
        "a\ue000": 0.5,
        "a\U000f0000": 0.5,
        "a\u0378": 0.5,
        "\x01 \x01": 1.0,
        "�� ab\u3000c": 0.4,
    },
}


def test_fold_matches_python_on_every_jvm_character(spark):
    chars = [chr(c) for lo, hi in normalize.JVM_RANGES for c in range(lo, hi + 1)]
    assert column(spark, chars, normalize.fold_jvm) == [normalize.python_fold(c) for c in chars]
    assert not any(column(spark, chars, normalize.is_odd))
    lower = column(spark, chars, lambda t: F.length(F.lower(t)))
    assert set(lower) == {1}
    spaces = column(spark, chars, lambda t: F.length(normalize.drop_jvm_spaces(t)))
    assert [c for c, n in zip(chars, spaces) if n == 0] == [c for c in chars if c.isspace()]
    garbled = column(spark, chars, text.garbled_ratio)
    assert [c for c, g in zip(chars, garbled) if g] == ["�"]


def test_jvm_characters_never_compose(spark):
    chars = [chr(c) for lo, hi in normalize.JVM_RANGES for c in range(lo, hi + 1)]
    assert all(unicodedata.combining(c) == 0 for c in chars)
    rng = random.Random(3)
    joined = ["".join(rng.choices(chars, k=60)) for _ in range(500)]
    assert column(spark, joined, normalize.fold_jvm) == [normalize.python_fold(t) for t in joined]


@pytest.mark.parametrize(
    "expression, expected",
    [
        (normalize.fold, normalize.python_fold),
        (text.content_length, lambda t: len(re.findall("[㐀-鿿A-Za-z0-9]", t))),
        (text.text_fingerprint, python_digest),
        (normalize.strip, str.strip),
    ],
    ids=["fold", "content_length", "fingerprint", "strip"],
)
def test_text_functions_match_python(spark, expression, expected):
    texts = random_texts(3000)
    assert column(spark, texts, expression) == [expected(t) for t in texts]


@pytest.mark.parametrize("counter", COUNTED, ids=lambda c: c.__name__)
def test_counts(spark, counter):
    cases = COUNTED[counter]
    got = dict(zip(cases, column(spark, list(cases), counter)))
    assert {k: v if isinstance(v, int) else round(v, 9) for k, v in got.items()} == cases


def test_risk_text_order_and_map(spark):
    both = "a@b.com 13800138000 13900139000"
    assert column(spark, [both, ""], lambda t: risks.risk_text(risks.risk_counts(t))) == [
        "手机号码（2处）；电子邮箱（1处）",
        "",
    ]
    assert column(spark, [both], lambda t: risks.risk_map(risks.risk_counts(t))) == [{"手机号码": 2, "电子邮箱": 1}]


def test_version_keys(spark):
    stems = {
        "员工手册v2.0（最终版）": ("员工手册版", True),
        "报告_2024-05-01版": ("报告", True),
        "cctv5": ("cct", True),
        "doc_120199": ("doc19", True),
        "方案第3版": ("方案", True),
        "手册(1)": ("手册1", False),
        "员工手册v2（最终版）": ("员工手册版", True),
        "ＦＩＮＡＬ报告": ("报告", True),
    }
    keys = column(spark, list(stems), lambda t: paths.version_key(normalize.fold(t)))
    marks = column(spark, list(stems), lambda t: paths.has_version_marker(normalize.fold(t)))
    assert list(zip(keys, marks)) == list(stems.values())


def test_names(spark):
    names = {
        "a.TXT": (".txt", "a"),
        ".bashrc": ("无扩展名", ".bashrc"),
        "a.": ("无扩展名", "a."),
        "x.tar.gz": (".gz", "x.tar"),
        "..x": (".x", "."),
        "无后缀": ("无扩展名", "无后缀"),
    }
    assert column(spark, list(names), paths.extension) == [v[0] for v in names.values()]
    assert column(spark, list(names), paths.stem) == [v[1] for v in names.values()]
    bad = {"新建文档 (3).txt": True, "新建文档.txt": True, "1234.md": True, "12345.md": False, "Final版 2.doc": True, "最终方案.doc": False}
    got = column(spark, list(bad), lambda t: paths.bad_name(t, F.array().cast("array<string>"), PACK.bad_folders))
    assert got == list(bad.values())
    assert column(spark, ["a.txt"], lambda t: paths.bad_name(t, F.array(F.lit(" 临时 ")), PACK.bad_folders)) == [True]


def test_age_is_whole_days(spark):
    times = ["2020-01-01 12:00:00", "2020-01-02 11:59:59", "2030-01-01 00:00:00"]
    as_of = F.lit("2020-01-03 12:00:00").cast("timestamp")
    years = column(spark, times, lambda t: text.age_years(t.cast("timestamp"), as_of))
    assert years == [2 / 365.25, 1 / 365.25, 0.0]


def test_keyword_hits(spark):
    """Distinct keywords found, by topic; words of letters and digits stand alone."""
    cases = {
        "": [0, 0, 0, 0, 0, 0, 0, 0, 0],
        "IT部门 it-team": [1, 0, 0, 0, 0, 0, 0, 0, 0],
        "kit its it1": [0, 0, 0, 0, 0, 0, 0, 0, 0],
        "it_": [1, 0, 0, 0, 0, 0, 0, 0, 0],
        "ＩＴ系统": [2, 0, 0, 0, 0, 0, 0, 0, 0],
        "hr_ vpn API": [2, 1, 0, 0, 0, 0, 0, 0, 0],
        "信息系统": [2, 0, 0, 0, 0, 0, 0, 0, 0],
        "财经共享": [0, 0, 0, 0, 0, 0, 1, 2, 0],
        "报销报销 差旅": [0, 2, 0, 0, 0, 0, 0, 1, 0],
        "产品手册 用户手册": [0, 0, 0, 3, 0, 0, 0, 0, 0],
        "保密协议": [0, 0, 0, 0, 0, 0, 0, 0, 2],
        "销。售 销 售": [0, 0, 0, 0, 0, 0, 0, 0, 0],
        "银行账号": [1, 0, 0, 0, 0, 0, 1, 0, 0],
        "备份与恢复、监控工单": [4, 0, 0, 0, 0, 0, 0, 0, 0],
        "安全生产 设备检验": [0, 0, 0, 0, 4, 0, 0, 0, 0],
    }
    got = column(spark, list(cases), lambda t: topics.keyword_hits(normalize.fold(t), PACK))
    assert dict(zip(cases, got)) == cases


def test_display(spark):
    sizes = {0: "0 B", 1023: "1,023 B", 1024: "1.0 KB", 1280: "1.2 KB", 1792: "1.8 KB", 1536 * 1024: "1.5 MB", 5 * 1024**5: "5120.0 TB"}
    df = spark.createDataFrame([(k,) for k in sizes], "b long")
    assert {r[0]: r[1] for r in df.select("b", display.format_size(F.col("b"))).collect()} == sizes
    pairs = {(1, 200): "0%", (3, 200): "2%", (0, 0): "0%", (5, 200): "2%", (7, 200): "4%", (1, 3): "33%"}
    df = spark.createDataFrame(list(pairs), "n long, t long")
    got = {(r[0], r[1]): r[2] for r in df.select("n", "t", display.percent(F.col("n"), F.col("t"))).collect()}
    assert got == pairs == {k: f"{round(k[0] * 100 / k[1]) if k[1] else 0}%" for k in pairs}
    guarded = column(spark, ["=1", "+1", "-1", "@x", "1=", "", None], display.formula_guard)
    assert guarded == ["'=1", "'+1", "'-1", "'@x", "1=", "", ""]


def test_measures_by_the_residue(spark):
    """What is measured on a text without letters and spaces is that of the text."""
    texts = random_texts(1500, seed=9) + ["", " ", "a b", "it", "it_s api vpn", "hr0 it", "IT系统", "1 2a3", "1380013 8000", "备份　恢复\t\r\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    body, rest, low = F.col("t"), F.col("rest"), F.lower("t")
    rows = rows.withColumn("rest", normalize.residue(body)).withColumn("odd", normalize.is_odd(body))
    rows = rows.withColumn("unspaced", F.replace(low, F.lit(" "), F.lit("")))
    spaces = F.octet_length(low) - F.octet_length("unspaced")
    bare = normalize.drop_jvm_spaces(low)
    words = normalize.spell_out(normalize.words_to_half_width(low))
    marks = F.length(low) - F.length(F.replace(low, F.lit("�"), F.lit("")))
    ratio = F.coalesce(F.try_divide(marks, F.length(bare)), F.lit(0.0))
    pairs = [
        (normalize.is_odd(rest), F.col("odd")),
        (F.when(~F.col("odd"), text.content_of_residue(body, rest, spaces)), F.when(~F.col("odd"), text.content_length(body))),
        (F.when(~F.col("odd"), normalize.drop_jvm_spaces(F.col("unspaced"), rest)), F.when(~F.col("odd"), bare)),
        (F.when(~F.col("odd"), text.replacement_ratio(rest, bare)), F.when(~F.col("odd"), ratio)),
        (normalize.to_half_width(body, rest), normalize.to_half_width(body)),
        (F.when(~F.col("odd"), normalize.spell_out(normalize.words_to_half_width(low, rest), rest)), F.when(~F.col("odd"), words)),
        (F.when(~F.col("odd"), topics.keyword_hits(words, PACK, rest)), F.when(~F.col("odd"), topics.keyword_hits(words, PACK))),
        (risks.risk_counts(body, None, rest), risks.risk_counts(body)),
    ]
    for number, (quick, plain) in enumerate(pairs):
        wrong = rows.filter(~quick.eqNullSafe(plain)).select("t").limit(3).collect()
        assert not wrong, (number, wrong)


def test_measures_by_the_far_residue(spark):
    """Tests for what is not ASCII see a text without any, and find the same."""
    texts = random_texts(1500, seed=11) + ["", " ", "é1", "plain, ascii; text\n", "外a传", "禁止外传", "13800138000 密", "１３８００１３８０００"]
    texts += ["备份　恢复\t\r\n", "保密协议a保 密", "��x", "薪1资 工资 8,000元", "a@b.cc ß", "信息系统 it 财经共享"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    body, rest, far, low = F.col("t"), F.col("rest"), F.col("far"), F.lower("t")
    rows = rows.withColumn("rest", normalize.residue(body)).withColumn("odd", normalize.is_odd(body))
    rows = rows.withColumn("far", normalize.far_residue(rest)).withColumn("unspaced", F.replace(low, F.lit(" "), F.lit("")))
    bare = normalize.drop_jvm_spaces(low)
    spaces = F.octet_length(low) - F.octet_length("unspaced")
    words = normalize.spell_out(normalize.words_to_half_width(low))
    run = risks.has_digit_run(rest, F.col("odd"), far) & risks.has_digit_run(body, F.col("odd"), far)
    pairs = [
        (far != "", body.rlike(r"[^\n\x20-\x7e]")),
        (normalize.is_odd(far), F.col("odd")),
        (text.content_of_residue(body, rest, spaces, far), text.content_length(body)),
        (normalize.drop_jvm_spaces(F.col("unspaced"), rest, far), bare),
        (text.replacement_ratio(far, bare), text.replacement_ratio(body, bare)),
        (normalize.to_half_width(low, far), normalize.to_half_width(low)),
        (normalize.spell_out(normalize.words_to_half_width(low, far), far), words),
        (topics.keyword_hits(words, PACK, far), topics.keyword_hits(words, PACK)),
        (risks.risk_counts(body, run, rest, far), risks.risk_counts(body)),
    ]
    for number, (quick, plain) in enumerate(pairs):
        tested = rows if number in (0, 1, 8) else rows.filter(~F.col("odd"))
        wrong = tested.filter(~quick.eqNullSafe(plain)).select("t").limit(3).collect()
        assert not wrong, (number, wrong)


#: The patterns as they are defined, from the first character of what they find.
PLAIN_PATTERNS = {
    risks.PHONE: r"(?U)(?<!\d)1[3-9]\d{9}(?!\d)",
    risks.ID_NUMBER: r"(?U)(?<!\d)(?:\d{17}[0-9Xx]|\d{15})(?!\d)",
    risks.BANK_CARD: r"(?U)(?<!\d)(?:\d[ -]?){15,19}(?!\d)",
    risks.EMAIL: r"(?:(?<![A-Za-z\u0130\u0131\u017f\u212a0-9._%+-])|\G)[A-Za-z\u0130\u0131\u017f\u212a0-9._%+-]+"
    r"@[A-Za-z\u0130\u0131\u017f\u212a0-9.-]+\.[A-Za-z\u0130\u0131\u017f\u212a]{2,}(?![A-Za-z\u0130\u0131\u017f\u212a0-9_.-])",
}


def test_patterns_find_what_they_are_defined_to(spark):
    """A scan that stops at few characters finds the same."""
    rng = random.Random(21)
    mails = ["".join(rng.choices([*"ab.@-%+_ ,é1", ".ab", ".cd", "@ab", "b@c"], k=rng.randint(0, 18))) for _ in range(6000)]
    mails += ["@a.bc", "x@a.bc@d.ef", "x@a.bc+@d.ef", "x@a.bc%y@d.ef", "x@a.b-c@d.ef", "@@a.bc", "a@b@c.de", "x@a.bc x@a.bc"]
    digits = ["".join(rng.choices(["1", "3", "8", "1380013", "4111", "１", "\U0001d7d9", " ", "-", "x"], [9, 9, 9, 3, 3, 1, 1, 1, 1, 1], k=rng.randint(0, 22))) for _ in range(6000)]
    rows = spark.createDataFrame([(t,) for t in mails + digits], "t string")
    for number, (quick, plain) in enumerate(PLAIN_PATTERNS.items()):
        found = [F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (quick, plain)]
        if quick == risks.EMAIL:
            found = list(map(F.size, found))
        assert rows.filter(F.size(F.regexp_extract_all("t", F.lit(plain), F.lit(0))) > 0).count() > 20, number
        wrong = rows.filter(~found[0].eqNullSafe(found[1])).limit(3).collect()
        assert not wrong, (number, wrong)


def test_texts_are_scanned_for_what_is_rare(spark):
    """A text is cut at its card numbers once, not once for each use of a piece; words are
    told by two characters; which keywords occur in a found one is looked up."""
    plan = spark.range(1).select(F.col("id").cast("string").alias("t")).select(risks.card_count(F.col("t")).alias("n"))
    shown = plan._jdf.queryExecution().optimizedPlan().toString()
    assert (shown.count("split("), shown.count("regexp_extract_all(")) == (1, 1)
    assert topics._word_pattern(["api", "hr", "it"]).startswith("[ahi][prt](?<!")
    assert topics._word_pattern(["x", "hr"]).startswith("[hx](?<!")
    hits = spark.range(1).select(F.col("id").cast("string").alias("t")).select(topics.keyword_hits(F.col("t"), PACK).alias("n"))
    assert "exists(" not in hits._jdf.queryExecution().optimizedPlan().toString()


def test_keyword_hits_of_small_packs(spark):
    """A phrase counts where it is part of a longer one, a word only by itself; a list may be empty."""
    topic = type(PACK.topics[0])
    rules = replace(PACK, topics=tuple(topic(f"t{i}", "", k) for i, k in enumerate([("it", "保密", "保密协议"), ("保密协议书", "it系统", "协议"), ()])))
    cases = {"保密协议书": [2, 2, 0], "it系统": [1, 1, 0], "it 保密": [2, 0, 0], "协议": [0, 1, 0], "": [0, 0, 0]}
    assert dict(zip(cases, column(spark, list(cases), lambda t: topics.keyword_hits(t, rules)))) == cases
    assert column(spark, ["it"], lambda t: topics.keyword_hits(t, replace(PACK, topics=()))) == [[]]
