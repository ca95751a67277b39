"""Rules, groups and topics on small literal corpora."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpuscope import analyze, extract_features
from corpuscope import rulepack as rp
from corpuscope.operators import groups, topics
from corpuscope.operators.components import star_components
from corpuscope.operators.pairing import pair_rows
from corpuscope.operators.skew import number_rows, split_join
from corpuscope.plans import reports
from corpuscope.rulepack import DEFAULT_PACK as PACK

NOW = datetime(2024, 1, 1)
SCHEMA = "doc_id long, root_name string, relative_path string, size_bytes long, modified_at timestamp, text string, content binary"
LONG = "这是一段足够长的正文内容用来避免其他规则触发。" * 12


def doc(doc_id, path, text=None, *, content=None, modified=datetime(2023, 6, 1), root="项目", size=None):
    text = f"{LONG}{doc_id}" if text is None else text
    raw = f"{doc_id}".encode() if content is None else content
    return (doc_id, root, path, len(raw) if size is None else size, modified, text, bytearray(raw))


def corpus(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def issues_of(spark, rows):
    found = extract_features(corpus(spark, rows), NOW)
    return {r[0]: [f["issue"] for f in r[1]] for r in found.select("doc_id", "findings").collect()}


def test_length_boundaries(spark):
    rows = [doc(n, f"d{n}.txt", "a" * n) for n in (0, 1, 49, 50, 199, 200)] + [doc(1199, "d.xlsx", "a" * 199)]
    got = issues_of(spark, rows)
    assert got == {
        0: ["没有读取到有效内容"], 1: ["有效内容过少"], 49: ["有效内容过少"], 50: ["内容较短"], 199: ["内容较短"], 200: [], 1199: [],
    }


def test_garbled_boundaries(spark):
    rows = [
        doc(1, "a.txt", "�" * 30 + "a" * 70 * 10), doc(2, "b.txt", "�" * 100 + "a" * 900), doc(3, "c.txt", "�" * 99 + "a" * 901),
        doc(4, "d.txt", "�" * 300 + "a" * 700), doc(5, "e.txt", "�" * 299 + "a" * 701), doc(6, "f.txt", "\x01" * 300 + "a" * 700),
    ]
    got = issues_of(spark, rows)
    assert got == {1: [], 2: ["部分文字可能是乱码"], 3: [], 4: ["内容主要是乱码"], 5: ["部分文字可能是乱码"], 6: ["内容主要是乱码"]}


def test_age_boundaries(spark):
    days = {1: 1095, 2: 1096, 3: 1826, 4: 1827, 5: -10}
    rows = [doc(i, f"d{i}.txt", modified=NOW - timedelta(days=d)) for i, d in days.items()]
    assert issues_of(spark, rows) == {1: [], 2: ["超过3年未更新"], 3: ["超过3年未更新"], 4: ["超过5年未更新"], 5: []}


def test_status_semantics(spark):
    rows = [
        doc(1, "附件一览.txt"), doc(2, "通讯录.txt", LONG + "13800138000"), doc(3, "工资.txt", LONG + "月薪8000元"),
        doc(4, "旧.doc", ""), doc(5, "x.zip", ""), doc(6, "正常资料.txt"),
    ]
    got = {r["doc_id"]: r for r in analyze(corpus(spark, rows), NOW).records.collect()}
    assert (got[1].use_status, got[1].priority) == (rp.READY, rp.MEDIUM)
    assert (got[2].use_status, got[2].priority, got[2].sensitive_risks) == (rp.READY, rp.LOW, "手机号码（1处）")
    assert (got[3].use_status, got[3].priority) == (rp.NEEDS_WORK, rp.MEDIUM)
    assert (got[4].use_status, got[4].issues) == (rp.NEEDS_WORK, rp.ISSUE_LEGACY)
    assert (got[5].use_status, got[5].priority) == (rp.NOT_READY, rp.HIGH)
    assert (got[6].use_status, got[6].priority, got[6].issues) == (rp.READY, "", "")


def duplicate_rows():
    return [
        doc(1, "z/a.txt", "甲" * 30, content=b"same"),
        doc(2, "z/b.txt", "乙" * 30, content=b"same"),
        doc(3, "z/c.txt", "乙" * 30, content=b"c"),
        doc(4, "z/short1.txt", "丙" * 19, content=b"d"),
        doc(5, "z/short2.txt", "丙" * 19, content=b"e"),
        doc(6, "y/t1.txt", "丁" * 20, content=b"f"),
        doc(7, "y/t2 副本.txt", "丁" * 20, content=b"g", modified=datetime(2023, 12, 1)),
        doc(8, "x/empty1.txt", "", content=b""),
        doc(9, "x/empty2.txt", "", content=b""),
        doc(11, "w/Tie.txt", "戊" * 40, content=b"h"),
        doc(10, "w/tie.txt", "戊" * 40, content=b"i"),
    ]


@pytest.mark.parametrize("hot_rows", [1_000_000, 2, 3])
def test_duplicate_components_and_keepers(spark, hot_rows):
    docs = extract_features(corpus(spark, duplicate_rows()).repartition(5), NOW)
    members = groups.duplicate_members(docs, PACK, hot_rows)
    assert dict(members.collect()) == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 10: 10, 11: 10}
    marks = {r.doc_id: (r.duplicate_group, r.is_primary) for r in groups.duplicate_marks(docs, PACK, hot_rows).collect()}
    # w/ sorts before y/ before z/; the newest of equals by path, copies last, ties to the smaller id
    assert marks == {
        10: ("重复组001", True), 11: ("重复组001", False), 6: ("重复组002", True), 7: ("重复组002", False),
        1: ("重复组003", False), 2: ("重复组003", False), 3: ("重复组003", True),
    }


def test_version_families(spark):
    rows = [
        doc(1, "a/手册文件v1.txt"), doc(2, "a/手册文件v2.txt"), doc(3, "b/手册文件v1.txt"),
        doc(4, "c/报告文件.txt"), doc(5, "c/报告 文件.txt"),
        doc(6, "d/规范文件v1.txt", LONG), doc(7, "d/规范文件v2.txt", LONG),
        doc(8, "e/章程文件v1.txt", ""), doc(9, "e/章程文件v2.txt", ""),
        doc(10, "f/Guide文件v1.txt"), doc(11, "f/guide文件V1.txt"),
        doc(12, "g/ab v1.txt"), doc(13, "g/ab v2.txt"),
    ]
    docs = extract_features(corpus(spark, rows), NOW)
    for hot_rows in (1_000_000, 2):
        got = {r.doc_id: r.version_group for r in groups.version_marks(docs, PACK, hot_rows).collect()}
        assert got == {1: "版本组001", 2: "版本组001", 8: "版本组002", 9: "版本组002"}


def brute_components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "mixed"])
@pytest.mark.parametrize("hot_rows", [1_000_000, 5])
def test_star_components(spark, shape, hot_rows):
    rng = random.Random(1)
    pairs = {
        "random": {tuple(sorted(rng.sample(range(60), 2))) for _ in range(45)},
        "chain": {(i, i + 1) for i in range(40)},
        "star": {(7, i) for i in range(8, 60)} | {(i, 99) for i in range(0, 5)},
        "mixed": {(i, i + 3) for i in range(0, 50, 2)} | {(0, 200), (199, 200), (198, 199)},
    }[shape]
    stars = star_components(spark.createDataFrame(sorted(pairs), "lo long, hi long"), hot_rows)
    got = {r.hi: r.lo for r in stars.collect()}
    want = brute_components(pairs)
    assert got == {x: root for x, root in want.items() if x != root}


def test_split_join_equals_plain_join(spark):
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    keys = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k % 2 = 0")
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(keys, "k", how).select("id", "k", "n").collect()))
        for hot in (1, 100, 10_000):
            got = split_join(rows, keys, ["k"], "n", how, hot).select("id", "k", "n").collect()
            assert sorted(map(str, got)) == want


def test_number_rows_is_a_global_rank(spark):
    rows = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("v")).repartition(7)
    numbered = number_rows(rows, [F.col("v")], "pos").orderBy("v").collect()
    assert [r.pos for r in numbered] == list(range(1, 5001))


def test_pair_rows_rejects_uneven_sides(spark):
    left = spark.range(5).withColumnRenamed("id", "doc_id")
    assert pair_rows(left, left.withColumn("x", F.lit(1))).count() == 5
    with pytest.raises(Exception, match="same documents"):
        pair_rows(left, left.filter("doc_id < 4").withColumn("x", F.lit(1))).collect()


def topic_of(spark, rows):
    return {r.doc_id: r.topic for r in extract_features(corpus(spark, rows), NOW).select("doc_id", "topic").collect()}


def test_topic_choice(spark):
    body = lambda words: words + "x" * 200
    rows = [
        doc(1, "a.txt", body("合同协议"), root="杂项"),  # 2 points
        doc(2, "a.txt", body("合同协议法务"), root="杂项"),  # 3 points
        doc(3, "a.txt", body("销售客户合同协议"), root="杂项"),  # weak tie
        doc(4, "kit使用.txt", body(""), root="杂项"),
        doc(5, "IT手册.txt", body(""), root="杂项"),
        doc(6, "财经/a.txt", body(""), root="公司资料"),  # strong tie, by name
        doc(7, "x/a.txt", body(""), root="华东经销商"),
        doc(8, "门店销售助手/a.txt", body(""), root="资料"),
        doc(9, "a.txt", "x" * 50_000 + "合同协议法务", root="杂项"),  # scored to its end
    ]
    got = topic_of(spark, rows)
    assert got == {
        1: rp.PENDING, 2: "合同与法务知识库", 3: rp.PENDING, 4: rp.PENDING, 5: "IT系统与运维知识库",
        6: "财务与经营知识库", 7: "经销商与客户服务知识库", 8: "门店销售助手知识库", 9: "合同与法务知识库",
    }


def topic_docs(spark, counts):
    rows = [(name, i) for name, n in counts.items() for i in range(n)]
    rows = [(k, f"{k:05d}", "n", t) for k, (t, _) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, path_key string, name_key string, topic string")


def final_counts(spark, counts):
    mapping = topics.final_topics(topic_docs(spark, counts), PACK)
    out = {}
    for r in mapping.collect():
        out[r.final_topic] = out.get(r.final_topic, 0) + counts[r.topic]
    return out


def test_absorb_and_cap(spark):
    assert final_counts(spark, {"A": 9, "B": 1}) == {"A": 10}
    assert final_counts(spark, {"A": 8, "B": 1}) == {"A": 8, "B": 1}
    assert final_counts(spark, {"A": 79, "B": 20, "C": 1}) == {"A": 79, "B": 20, "C": 1}
    assert final_counts(spark, {"A": 80, "B": 19, "C": 1}) == {"A": 81, "B": 19}
    assert final_counts(spark, {"A": 92, "B": 3, "C": 5, rp.PENDING: 40}) == {"A": 95, "C": 5, rp.PENDING: 40}
    seven = {t.name: 5 for t in rp.TOPICS[:7]}
    assert final_counts(spark, seven) == {**{t.name: 5 for t in rp.TOPICS[:6]}, rp.PENDING: 5}


RECORD = {
    "doc_id": 0, "relative_path": "p", "path_key": "p", "name_key": "p", "issues": "", "parse_issue": "", "scan_note": "",
    "sensitive_risks": "", "duplicate_group": "", "version_group": "", "use_status": rp.READY, "parse_status": rp.DIRECT,
    "content_length": 0, "document_scale": 0, "display_type": "文本", "size_bytes": 1, "priority": "", "suggested_knowledge_base": rp.PENDING,
}


def records(spark, rows):
    full = [{**RECORD, "doc_id": i, "path_key": f"{i:04d}", **r} for i, r in enumerate(rows)]
    names = list(RECORD)
    types = {"doc_id": "long", "content_length": "int", "document_scale": "int", "size_bytes": "long"}
    return spark.createDataFrame(
        [tuple(r[n] for n in names) for r in full], ", ".join(f"{n} {types.get(n, 'string')}" for n in names)
    )


def test_sensitive_problem_is_forced_into_the_top(spark):
    sizes = {"内容较短": 9, "疑似扫描文件": 8, "旧版Office": 7, "超过3年未更新": 6, "文件名称或归档位置不清楚": 5, "可能包含敏感信息": 1}
    rows = [{"issues": issue} for issue, n in sizes.items() for _ in range(n)]
    top = reports.top_problems(records(spark, rows)).collect()
    assert [(r.ord, r.label, r.n) for r in sorted(top)] == [
        (1, "内容为空或过少", 9), (2, "扫描文件", 8), (3, "无法正常读取", 7), (4, "长期未更新", 6), (5, "可能包含敏感信息", 1),
    ]


def test_examples_and_main_issue(spark):
    rows = [{"issues": "内容较短；超过3年未更新", "relative_path": f"p{i}"} for i in range(6)]
    df = records(spark, rows)
    shown = [(r.label, r.ord, r.relative_path, r.detail, r.remaining) for r in reports.problem_examples(df).collect()]
    assert sorted(shown) == sorted(
        [("内容为空或过少", i + 1, f"p{i}", "内容较短", 2) for i in range(4)]
        + [("长期未更新", i + 1, f"p{i}", "超过3年未更新", 2) for i in range(4)]
    )
    tie = records(spark, [{"issues": "超过5年未更新"}, {"issues": "有效内容过少"}, {"issues": "有效内容过少；超过5年未更新"}])
    assert [r.main_issue for r in reports.main_issue(tie).collect()] == ["部分资料需要确认是否仍然有效（2份）"]


def test_length_bins(spark):
    lengths = [0, 499, 500, 1999, 2000, 4999, 5000, 9999, 10000]
    df = records(spark, [{"content_length": n} for n in lengths])
    got = {r.label: r.n for r in reports.length_distribution(df).collect()}
    assert got == {"500字以内": 2, "500～2,000字": 2, "2,000～5,000字": 2, "5,000～10,000字": 2, "10,000字以上": 1}
    special = records(spark, [{"parse_status": rp.SPECIAL}])
    assert {r.label: r.n for r in reports.length_distribution(special).collect()}["暂无法统计"] == 1


def test_result_does_not_depend_on_input_order(spark):
    rows = duplicate_rows()
    first = analyze(corpus(spark, rows).coalesce(1), NOW).table().orderBy("doc_id").collect()
    random.Random(2).shuffle(rows)
    second = analyze(corpus(spark, rows).repartition(6), NOW, hot_rows=2).table().orderBy("doc_id").collect()
    assert first == second


def test_odd_text_and_names_go_through_the_udf(spark):
    rows = [
        doc(1, "①财经/ﬁnal报告.txt", "…①" + "甲" * 60), doc(2, "b/x.txt", "...1" + "甲" * 60),
        doc(3, "c/y.txt", "Ⅱ" * 50_001 + "合同协议法务"), doc(4, "c/z.txt", "合同协议法务" + "Ⅱ" * 50_001),
    ]
    got = {r.doc_id: r for r in extract_features(corpus(spark, rows), NOW).collect()}
    assert got[1].text_fp == got[2].text_fp
    assert (got[1].version_key, got[1].version_marker) == ("报告", True)
    assert (got[3].topic, got[4].topic) == ("合同与法务知识库", "合同与法务知识库")


def test_groups_are_counted_in_any_subset(spark):
    rows = [(i, f"a/制度{i}v{v}.txt", 10, "正文" * 30 + str(v) + "x" * i) for i in (1, 2, 3) for v in (1, 2)]
    docs = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], "doc_id long, relative_path string, size_bytes long, text string")
    records = analyze(docs.withColumn("modified_at", F.lit("2023-01-01").cast("timestamp")), "2024-01-01 00:00:00").records
    names = sorted({r.version_group for r in records.collect()} - {""})
    assert len(names) == 3
    for kept in (names, names[2:], names[::2], []):
        part = records.filter(F.col("version_group").isin(kept))
        note = {r.metric: r.note for r in reports.key_metrics(part).collect()}
        assert any(f"涉及{len(kept)}组" in text for text in note.values())
