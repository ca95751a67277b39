"""File trees, decoding and outputs."""

import hashlib
import json
import os
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuscope import audit_folder
from corpuscope import rulepack as rp
from corpuscope.sinks import writer
from corpuscope.sinks.writer import OutputError, check_target, write_outputs
from corpuscope.sources import content, tree as trees
from corpuscope.sources.content import read_documents, read_text
from corpuscope.sources.inventory import scan_corpus
from corpuscope.sources.tree import Splits, Walker, Work


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "公司资料"
    (root / "sub").mkdir(parents=True)
    (root / "__pycache__").mkdir()
    (root / ".git" / "deep").mkdir(parents=True)
    files = {
        "a.txt": "甲文件正文".encode(),
        "sub/空.md": "乙".encode(),
        "sub/e f.txt": b"plain",
        "sub/p%20q.txt": b"percent",
        "_b.txt": b"underscore",
        "sub/zero.txt": b"",
        ".c.txt": b"x",
        "~$d.docx": b"x",
        "Thumbs.db": b"x",
        ".~lock.x#": b"x",
        "__pycache__/x.txt": b"x",
        "__pycache__/y.txt": b"x",
        ".git/deep/z.txt": b"x",
        "gb.txt": "中文内容".encode("gb18030"),
        "u16.txt": "中文内容".encode("utf-16"),
        "bom.txt": b"\xef\xbb\xbf" + "中文内容".encode(),
        "nul.txt": b"\x00" + "中文内容".encode(),
        "bad.txt": b"\xff\xfe\xd8",
        "archive.zip": b"PK",
        "old.doc": b"D0CF",
    }
    for name, data in files.items():
        (root / name).write_bytes(data)
    os.symlink(root / "a.txt", root / "link.txt")
    os.symlink(root / "sub", root / "linkdir")
    return str(root)


def test_scan(spark, tree):
    found = scan_corpus(spark, tree)
    names = {r.relative_path for r in found.files.collect()}
    assert names == {
        "a.txt", "sub/空.md", "sub/e f.txt", "sub/p%20q.txt", "_b.txt", "sub/zero.txt", "gb.txt", "u16.txt", "bom.txt",
        "nul.txt", "bad.txt", "archive.zip", "old.doc",
    }
    # four junk files, two ignored folders, one linked folder; linked files do not count
    assert found.skipped.first()[0] == 7
    assert found.errors.count() == 0
    assert found.files.select("doc_id").distinct().count() == len(names)


def test_decoding(spark, tree):
    listed = scan_corpus(spark, tree).files
    docs = read_documents(listed)
    bytes_ = {r.relative_path: r for r in docs.collect()}
    for path, row in bytes_.items():
        with open(f"{tree}/{path}", "rb") as file:
            assert row.content_sha256 == hashlib.sha256(file.read()).hexdigest()
    # The same rows from a table that holds the bytes.
    rows = []
    for path in bytes_:
        with open(f"{tree}/{path}", "rb") as file:
            rows.append((path, bytearray(file.read()), None, None))
    schema = "relative_path string, content binary, error_kind string, error_name string"
    table = read_text(spark.createDataFrame(rows, schema))
    pick = ("relative_path", "text", "parse_status", "parse_issue")
    assert sorted(table.select(*pick).collect()) == sorted(docs.select(*pick).collect())
    got = {r.relative_path: (r.text, r.parse_status, r.parse_issue) for r in docs.collect()}
    for name in ("gb.txt", "u16.txt", "bom.txt"):
        assert got[name] == ("中文内容", rp.DIRECT, "")
    assert got["sub/zero.txt"] == ("", rp.DIRECT, "")
    assert got["nul.txt"] == got["bad.txt"] == ("", rp.SPECIAL, rp.ISSUE_ENCODING)
    assert got["old.doc"][1:] == (rp.SPECIAL, rp.ISSUE_LEGACY)
    assert got["archive.zip"][1:] == (rp.UNAVAILABLE, rp.ISSUE_UNSUPPORTED)


def test_missing_file_becomes_a_status(spark, tree):
    files = scan_corpus(spark, tree).files.withColumn(
        "path", F.when(F.col("relative_path") == "a.txt", F.concat("path", F.lit(".gone"))).otherwise(F.col("path"))
    )
    got = {r.relative_path: r.parse_issue for r in read_documents(files).collect()}
    assert got["a.txt"] == "文件可能损坏或格式异常（FileNotFoundError）"


def test_full_run_from_a_folder(spark, tree, tmp_path):
    audit = audit_folder(spark, tree, "2030-01-01 00:00:00")
    got = {r.relative_path: r for r in audit.table().collect()}
    assert len(got) == 13
    assert got["sub/zero.txt"].issues.startswith("没有读取到有效内容")
    target = str(tmp_path / "out")
    rows = write_outputs(audit, target, tree)
    assert rows["records"] == rows["inventory"] == 13 and rows["summary"] == 1
    summary = spark.read.parquet(f"{target}/summary").first()
    assert (summary.total_files, summary.skipped_system_files, summary.access_errors_count) == (13, 7, 0)
    with pytest.raises(OutputError, match="already holds"):
        write_outputs(audit, target, tree)
    assert write_outputs(audit, target, tree, overwrite=True) == rows


def test_target_inside_source_is_rejected(spark, tree, tmp_path, monkeypatch):
    os.symlink(tree, tmp_path / "link")
    monkeypatch.chdir(tree)
    link = str(tmp_path / "link")
    inside = (tree, tree + "/", tree + "/out", tree + "/sub/../out", "file:" + tree + "/x", "file://" + tree, link, link + "/new/x")
    for bad in inside:
        for source in (tree, "file://" + tree + "/", link):
            with pytest.raises(OutputError):
                check_target(bad, source, spark)
    check_target(tree + "-results", tree, spark)
    check_target(str(tmp_path / "out"), link, spark)
    check_target("anywhere", None)


def test_outputs_are_verified_before_they_are_committed(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, "a", {"x": 1}), (2, None, None), (2, None, None)], "i long, s string, m map<string,int>")
    target = str(tmp_path / "out")
    assert writer.commit({"one": rows, "none": rows.limit(0)}, target) == {"one": 3, "none": 0}
    facts = json.loads((tmp_path / "out" / writer.MANIFEST).read_text())
    assert facts["one"]["rows"] == 3
    assert {n for n in os.listdir(target) if not n.endswith(".crc")} == {"one", "none", writer.MANIFEST}
    written = writer.Written(3, int(facts["one"]["checksum"]))
    assert writer.verify_output(rows, f"{target}/one", written) == 3
    for changed in (rows.limit(2), rows.withColumn("s", F.lit("a")), rows.withColumn("m", F.when(F.col("i") == 1, F.col("m")).otherwise(F.create_map())), rows.unionByName(rows.limit(1))):
        path = str(tmp_path / f"changed-{uuid.uuid4().hex}")
        changed.write.parquet(path)
        with pytest.raises(OutputError):
            writer.verify_output(rows, path, written)
    with pytest.raises(OutputError, match="already holds"):
        writer.commit({"one": rows}, target)
    monkeypatch.setattr(writer, "verify_output", lambda *a: (_ for _ in ()).throw(OutputError("odd")))
    with pytest.raises(OutputError, match="odd"):
        writer.commit({"one": rows.limit(1)}, target, overwrite=True)
    assert spark.read.parquet(f"{target}/one").count() == 3
    assert not [n for n in os.listdir(target) if n.startswith("_staging")]


def wide_tree(tmp_path):
    """600 files in one folder, a deep branch, an ignored and an unreadable entry."""
    root = tmp_path / "wide"
    deep = root.joinpath(*[f"d{i}" for i in range(12)])
    deep.mkdir(parents=True)
    (root / "many").mkdir()
    (root / ".git").mkdir()
    for i in range(600):
        (root / "many" / f"f {i}.txt").write_text(str(i))
    for i in range(12):
        root.joinpath(*[f"d{j}" for j in range(i + 1)], f"x{i}.md").write_text("x")
    (root / ".git" / "gone.txt").write_text("x")
    return str(root)


def plain_tree(root):
    found = {}
    for folder, dirs, files in os.walk(root):
        dirs[:] = [d for d in dirs if not d.startswith(".")]
        found |= {os.path.relpath(os.path.join(folder, f), root): os.path.getsize(os.path.join(folder, f)) for f in files}
    return found


def test_a_tree_is_split_by_names_and_handed_on(spark, tmp_path):
    root = wide_tree(tmp_path)
    for splits in (Splits(), Splits(split_names=50), Splits(split_names=50, planned_folders=1, folders_per_task=1, walked_folders=2)):
        entries = trees.list_tree(spark, root, splits)
        files = [(r.relative_path, r.size_bytes) for r in entries.filter("kind = 'file'").collect()]
        assert Counter(files) == Counter(plain_tree(root).items())
        assert entries.filter("kind = 'dir' and relative_path = '.git'").count() == 1
    tasks = Walker(root, Splits(split_names=50)).plan()
    assert len(tasks) > 600 / 50 and all(len(task.ranges) <= 64 for task in tasks)
    spark_rows = spark.read.format("corpus_tree").option("split_names", 50).load(root)
    assert spark_rows.rdd.getNumPartitions() == len(tasks)


def test_uris_and_stores_give_the_same_entries(spark, tmp_path):
    root = wide_tree(tmp_path)
    want = sorted((r.relative_path, r.size_bytes, r.modified_at) for r in scan_corpus(spark, root).files.collect())
    for uri in ("file://" + root, "file:" + root):
        listing = scan_corpus(spark, uri)
        assert sorted((r.relative_path, r.size_bytes, r.modified_at) for r in listing.files.collect()) == want
        assert listing.skipped.first()[0] == 1
        assert {r.text for r in read_documents(listing.files).collect()} == {str(i) for i in range(600)} | {"x"}
    store = trees.Store("file://" + root)  # a mount looked at as a store
    walker = Walker(root, Splits())
    walker.tree = store
    rows = [r for batch in walker.run(Work(branches=("",))) for r in batch.to_pylist() if r["kind"] == "file"]
    assert sorted((r["relative_path"], r["size_bytes"]) for r in rows) == [x[:2] for x in want]
    assert rows[0]["path"].startswith("file://" + root) and store.open(rows[0]["path"]).read()


def test_missing_roots_and_folders(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        scan_corpus(spark, str(tmp_path / "none"))
    (tmp_path / "file").write_text("x")
    with pytest.raises(NotADirectoryError):
        scan_corpus(spark, str(tmp_path / "file"))
    work = spark.createDataFrame([("gone", None, None), ("away", "", None)], "relative_path string, low string, high string")
    rows = trees.list_folders(work, str(tmp_path)).collect()
    assert {r.kind for r in rows} == {"error"} and all("No such file" in r.error for r in rows) and len(rows) == 2


def test_large_files_are_hashed_in_chunks_and_too_large_texts_get_a_status(spark, tmp_path):
    root = tmp_path / "large"
    root.mkdir()
    with open(root / "sparse.bin", "wb") as file:
        file.truncate(3 << 30)
    (root / "big.txt").write_text("a" * (3 << 20) + "é" * 10)
    (root / "odd.txt").write_bytes(b"a" * (2 << 20) + "中".encode("gb18030"))
    (root / "late.txt").write_bytes(b"a" * (2 << 20) + b"\x00")
    (root / "fits.md").write_bytes(b"\xef\xbb\xbf" + ("ab中" * 400_000).encode())
    files = scan_corpus(spark, str(root)).files
    got = {r.relative_path: r for r in read_documents(files, largest_text=(3 << 20) + 19).collect()}
    zeros = hashlib.sha256()
    for _ in range(3 << 10):
        zeros.update(bytes(1 << 20))
    assert got["sparse.bin"].content_sha256 == zeros.hexdigest() and got["sparse.bin"].text == ""
    assert got["big.txt"].parse_issue == "文件读取异常（FileTooLarge）" and got["big.txt"].text == ""
    assert got["big.txt"].content_sha256 == hashlib.sha256((root / "big.txt").read_bytes()).hexdigest()
    assert got["odd.txt"].text == "a" * (2 << 20) + "中" and got["odd.txt"].parse_status == rp.DIRECT
    assert got["late.txt"].parse_issue == rp.ISSUE_ENCODING
    assert got["fits.md"].text == "ab中" * 400_000


def test_tasks_are_filled_by_bytes(spark):
    sizes = [1 << 20] * 100 + [200 << 20] * 5 + [0] * 3_000 + [None]
    files = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, size_bytes long").repartition(7)
    dealt = content.balanced(files, 32 << 20)
    parts = dealt.groupBy(F.spark_partition_id().alias("p")).agg(
        F.sum(F.coalesce("size_bytes", F.lit(0)) + content.OPEN_BYTES).alias("bytes"), F.max("size_bytes").alias("most")
    )
    assert dealt.count() == len(sizes)
    assert all(r.bytes - (r.most or 0) <= (32 << 20) + content.OPEN_BYTES for r in parts.collect())


def test_a_written_tree_never_holds_a_batch_of_texts_as_objects(spark, monkeypatch):
    """texts stay in the Arrow batch; no pandas copy of 10,000 of them."""
    from checks import fixtures

    folder = "/root/testdata/sf0.001"
    rows = fixtures.table(spark, folder, "tree")
    texts = {r.relative_path: r.text for r in rows.collect()}
    monkeypatch.setattr(type(rows), "mapInPandas", None)
    root = fixtures.write_tree(spark, folder)
    for path, text in texts.items():
        with open(os.path.join(root, path), "rb") as file:
            assert file.read() == text.encode()
