"""Writing the audit's outputs: staged, verified, then committed by rename."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import reports
from ..plans.audit import Audit

MANIFEST = "_manifest.json"


class OutputError(RuntimeError):
    """The output folder is unsafe, taken, or incomplete after the run."""


class Folder:
    """A path as the session's Hadoop file systems see it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        raw = self.hadoop.Path(path)
        self.fs = raw.getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = self.fs.makeQualified(raw)

    def __str__(self) -> str:
        return self.path.toString()

    def child(self, name: str) -> Folder:
        return Folder(self.spark, f"{self}/{name}")

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def delete(self) -> None:
        self.fs.delete(self.path, True)

    def rename_to(self, other: Folder) -> None:
        self.fs.mkdirs(other.path.getParent())
        if not self.fs.rename(self.path, other.path):
            raise OutputError(f"{self} could not be moved to {other}")

    def resolved(self) -> list[str]:
        """Scheme, authority and path components, links of the existing part followed."""
        uri = self.path.toUri()
        scheme, host, path = uri.getScheme() or "", uri.getAuthority() or "", uri.getPath()
        if scheme == "file":
            path = os.path.realpath(path)
        else:
            there, rest = self.path, []
            while there.getParent() is not None and not self.fs.exists(there):
                rest.insert(0, there.getName())
                there = there.getParent()
            base = self.fs.resolvePath(there).toUri().getPath() if self.fs.exists(there) else there.toUri().getPath()
            path = "/".join([base, *rest])
        return [scheme, host, *[part for part in path.split("/") if part]]

    def write_text(self, text: str) -> None:
        stream = self.fs.create(self.path, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()


def check_target(target: str, source: str | None, spark: SparkSession | None = None) -> None:
    """The output may not equal the audited folder or lie inside it, whatever way both are
    written: relative, as URIs, through links."""
    if source is None:
        return
    spark = spark or SparkSession.active()
    inner, outer = Folder(spark, target).resolved(), Folder(spark, source).resolved()
    if inner[: len(outer)] == outer:
        raise OutputError(f"output {target} lies in the audited folder {source}")


@dataclass(frozen=True)
class Written:
    """What an output must hold: row count and a checksum that ignores the order of rows."""

    rows: int
    checksum: int


def row_hash(schema: T.StructType) -> Column:
    """A hash of a whole row; maps count by their sorted entries."""

    def hashed(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.MapType):
            return F.to_json(F.array_sort(F.map_entries(column)))
        return column

    # Nulls are skipped by the hash, so each column says whether it is one.
    columns = [hashed(f) for f in schema]
    return F.xxhash64(*columns, F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in columns]))


def sums(schema: T.StructType) -> list[Column]:
    total = F.sum(row_hash(schema).cast("decimal(38,0)"))
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(total, F.lit(0).cast("decimal(38,0)")).alias("checksum")]


def write_staged(df: DataFrame, path: str) -> Written:
    """Write parquet; the count and checksum are taken while the rows pass."""
    seen = Observation()
    df.observe(seen, *sums(df.schema)).write.mode("errorifexists").parquet(path)
    return Written(seen.get["rows"], int(seen.get["checksum"]))


def verify_output(df: DataFrame, path: str, expected: Written) -> int:
    """Read an output back and compare schema, row count and checksum with what was written."""
    back = df.sparkSession.read.parquet(path)
    if back.schema.simpleString() != df.schema.simpleString():
        raise OutputError(f"{path}: schema differs from what was written")
    found = back.agg(*sums(back.schema)).first()
    if found["rows"] != expected.rows:
        raise OutputError(f"{path}: {found['rows']} rows read back, {expected.rows} written")
    if int(found["checksum"]) != expected.checksum:
        raise OutputError(f"{path}: values differ from what was written")
    return expected.rows


def commit(outputs: dict[str, DataFrame], target: str, overwrite: bool = False) -> dict[str, int]:
    """Write ``outputs`` below ``target``: first into a staging folder there, where every one
    is read back and verified, then by rename. The manifest is written last, so a folder with
    a manifest is complete; a run that fails before the renames leaves the target as it was."""
    spark = next(iter(outputs.values())).sparkSession
    folder = Folder(spark, target)
    taken = [n for n in outputs if folder.child(n).exists()]
    if taken and not overwrite:
        raise OutputError(f"{target} already holds {', '.join(taken)}")
    staging = folder.child(f"_staging-{uuid.uuid4().hex}")
    try:
        written = {name: write_staged(df, str(staging.child(name))) for name, df in outputs.items()}
        for name, df in outputs.items():
            verify_output(df, str(staging.child(name)), written[name])
        folder.child(MANIFEST).delete()
        for name in outputs:
            if name in taken:
                folder.child(name).rename_to(staging.child(f"replaced/{name}"))
            staging.child(name).rename_to(folder.child(name))
        facts = {n: {"rows": w.rows, "checksum": str(w.checksum)} for n, w in written.items()}
        folder.child(MANIFEST).write_text(json.dumps(facts, ensure_ascii=False, indent=1))
    finally:
        staging.delete()
    return {name: w.rows for name, w in written.items()}


def write_checked(df: DataFrame, path: str, overwrite: bool = False) -> int:
    """One output of its own, staged and verified like those of ``write_outputs``."""
    parent, _, name = path.rstrip("/").rpartition("/")
    folder = Folder(df.sparkSession, parent or ".")
    staging = folder.child(f"_staging-{uuid.uuid4().hex}")
    taken = folder.child(name).exists()
    if taken and not overwrite:
        raise OutputError(f"{path} exists")
    try:
        written = write_staged(df, str(staging.child(name)))
        rows = verify_output(df, str(staging.child(name)), written)
        if taken:
            folder.child(name).rename_to(staging.child(f"replaced/{name}"))
        staging.child(name).rename_to(folder.child(name))
    finally:
        staging.delete()
    return rows


def write_outputs(
    audit: Audit, target: str, source: str | None = None, overwrite: bool = False
) -> dict[str, int]:
    """Write records, report, both lists and the run summary below ``target``.

    All targets are checked before the first job, so nothing is half done when
    one of them is taken."""
    records = audit.records
    check_target(target, source, records.sparkSession)
    outputs = {
        "records": audit.table(),
        "report": reports.report_datasets(records, audit.pack),
        "rectification": reports.rectification_list(records),
        "inventory": reports.inventory_list(records),
        "summary": reports.run_summary(records, audit.skipped, audit.errors),
    }
    return commit(outputs, target, overwrite)
