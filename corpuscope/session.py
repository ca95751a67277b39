"""Session settings and the shared scratch area used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Aggregate sorted rows group by group. ``assemble_documents`` turns it on, because lists of
#: texts by millions of small groups otherwise fill a hash table and are sorted after all.
SORTED_GROUPS = "spark.sql.execution.replaceHashWithSortAgg"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Batches to Python are cut by bytes, since a few of the rows may be whole texts.
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    SORTED_GROUPS: "false",
}


def build_session(app: str = "corpuscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the audit expects; extra settings by keyword
    (``__`` stands for a dot)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_session(spark: SparkSession) -> SparkSession:
    """Apply the runtime-changeable settings to a session made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` of the cluster.

    Only a local session may fall back to a temporary folder of its own; on a
    cluster a machine-local folder would be invisible to the other executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="corpuscope-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """A folder of the scratch area for the tables written inside ``with``.

    ``drop`` deletes them; nothing that still reads one may be used afterwards."""

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{scratch_root(spark)}/corpuscope/run-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        Scratch._open.append(self)
        return self

    def __exit__(self, *error: object) -> None:
        Scratch._open.remove(self)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch area and read it back.

    The result survives lost executors, is computed once however many branches
    use it, and keeps column pruning (the reason for parquet over an RDD
    checkpoint)."""
    spark = df.sparkSession
    folder = Scratch._open[-1].folder if Scratch._open else f"{scratch_root(spark)}/corpuscope"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more, before their folder goes."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path:
            jvm = table.sparkSession._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)
