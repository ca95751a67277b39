"""File contents: fingerprints and decoding, chunk by chunk."""

from __future__ import annotations

import codecs
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths
from ..operators.elements import extract_dispatch
from ..session import materialize
from .tree import open_file

#: Files are read, hashed and decoded in pieces of this size.
CHUNK_BYTES = 1 << 20
BATCH_BYTES = 64 << 20
TASK_BYTES = 256 << 20
#: What opening a file costs, in bytes read: a task of tiny files ends as well.
OPEN_BYTES = 64 << 10
#: A Spark value holds no more; a longer text keeps its fingerprint and gets a status.
LARGEST_TEXT = (1 << 31) - 1 - (64 << 10)
TEXT_SUFFIXES = (".txt", ".md")


def balanced(files: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``files`` in partitions of about ``task_bytes`` each, whatever the sizes.

    Files are laid end to end and cut every ``task_bytes``: a row's place is the bytes before
    it in its partition plus those of the partitions before, and only that list of partition
    sums meets in one task."""
    weight = F.greatest(F.coalesce("size_bytes", F.lit(0)), F.lit(0)) + OPEN_BYTES

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            sums = np.cumsum(batch.column("_weight").to_numpy()) + before
            starts = np.concatenate([[before], sums[:-1]])
            before = int(sums[-1]) if len(sums) else before
            added = [pa.array(np.full(len(sums), part, dtype=np.int32)), pa.array(starts[: len(sums)])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "_part", "_before"])

    weighed = files.withColumn("_weight", weight)
    fields = [*weighed.schema, *T.StructType.fromDDL("_part int, _before long")]
    placed = materialize(weighed.mapInArrow(place, T.StructType(fields)), "placed")
    sums = placed.groupBy("_part").agg(F.sum("_weight").alias("_sum"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(sums.select("_part", "_sum", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset")), "offsets")
    total = offsets.agg(F.sum("_sum")).first()[0] or 0
    slots = placed.join(F.broadcast(offsets.drop("_sum")), "_part")  # a row per partition
    cores = max(files.sparkSession.sparkContext.defaultParallelism, 1)
    size = max(min(task_bytes, -(-total // cores)), 1)
    slot = F.floor((F.col("_offset") + F.col("_before")) / size).cast("int")
    return slots.withColumn("_slot", slot).repartitionById(total // size + 1, "_slot").select(*files.columns)


class Decoder:
    """Decodes the chunks of one file strictly; ``failed`` once the encoding does not fit or
    the text grows beyond what a value holds."""

    def __init__(self, encoding: str, largest: int):
        self.encoding, self.decoder = encoding, codecs.getincrementaldecoder(encoding)()
        self.parts: list[str] = []
        self.size, self.largest = 0, largest
        self.failed: str | None = None

    def feed(self, chunk: bytes, final: bool = False) -> None:
        if self.failed:
            return
        try:
            part = self.decoder.decode(chunk, final)
        except UnicodeDecodeError:
            self.failed, self.parts = "encoding", []
            return
        self.size += len(chunk) if self.encoding == "utf-8-sig" else len(part.encode())
        if self.size > self.largest:
            self.failed, self.parts = "oversize", []
        elif part:
            self.parts.append(part)


def read_file(opened, decode: bool, largest: int = LARGEST_TEXT) -> tuple[str, str | None, str | None]:
    """(sha256, text, failure) of a file, read chunk by chunk; ``opened`` gives it anew for
    every encoding that is tried. A NUL anywhere without a UTF-16 byte order mark is no text."""
    digest, text, failure = None, None, None
    for encoding in ("utf-8-sig", "gb18030", "utf-16") if decode else ("",):
        hashing = hashlib.sha256() if digest is None else None
        decoder = Decoder(encoding, largest) if encoding else None
        first, nul = b"", False
        with opened() as stream:
            while chunk := stream.read(CHUNK_BYTES):
                first = first or bytes(chunk[:2])
                if hashing:
                    hashing.update(chunk)
                if decoder:
                    nul = nul or (b"\x00" in chunk and first not in (b"\xff\xfe", b"\xfe\xff"))
                    if nul and not decoder.failed:
                        decoder.failed, decoder.parts = "binary", []
                    decoder.feed(chunk)
                    if decoder.failed and not hashing:
                        break
        if decoder:
            decoder.feed(b"", final=True)
            failure = "encoding" if decoder.failed == "binary" else decoder.failed
        digest = digest or hashing.hexdigest()
        if not decoder or decoder.failed != "encoding":
            text = None if not decoder or decoder.failed else "".join(decoder.parts)
            break
    return digest, text, failure


def read_documents(files: DataFrame, largest_text: int = LARGEST_TEXT, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Adds (content_sha256, text, parse_status, parse_issue) to a listing with ``path``.

    Bytes stay in the reader: every file is hashed there in chunks, only ``.txt`` and ``.md``
    files are decoded, and only their text goes on. A file that cannot be read has no
    fingerprint; failures are statuses, never errors of the job. Files are opened where
    their row lies, in tasks of about ``task_bytes``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, rows = 0, 0, []
            for at, path in enumerate(batch.column("path").to_pylist()):
                digest = text = kind = name = None
                try:
                    if path is None:
                        raise ValueError("no path")
                    suffix = os.path.splitext(path)[1].lower()
                    tree = open_file(path)
                    digest, text, kind = read_file(lambda: tree.open(path), suffix in TEXT_SUFFIXES, largest_text)
                    name = "FileTooLarge" if kind == "oversize" else None
                except PermissionError as error:
                    kind, name = "permission", type(error).__name__
                except (OSError, ValueError) as error:
                    kind, name = "damaged", type(error).__name__
                rows.append((digest, text, kind, name))
                held += len(text or "")
                if held >= BATCH_BYTES:
                    yield with_read(batch.slice(start, at + 1 - start), rows)
                    start, held, rows = at + 1, 0, []
            if rows:
                yield with_read(batch.slice(start), rows)

    added = T.StructType.fromDDL("content_sha256 string, text string, error_kind string, error_name string")
    kept = files.drop(*added.names)
    found = balanced(kept, task_bytes).mapInArrow(read, T.StructType([*kept.schema, *added]))
    return with_status(found)


def with_read(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    added = [pa.array(values, pa.string()) for values in zip(*rows)]
    names = ["content_sha256", "text", "error_kind", "error_name"]
    return pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])


@F.pandas_udf(T.StringType())
def _decode_other(contents: pd.Series) -> pd.Series:
    def decode(raw):
        for encoding in ("gb18030", "utf-16"):
            try:
                return raw.decode(encoding)
            except UnicodeDecodeError:
                continue
        return None

    return contents.map(decode, na_action="ignore")


def _bytes(hex_text: str) -> Column:
    return F.unhex(F.lit(hex_text))


def looks_binary(content: Column) -> Column:
    """A NUL anywhere without a UTF-16 byte order mark."""
    utf16 = F.startswith(content, _bytes("FFFE")) | F.startswith(content, _bytes("FEFF"))
    return F.contains(content, _bytes("00")) & ~utf16


def decode_text(content: Column) -> Column:
    """Bytes to text: UTF-8 (mark removed) in the JVM; only other bytes go to the
    Arrow UDF for GB18030 and UTF-16; null when nothing fits."""
    binary = looks_binary(content)
    raw = content.cast("string")
    utf8 = F.call_function("is_valid_utf8", raw)
    marked = F.startswith(content, _bytes("EFBBBF"))
    plain = F.when(marked, F.substring(content, 4, 2147483647).cast("string")).otherwise(raw)
    other = _decode_other(F.when(~binary & ~utf8, content))
    return F.when(binary, F.lit(None)).when(utf8, plain).otherwise(other)


def with_status(files: DataFrame) -> DataFrame:
    """Parse status and issue from the suffix, the text and the reader's failure. Other
    supported formats need their element tables (``operators.assemble``) and until then have
    the status of documents whose content was not extracted."""
    suffix = paths.suffix(paths.name_of(F.col("relative_path")))
    is_text = suffix.isin(*TEXT_SUFFIXES)
    failed = F.coalesce("error_kind", F.when(~is_text, F.lit("missing")))
    status, issue = extract_dispatch(suffix, failed, F.col("error_name"))
    return files.select(
        *[c for c in files.columns if c not in ("text", "parse_status", "parse_issue")],
        F.coalesce("text", F.lit("")).alias("text"),
        status.alias("parse_status"),
        issue.alias("parse_issue"),
    )


def read_text(files: DataFrame) -> DataFrame:
    """The same for a table that holds the bytes in ``content`` (null: not readable, see
    ``error_kind``): decoded in the JVM where they are UTF-8."""
    suffix = paths.suffix(paths.name_of(F.col("relative_path")))
    is_text = suffix.isin(*TEXT_SUFFIXES) & F.col("error_kind").isNull()
    decoded = files.withColumn("text", decode_text(F.when(is_text, F.col("content"))))
    wrong = F.when(is_text & F.col("text").isNull(), F.lit("encoding")).otherwise(F.col("error_kind"))
    return with_status(decoded.withColumn("error_kind", wrong)).drop("error_kind", "error_name")
