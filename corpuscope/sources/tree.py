"""A file tree as a Spark data source: ``spark.read.format("corpus_tree").load(root)``.

``root`` is a path that all executors mount, or the URI of a store that pyarrow opens
(``file:``, ``s3:``, ``gs:``, ``abfs:``, ``hdfs:``). Rows are the entries below it: (path,
relative_path, kind, size_bytes, modified_at, error). Ignored and linked folders are entries
but are not entered.

How a tree is split into tasks: the planner lists names breadth first, without asking for
sizes, until it knows ``planned_folders`` folders. A folder it has listed becomes ranges of
names, each about ``split_names`` long, whose bounds come from a sample, so the planner keeps
no name list; folders it has not come to are dealt to tasks that walk them. A walking task
that meets a folder with more than ``split_names`` names, or has walked ``walked_folders``
folders, hands the rest on as rows of kind 'rest' (folder, low, high) instead of doing it
alone. ``list_tree`` gives those rows to new tasks until none is left, so neither one huge
folder nor a lopsided branch stays with one task.

On a mount names come from a streaming listing and only the names of a task's own range are
asked for size and time. A store's listing brings both along; pyarrow returns it folder by
folder."""

from __future__ import annotations

import os
import random
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .. import rulepack as rp
from ..session import materialize

SCHEMA = (
    "path string, relative_path string, kind string, size_bytes long, modified_at timestamp, "
    "error string, low string, high string"
)
ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("relative_path", pa.string()),
        ("kind", pa.string()),
        ("size_bytes", pa.int64()),
        ("modified_at", pa.timestamp("us", tz="UTC")),
        ("error", pa.string()),
        ("low", pa.string()),
        ("high", pa.string()),
    ]
)
BATCH_ROWS = 10_000
SAMPLE = 1 << 15


@dataclass(frozen=True)
class Splits:
    split_names: int = 50_000
    planned_folders: int = 1_000
    folders_per_task: int = 64
    walked_folders: int = 4_096


@dataclass
class Work(InputPartition):
    """What one task lists: ranges of names of single folders, or whole branches.

    A range is (folder, low, high): low <= name < high, None for no bound."""

    ranges: tuple = ()
    branches: tuple = ()

    def __post_init__(self) -> None:
        super().__init__(None)


def ignored(name: str) -> bool:
    """The name rule of ``inventory.is_ignored`` for a folder that is being walked."""
    low = name.lower()
    junk = low in rp.JUNK_NAMES or low in rp.JUNK_DIRECTORIES
    return junk or low.startswith((".", *rp.JUNK_PREFIXES))


class Mount:
    """A tree on a file system that all executors mount."""

    def __init__(self, root: str):
        self.root = root.rstrip("/") or "/"

    def full(self, relative: str) -> str:
        return f"{self.root}/{relative}" if relative else self.root

    def names(self, folder: str) -> Iterator[tuple[str, str, os.DirEntry]]:
        with os.scandir(self.full(folder)) as entries:
            for entry in entries:
                kind = "dir" if entry.is_dir() else "file"
                yield entry.name, f"{kind}link" if entry.is_symlink() else kind, entry

    @staticmethod
    def facts(entry: os.DirEntry) -> tuple[int, datetime]:
        stat = entry.stat(follow_symlinks=False)
        return stat.st_size, datetime.fromtimestamp(int(stat.st_mtime), timezone.utc)

    @staticmethod
    def open(path: str):
        return open(path, "rb")

    def check(self) -> None:
        if not os.path.exists(self.root):
            raise FileNotFoundError(self.root)
        if not os.path.isdir(self.root):
            raise NotADirectoryError(self.root)


class Store:
    """A tree in a store that pyarrow opens."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.selector, self.folder_type = fs.FileSelector, fs.FileType.Directory
        self.fs, self.base = fs.FileSystem.from_uri(root)
        self.base = self.base.rstrip("/")
        self.root = root.rstrip("/")
        self.prefix = self.root.removesuffix(self.base)

    def full(self, relative: str) -> str:
        return f"{self.root}/{relative}" if relative else self.root

    def names(self, folder: str) -> Iterator[tuple[str, str, object]]:
        for info in self.fs.get_file_info(self.selector(f"{self.base}/{folder}".rstrip("/"))):
            yield info.base_name, "dir" if info.type == self.folder_type else "file", info

    @staticmethod
    def facts(info) -> tuple[int, datetime | None]:
        when = info.mtime
        return info.size, when and when.replace(microsecond=0)

    def open(self, path: str):
        return self.fs.open_input_stream(path.removeprefix(self.prefix))

    def check(self) -> None:
        kind = self.fs.get_file_info(self.base).type
        if kind.name == "NotFound":
            raise FileNotFoundError(self.root)
        if kind != self.folder_type:
            raise NotADirectoryError(self.root)


def open_root(root: str) -> Mount | Store:
    if "://" not in root and not root.startswith("file:"):
        return Mount(root)
    if root.startswith("file:"):
        from pyarrow import fs

        return Mount(fs.FileSystem.from_uri(root if root.startswith("file://") else "file://" + root[5:])[1])
    return Store(root)


def open_file(path: str) -> Mount | Store:
    """The tree that opens a file by the path of its entry."""
    if "://" not in path:
        return Mount("")
    root = "/".join(path.split("/", 3)[:3])
    if root not in _stores:
        _stores[root] = Store(path)
    return _stores[root]


_stores: dict[str, Store] = {}


def joined(folder: str, name: str) -> str:
    return f"{folder}/{name}" if folder else name


def bounds_of(sample: list[str], names: int, split_names: int) -> list[tuple[str | None, str | None]]:
    """Ranges of about ``split_names`` names of a folder of ``names``, from a sample."""
    count = -(-names // split_names)
    ordered = sorted(set(sample))
    cuts = sorted({ordered[len(ordered) * i // count] for i in range(1, count)}) if ordered else []
    return list(zip([None, *cuts], [*cuts, None]))


class Sample:
    """Every name counted, ``SAMPLE`` of them kept, each with the same chance."""

    def __init__(self) -> None:
        self.count, self.kept, self.random = 0, [], random.Random(0)

    def add(self, name: str) -> None:
        self.count += 1
        if len(self.kept) < SAMPLE:
            self.kept.append(name)
        elif (place := self.random.randrange(self.count)) < SAMPLE:
            self.kept[place] = name


class Walker:
    """Lists ``Work``; rows are tuples in the order of ``ARROW``."""

    def __init__(self, root: str, splits: Splits):
        self.tree, self.splits = open_root(root), splits

    def _entry(self, folder: str, name: str, kind: str, entry) -> tuple:
        relative = joined(folder, name)
        path = self.tree.full(relative)
        try:
            size, when = self.tree.facts(entry) if kind == "file" else (0, None)
        except OSError as error:
            return path, relative, "error", 0, None, f"{path}: {error}", None, None
        return path, relative, kind, size, when, None, None, None

    def _failed(self, folder: str, error: OSError) -> tuple:
        path = self.tree.full(folder)
        return path, folder, "error", 0, None, f"{path}: {error}", None, None

    def _rest(self, folder: str, low: str | None, high: str | None) -> tuple:
        return self.tree.full(folder), folder, "rest", 0, None, None, low, high

    def in_range(self, folder: str, low: str | None, high: str | None) -> Iterator[tuple]:
        """The entries of a folder whose names lie in a range; its folders are not entered."""
        try:
            for name, kind, entry in self.tree.names(folder):
                if (low is None or name >= low) and (high is None or name < high):
                    yield self._entry(folder, name, kind, entry)
        except OSError as error:
            yield self._failed(folder, error)

    def branch(self, folders: Iterable[str]) -> Iterator[tuple]:
        """Everything below ``folders``, or what is to be handed on."""
        stack, walked = list(folders), 0
        while stack:
            if walked >= self.splits.walked_folders:
                yield from (self._rest(folder, "", None) for folder in stack)
                return
            folder = stack.pop()
            walked += 1
            held, sample = [], Sample()
            try:
                for name, kind, entry in self.tree.names(folder):
                    sample.add(name)
                    if kind == "dir" and not ignored(name):
                        stack.append(joined(folder, name))
                    if sample.count <= self.splits.split_names:
                        held.append((name, kind, entry))
            except OSError as error:
                yield self._failed(folder, error)
            if sample.count > self.splits.split_names:
                for low, high in bounds_of(sample.kept, sample.count, self.splits.split_names):
                    yield self._rest(folder, low, high)
            else:
                yield from (self._entry(folder, *name) for name in held)

    def run(self, work: Work) -> Iterator[pa.RecordBatch]:
        rows = []
        for part in (*(self.in_range(*r) for r in work.ranges), self.branch(work.branches)):
            for row in part:
                rows.append(row)
                if len(rows) == BATCH_ROWS:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    def plan(self) -> list[Work]:
        """Tasks for the whole tree, from names alone and without keeping them."""
        waiting, listed = [""], []
        while waiting and len(listed) < self.splits.planned_folders:
            folder, sample = waiting.pop(0), Sample()
            try:
                for name, kind, _ in self.tree.names(folder):
                    sample.add(name)
                    if kind == "dir" and not ignored(name):
                        waiting.append(joined(folder, name))
            except OSError:
                pass  # the task that lists the folder reports it
            bounds = bounds_of(sample.kept, sample.count, self.splits.split_names)
            listed += [(min(sample.count, self.splits.split_names), (folder, *b)) for b in bounds or [(None, None)]]
        tasks, held, names = [], [], 0
        for count, part in listed:
            if held and (names + count > self.splits.split_names or len(held) == self.splits.folders_per_task):
                tasks.append(Work(ranges=tuple(held)))
                held, names = [], 0
            held.append(part)
            names += count
        tasks.append(Work(ranges=tuple(held)))
        step = self.splits.folders_per_task
        return tasks + [Work(branches=tuple(waiting[i : i + step])) for i in range(0, len(waiting), step)]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array(values, field.type) for values, field in zip(zip(*rows), ARROW)]
    return pa.RecordBatch.from_arrays(arrays, schema=ARROW)


class TreeReader(DataSourceReader):
    def __init__(self, root: str, splits: Splits):
        self.root, self.splits = root, splits

    def partitions(self) -> list[Work]:
        return Walker(self.root, self.splits).plan()

    def read(self, partition: Work) -> Iterator[pa.RecordBatch]:
        return Walker(self.root, self.splits).run(partition)


class TreeSource(DataSource):
    """Options: path (or load's argument) and, by name, any field of ``Splits``."""

    @classmethod
    def name(cls) -> str:
        return "corpus_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        given = {k: int(self.options[k]) for k in vars(Splits()) if k in self.options}
        return TreeReader(self.options["path"], replace(Splits(), **given))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)


def list_folders(folders: DataFrame, root: str, splits: Splits = Splits()) -> DataFrame:
    """The entries of (relative_path, low, high): name ranges of folders of the tree, or,
    where low is the empty string, whole branches."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker(root, splits)
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("relative_path", "low", "high"))))
            ranges = tuple(r for r in rows if r[1] != "")
            yield from walker.run(Work(ranges, tuple(r[0] for r in rows if r[1] == "")))

    return folders.select("relative_path", "low", "high").mapInArrow(walk, SCHEMA)


def list_tree(spark: SparkSession, root: str, splits: Splits = Splits()) -> DataFrame:
    """Every entry below ``root``; what a task hands on goes to new tasks until none is left."""
    register(spark)
    options = {k: str(v) for k, v in vars(splits).items()}
    found, level = None, spark.read.format("corpus_tree").options(**options).load(root)
    while True:
        level = materialize(level, "listing")
        found = level if found is None else found.unionByName(level)
        rest = level.filter(F.col("kind") == "rest")
        count = rest.count()
        if not count:
            return found.filter(F.col("kind") != "rest").drop("low", "high")
        # Ranges are even, so each is a task of its own as far as the cluster has cores.
        width = min(count, 16 * max(spark.sparkContext.defaultParallelism, 1))
        level = list_folders(rest.repartition(width), root, splits)
