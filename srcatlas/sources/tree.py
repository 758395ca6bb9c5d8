"""The tree scan: a listing as a Python data source (`spark.read.format("srcatlas_tree").option("root", ...)`), contents read beside it.

The driver opens folders, broadest first, only until there are enough of them to deal out; executors walk what lies below. The listing
(paths, sizes, times) is then dealt out anew, so that a folder of any size is read by all tasks alike. The root must be on storage
that all executors see. Links are not followed; ignore rules, hidden, generated and sensitive names and the size cap apply.
"""

from __future__ import annotations

import json
import os
import time
from collections import deque
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from srcatlas.functions.policy import generated_name, hidden_name, sensitive_name
from srcatlas.plans.runtime import shuffle_partitions
from srcatlas.sources.config import CONFIG_NAME, Config, load_config
from srcatlas.sources.ignore import Stack

SCHEMA = "path string, bytes bigint, mtime_ms bigint, is_utf8 boolean, content binary"
SIGNATURE = "path string, bytes bigint, mtime_ms bigint, rule boolean"
#: Files whose change may make other files eligible or not.
RULE_FILES = (".gitignore", ".ignore", CONFIG_NAME)
#: Folders that the driver opens before the rest is left to the executors.
OPENED = 1024
#: Bytes of contents that one batch of a scan holds before it is handed on.
BATCH_BYTES = 16 << 20


def _config(options: dict, root: str) -> Config:
    base = load_config(root)
    flag = lambda k, d: str(options.get(k, d)).lower() == "true"
    return Config(int(options.get("max_file_size", base.max_file_size)), flag("allow_sensitive", base.allow_sensitive), flag("include_hidden", base.include_hidden))


def _passes(relative: str, config: Config) -> bool:
    return not generated_name(relative) and (config.include_hidden or not hidden_name(relative)) and (config.allow_sensitive or not sensitive_name(relative))


def _entries(folder: str) -> list[os.DirEntry]:
    """What a folder holds, in order of names; nothing if it has gone meanwhile."""
    try:
        return sorted(os.scandir(folder), key=lambda e: e.name)
    except FileNotFoundError:
        return []


def inner_folders(root: str, relative: str, config: Config, rules: Stack) -> Iterator[tuple[str, Stack]]:
    """The folders in a folder that a scan enters, each with the rules that hold in it."""
    for entry in _entries(os.path.join(root, relative)):
        inner = f"{relative}/{entry.name}".lstrip("/")
        if entry.is_dir(follow_symlinks=False) and _passes(inner, config) and not rules.ignored(entry.path, True):
            yield inner, rules.below(entry.path)


def folders_of(root: str, config: Config, start: str = "") -> Iterator[tuple[str, Stack]]:
    """Folders to scan from one on, relative to the root ('' for itself), with their rules; ignored ones are not entered."""
    todo = [(start, rules_at(root, start))]
    while todo:
        relative, rules = todo.pop()
        yield relative, rules
        todo += reversed(list(inner_folders(root, relative, config, rules)))


def rules_at(root: str, relative: str) -> Stack:
    """The rules that hold in a folder: those of its ancestor chain."""
    stack, at = Stack.for_root(root), root
    for part in filter(None, relative.split("/")):
        at = os.path.join(at, part)
        stack = stack.below(at)
    return stack


def is_source_file(root: str, relative: str, config: Config | None = None) -> bool:
    """Whether one path is eligible, by the same rules as a scan, looking only at its ancestors."""
    config = config or load_config(root)
    full = os.path.join(root, *relative.split("/"))
    if os.path.islink(full) or not os.path.isfile(full) or not _passes(relative, config):
        return False
    at, stack = root, Stack.for_root(root)
    parts = relative.split("/")
    for part in parts[:-1]:
        at = os.path.join(at, part)
        if os.path.islink(at) or stack.ignored(at, True):
            return False
        stack = stack.below(at)
    if stack.ignored(full, False):
        return False
    try:
        return os.stat(full).st_size <= config.max_file_size
    except OSError:
        return True


def files_in(root: str, relative: str, config: Config, rules: Stack) -> Iterator[tuple[str, int, int, bool]]:
    """(path, bytes, mtime_ms, rule) of a folder's eligible files and of its rule files, eligible or not (rule true)."""
    for entry in _entries(os.path.join(root, relative)):
        inner = f"{relative}/{entry.name}".lstrip("/")
        if entry.is_symlink() or not entry.is_file(follow_symlinks=False):
            continue
        rule = entry.name in RULE_FILES
        try:
            stat = entry.stat(follow_symlinks=False)
        except OSError:
            continue
        source = _passes(inner, config) and stat.st_size <= config.max_file_size and not rules.ignored(entry.path, False)
        if source or rule:
            yield inner, stat.st_size, stat.st_mtime_ns // 1_000_000, not source


class _Folders(InputPartition):
    def __init__(self, folders: list[tuple[str, bool]]) -> None:
        super().__init__(0)
        self.folders = folders


class TreeReader(DataSourceReader):
    """The listing. A partition holds opened folders, of which only the files count, and unopened ones, which it walks."""

    def __init__(self, options: dict) -> None:
        self.root = os.path.realpath(options["root"])
        if not os.path.isdir(self.root):
            raise ValueError(f"no folder: {self.root}")
        self.config = _config(options, self.root)
        self.per_task = int(options.get("folders_per_task", 64))
        self.opened = int(options.get("opened", OPENED))

    def partitions(self) -> list[InputPartition]:
        opened, todo = [], deque([("", rules_at(self.root, ""))])
        while todo and len(opened) < self.opened:
            relative, rules = todo.popleft()
            opened.append((relative, False))
            todo += inner_folders(self.root, relative, self.config, rules)
        dealt = [_Folders(opened[i : i + self.per_task]) for i in range(0, len(opened), self.per_task)]
        return dealt + [_Folders([(relative, True)]) for relative, _ in todo]

    def read(self, partition: _Folders) -> Iterator[tuple]:
        for start, below in partition.folders:
            walk = folders_of(self.root, self.config, start) if below else [(start, rules_at(self.root, start))]
            for folder, rules in walk:
                yield from files_in(self.root, folder, self.config, rules)


class SignatureStream(SimpleDataSourceStreamReader):
    """Polls a tree: each batch holds the changes (path, kind) since the one before.

    The offset is the version of the signatures, which lie in the folder `state` as one file per version: a restarted stream goes on
    where it stopped, a batch read again is the same, and versions before the committed one are removed. For trees that one
    machine can list; `streaming.watch` lists by tasks.
    """

    def __init__(self, options: dict) -> None:
        self.root = os.path.realpath(options["root"])
        self.config = _config(options, self.root)
        if "state" not in options:
            raise ValueError("the option `state` names a folder for the stream's signatures")
        self.state = str(options["state"]).removeprefix("file://").removeprefix("file:")

    def initialOffset(self) -> dict:
        return {"version": 0}

    def _file(self, version: int) -> str:
        return os.path.join(self.state, f"{version}.json")

    def _held(self, version: int) -> dict:
        if not version:
            return {"at": 0, "files": {}}
        with open(self._file(version), encoding="utf-8") as f:
            return json.load(f)

    def _changes(self, before: dict, now: dict) -> list[tuple[str, str, int]]:
        a, b = before["files"], now["files"]
        kinds = {p: "create" if p not in a else "remove" if p not in b else "modify" for p in a.keys() | b.keys() if a.get(p) != b.get(p)}
        return [(p, kinds[p], now["at"]) for p in sorted(kinds)]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        before, version = self._held(start["version"]), start["version"] + 1
        files = {p: [n, t] for folder, rules in folders_of(self.root, self.config) for p, n, t, _ in files_in(self.root, folder, self.config, rules)}
        now = {"at": int(time.time() * 1000), "files": files}
        found = self._changes(before, now)
        if not found:
            return iter([]), start
        os.makedirs(self.state, exist_ok=True)
        with open(self._file(version) + ".tmp", "w", encoding="utf-8") as f:
            json.dump(now, f)
        os.replace(self._file(version) + ".tmp", self._file(version))
        return iter(found), {"version": version}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        before, found = self._held(start["version"]), []
        for version in range(start["version"] + 1, end["version"] + 1):
            now = self._held(version)
            found += self._changes(before, now)
            before = now
        return iter(found)

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.state) if os.path.isdir(self.state) else []:
            if name.removesuffix(".json").isdigit() and int(name.removesuffix(".json")) < end["version"]:
                os.unlink(os.path.join(self.state, name))


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "srcatlas_tree"

    def schema(self) -> str:
        return SIGNATURE

    def reader(self, schema: object) -> TreeReader:
        return TreeReader(self.options)


class ChangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "srcatlas_changes"

    def schema(self) -> str:
        return "path string, kind string, at_ms bigint"

    def simpleStreamReader(self, schema: object) -> SignatureStream:
        return SignatureStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)
    spark.dataSource.register(ChangeSource)


def signatures(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """(path, bytes, mtime_ms, rule) of all eligible files of a tree, and of its rule files (rule true where not eligible)."""
    register(spark)
    reader = spark.read.format("srcatlas_tree").option("root", root)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def read_file(root: str, relative: str) -> tuple | None:
    """(path, bytes, mtime_ms, is_utf8, content) of one file, None if it has gone."""
    full = os.path.join(root, *relative.split("/"))
    try:
        with open(full, "rb") as f:
            content = f.read()
            mtime = os.fstat(f.fileno()).st_mtime_ns // 1_000_000
    except OSError:
        return None
    try:
        content.decode("utf-8")
        valid = True
    except UnicodeDecodeError:
        valid = False
    return relative, len(content), mtime, valid, content


def _contents(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    names, types = ["path", "bytes", "mtime_ms", "is_utf8", "content"], [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    rows: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        for path in batch.column(0).to_pylist():
            row = read_file(root, path)
            if row is not None:
                rows.append(row)
                size += row[1]
            if size >= BATCH_BYTES:
                yield flush()
                rows, size = [], 0
    if rows:
        yield flush()


def scan(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """(path, bytes, mtime_ms, is_utf8, content) of all eligible files of a tree."""
    listed = signatures(spark, root, **options).where("not rule").select("path")
    tasks = max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)
    return listed.repartition(tasks, F.xxhash64("path")).mapInArrow(partial(_contents, root=os.path.realpath(root)), SCHEMA)
