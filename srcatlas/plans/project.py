"""The library's front: one collection of files and all its operators, each a method that returns a DataFrame."""

from __future__ import annotations

import os
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.functions.policy import SNIFFED_BYTES, resolve_in_root, sensitive_name
from srcatlas.operators import changes as change_ops
from srcatlas.operators import edit as edit_ops
from srcatlas.operators import graph, index, reads, reports, usage
from srcatlas.operators import search as search_ops
from srcatlas.operators import symbols as symbol_ops
from srcatlas.plans.runtime import cut
from srcatlas.sources.config import load_config
from srcatlas.sources.tree import SCHEMA, is_source_file, read_file, scan, signatures
from srcatlas.streaming.watch import plan_of

BUNDLE_LIMIT, CACHED_ROOTS = 10, 16
READ_ONLY = frozenset("tree status search word read read_compact read_aggressive outline symbol deps rdeps smart tests_aware tests_aware_totals".split())


class Project:
    """Index tables of a collection, built from a files table, a folder or a saved index."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], persisted: bool = False, root: str | None = None, folder: str | None = None) -> None:
        self.spark, self.tables, self.persisted = spark, tables, persisted
        self.root, self.folder = os.path.realpath(root) if root else None, folder

    @classmethod
    def from_files(cls, files: DataFrame) -> Project:
        return cls(files.sparkSession, index.build(files))

    @classmethod
    def from_root(cls, spark: SparkSession, root: str) -> Project:
        """All eligible files of a tree, indexed; what was listed is kept, so that later changes are seen."""
        listed = cut(signatures(spark, root))
        files = index.files_from_scan(scan(spark, root))
        return cls(spark, index.build(files) | {"signatures": listed}, root=root)

    @classmethod
    def load_or_build(cls, spark: SparkSession, root: str, folder: str) -> Project:
        """The saved index if version, configuration and root match, brought up to date with the tree, else a new one, saved."""
        root = os.path.realpath(root)
        config = load_config(root).as_dict()
        tables = index.load(spark, folder, config, root)
        if tables is None:
            index.save(cls.from_root(spark, root).tables, folder, config, root)
            return cls(spark, index.load(spark, folder, config, root), persisted=True, root=root, folder=folder)
        project = cls(spark, tables, persisted=True, root=root, folder=folder)
        project.refresh()
        return project

    def save(self, folder: str, config: dict | None = None) -> Project:
        index.save(self.tables, folder, config, self.root)
        return Project(self.spark, index.load(self.spark, folder), persisted=True, root=self.root, folder=folder)

    # keeping up with the tree

    def rebuild(self) -> None:
        """Index the tree anew."""
        self._hold(Project.from_root(self.spark, self.root).tables)

    def update(self, paths: list[str]) -> None:
        """Read some paths again: changed ones are indexed anew, absent and no longer eligible ones removed. Few paths: they go through the driver."""
        config = load_config(self.root)
        found = [row for p in paths if is_source_file(self.root, p, config) and (row := read_file(self.root, p)) is not None]
        contents = self.spark.createDataFrame(found, SCHEMA)
        named = self.spark.createDataFrame([(p,) for p in paths], "path string")
        sizes = contents.select("path", "bytes", "mtime_ms", F.lit(False).alias("rule"))
        old = self.tables.get("signatures", sizes.limit(0))
        changed = index.decoded(contents)
        removed = named.join(changed, "path", "left_anti")
        tables = index.apply_changes(self.tables, changed, removed, config)
        self._hold(tables | {"signatures": old.join(F.broadcast(named), "path", "left_anti").unionByName(sizes)})

    def _hold(self, tables: dict[str, DataFrame]) -> None:
        if self.folder:
            index.save(tables, self.folder, load_config(self.root).as_dict(), self.root)
            index.drop_versions(self.spark, self.folder)
            tables = index.load(self.spark, self.folder)
        self.tables = tables

    def changed(self) -> tuple[str, list[tuple[str, str]]]:
        """What has changed in the tree since it was listed: none, targeted with the changes, or rebuild."""
        if not self.root or "signatures" not in self.tables:
            return "none", []
        found = change_ops.signature_diff(self.tables["signatures"], signatures(self.spark, self.root))
        return plan_of(found.select("path", "kind", F.lit(0).alias("at_ms")))

    def refresh(self) -> str:
        """Take the changes of the tree into the index, by an update or a rebuild; says which of none, targeted and rebuild it was."""
        plan, changes = self.changed()
        if plan == "rebuild":
            self.rebuild()
        elif plan == "targeted":
            self.update([p for p, _ in changes])
        return plan

    def edit(self, path: str, op: str, start: int, expected_hash: str, end: int | None = None, content: str = "") -> dict:
        """A guarded edit of one file of the root, which is then indexed anew and saved."""
        done = edit_ops.edit_file(self.root, path, op, start, expected_hash, end, content)
        self.update([path])
        return done

    def analyze(self, path: str) -> Project:
        """A project that also holds one file asked for by name, eligible or not, sensitive ones excepted; nothing is saved."""
        config = load_config(self.root)
        resolve_in_root(self.root, path)
        if not config.allow_sensitive and sensitive_name(path):
            raise PermissionError(f"sensitive path: {path!r}")
        row = read_file(self.root, path)
        if row is None:
            raise FileNotFoundError(path)
        contents = index.decoded(self.spark.createDataFrame([row], SCHEMA))
        tables = index.apply_changes(self.tables, contents, contents.select("path").limit(0), None)  # asked for by name: no rule of eligibility holds
        return Project(self.spark, tables, root=None)

    def tree(self, limit: int | None = None) -> DataFrame:
        return index.tree(self.tables["files"], limit)

    def status(self) -> DataFrame:
        return index.status(self.tables)

    def search(self, query: str, limit: int | None = 20, fresh: bool = True) -> DataFrame:
        """Through the trigram index if it is on disk; scanning is cheaper than building it for one query.

        A project of a root looks for changes of the tree first, unless it is told not to, and lays them over the index; `refresh` takes
        them into it.
        """
        files, trigrams = self.tables["files"], self.tables["trigrams"] if self.persisted else None
        plan, changes = self.changed() if fresh else ("none", [])
        if plan == "rebuild":
            self.rebuild()
            files, trigrams = self.tables["files"], self.tables["trigrams"] if self.persisted else None
        elif plan == "targeted":  # the changed files are read as they are; the index keeps answering for the others
            return search_ops.search(self._laid_over(changes), query, limit)
        return search_ops.search(files, query, limit, trigrams)

    def _laid_over(self, changes: list[tuple[str, str]]) -> DataFrame:
        config, files = load_config(self.root), self.tables["files"]
        files = files.where("is_utf8") if "is_utf8" in files.columns else files
        read = {p: row for p, _ in changes if is_source_file(self.root, p, config) and (row := read_file(self.root, p)) is not None and row[3] and b"\x00" not in row[4][:SNIFFED_BYTES]}
        known = {r["path"] for r in files.where(F.col("path").isin(*read)).select("path").collect()} if read else set()
        texts = [(p, row[4].decode("utf-8")) for p, row in read.items()]
        top = self.tables["files"].agg(F.max("file_id")).head()[0] or 0
        return index.overlay(files, [x for x in texts if x[0] not in known], [x for x in texts if x[0] in known], [p for p, _ in changes if p not in read], top)

    def word(self, term: str, limit: int | None = 20) -> DataFrame:
        return search_ops.word(self.tables["files"], self.tables["words"], term, limit)

    def outline(self, path: str) -> DataFrame:
        return symbol_ops.outline(self.tables["symbols"], path)

    def symbol(self, name: str, limit: int | None = 20) -> DataFrame:
        return symbol_ops.find_symbol(self.tables["symbols"], name, limit)

    def deps(self, path: str) -> DataFrame:
        return graph.deps(self.tables["imports"], path)

    def rdeps(self, path: str) -> DataFrame:
        return graph.rdeps(self.tables["edges"], self.tables["files"], path)

    def read(self, path: str, line_range: str | None = None, max_bytes: int | None = None, expected_hash: str | None = None) -> DataFrame:
        return reads.read_normal(reads.guarded(self.tables["files"], path, expected_hash), line_range, max_bytes)

    def read_compact(self, path: str, line_range: str | None = None) -> DataFrame:
        return reads.read_compact(reads.guarded(self.tables["files"], path), self.tables["symbols"], line_range)

    def read_aggressive(self, path: str, line_range: str | None = None) -> DataFrame:
        return reads.read_aggressive(reads.guarded(self.tables["files"], path), self.tables["symbols"], line_range)

    def smart(self, path: str) -> DataFrame:
        files = reads.guarded(self.tables["files"], path)
        symbols = self.tables["symbols"].where(self.tables["symbols"]["path"] == path)
        imports = self.tables["imports"].where(self.tables["imports"]["path"] == path)
        return reports.smart_reports(files, symbols, imports)

    def tests_aware(self) -> DataFrame:
        return reports.tests_aware_files(self.tables["files"])

    def tests_aware_totals(self) -> DataFrame:
        return reports.tests_aware_totals(self.tables["files"])

    @staticmethod
    def gain(events: DataFrame) -> DataFrame:
        return usage.gain(events)

    @staticmethod
    def changes(rows: DataFrame) -> DataFrame:
        return change_ops.latest(rows)

    @staticmethod
    def hot(rows: DataFrame, limit: int = 20) -> DataFrame:
        return change_ops.hot(rows, limit)

    def bundle(self, operations: list[tuple[str, dict]]) -> list[DataFrame]:
        """Up to BUNDLE_LIMIT read-only operations, checked before any is planned; bundles do not nest."""
        if len(operations) > BUNDLE_LIMIT:
            raise ValueError(f"at most {BUNDLE_LIMIT} operations")
        for name, _ in operations:
            if name not in READ_ONLY:
                raise ValueError(f"not read-only: {name}")
        return [getattr(self, name)(**arguments) for name, arguments in operations]


class Workspace:
    """Projects by root; the one used longest ago goes when there are too many. Switching to a root that fails changes nothing."""

    def __init__(self, spark: SparkSession, allowed: list[str] | None = None) -> None:
        self.spark, self.allowed = spark, allowed
        self.projects: OrderedDict[str, Project] = OrderedDict()
        self.current: str | None = None

    def switch(self, root: str) -> Project:
        if self.allowed is not None and root not in self.allowed:
            raise PermissionError(root)
        project = self.projects.get(root) or Project.from_root(self.spark, root)
        self.projects[root] = project
        self.projects.move_to_end(root)
        while len(self.projects) > CACHED_ROOTS:
            self.projects.popitem(last=False)
        self.current = root
        return project
