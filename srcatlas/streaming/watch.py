"""Watching: change feeds through Structured Streaming, merged into the index tables batch by batch."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from srcatlas.functions.policy import in_generated_dir
from srcatlas.operators.changes import signature_diff
from srcatlas.sources.tree import RULE_FILES, register, signatures

#: Up to so many paths are refreshed one by one; more differences rebuild the index. Fixed values.
TARGETED_PATHS, MAX_EVENTS = 32, 4096
LEAST_INTERVAL_MS = 100


def change_stream(spark: SparkSession, root: str, state: str, **options: object) -> DataFrame:
    """(path, kind, at_ms) of changes below a root, as they are seen; `state` is a folder for the stream's signatures."""
    register(spark)
    reader = spark.readStream.format("srcatlas_changes").option("root", root).option("state", state)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load().where(~in_generated_dir(F.col("path")))


def plan_of(batch: DataFrame) -> tuple[str, list[tuple[str, str]]]:
    """What a batch asks for: rebuild (a rule file changed, or too many paths), targeted with its changes, or none. Reads at most MAX_EVENTS + 1 rows."""
    latest = batch.groupBy("path").agg(F.max_by("kind", "at_ms").alias("kind")).orderBy("path").limit(MAX_EVENTS + 1).collect()
    changes = [(r["path"], r["kind"]) for r in latest]
    if not changes:
        return "none", changes
    if any(p.rsplit("/", 1)[-1] in RULE_FILES for p, _ in changes) or len(changes) > TARGETED_PATHS:
        return "rebuild", changes
    return "targeted", changes


class SignatureTable:
    """The signatures of a tree as one table per batch in a folder; the changes of a batch are the difference of two of them.

    A batch that is run again after a failure finds its own table and gives the same changes; older tables are dropped.
    """

    def __init__(self, spark: SparkSession, root: str, folder: str, **options: object) -> None:
        self.spark, self.root, self.folder, self.options = spark, root, folder, options

    def _hadoop(self, name: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _written(self, version: int) -> bool:
        fs, path = self._hadoop(f"v{version}/_SUCCESS")
        return fs.exists(path)

    def _table(self, version: int) -> DataFrame:
        if self._written(version):
            return self.spark.read.parquet(f"{self.folder}/v{version}")
        return self.spark.createDataFrame([], "path string, bytes bigint, mtime_ms bigint")

    def seed(self, table: DataFrame) -> None:
        """What was indexed before the first batch."""
        if not self._written(0):
            table.select("path", "bytes", "mtime_ms").write.mode("overwrite").parquet(f"{self.folder}/v0")

    def changes(self, batch_id: int) -> DataFrame:
        """(path, kind) between the batch before and this one, whose table is written first if it is not there."""
        now = batch_id + 1
        if not self._written(now):
            signatures(self.spark, self.root, **self.options).select("path", "bytes", "mtime_ms").write.mode("overwrite").parquet(f"{self.folder}/v{now}")
        fs, old = self._hadoop(f"v{now - 2}")
        fs.delete(old, True)
        return signature_diff(self._table(now - 1), self._table(now))


def watch(
    spark: SparkSession, root: str, apply: Callable[[str, list[tuple[str, str]], int], None], checkpoint: str, interval_ms: int = 1000, seed: DataFrame | None = None, **options: object
) -> StreamingQuery:
    """Start watching: `apply(plan, changes, sequence)` is called once per batch with changes; a batch that failed is retried as a rebuild.

    The tree is listed by tasks once per interval. The signatures lie beside the checkpoint, so that a watch started again on the same
    checkpoint sees what has changed meanwhile; `seed` (path, bytes, mtime_ms) is what is known before the first batch.
    """
    table = SignatureTable(spark, root, f"{checkpoint}/signatures", **options)
    if seed is not None:
        table.seed(seed)

    def each(_: DataFrame, batch_id: int) -> None:
        found = table.changes(batch_id).select("path", "kind", F.lit(0).alias("at_ms"))
        plan, changes = plan_of(found)
        if plan == "none":
            return
        try:
            apply(plan, changes, batch_id + 1)
        except Exception:  # noqa: BLE001
            if plan == "rebuild":
                raise
            apply("rebuild", changes, batch_id + 1)

    # the rows of the clock do not matter and are never computed
    clock = spark.readStream.format("rate").option("rowsPerSecond", 10).load()
    return clock.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/clock").trigger(processingTime=f"{max(LEAST_INTERVAL_MS, interval_ms)} milliseconds").start()


def index_watch(spark: SparkSession, root: str, folder: str, checkpoint: str, interval_ms: int = 1000) -> StreamingQuery:
    """Keep the saved index of a root fresh: each batch with changes is applied, saved, and written to the root's state of changes."""
    import time

    from srcatlas.operators.edit import STATE_DIR
    from srcatlas.plans.project import Project
    from srcatlas.sources.state import write_changes

    project = Project.load_or_build(spark, root, folder)

    def apply(plan: str, changes: list[tuple[str, str]], _: int) -> None:
        if plan == "rebuild":
            project.rebuild()
        else:
            project.update([p for p, _ in changes])
        write_changes(os.path.join(root, STATE_DIR, "changes.json"), changes, int(time.time() * 1000))

    return watch(spark, root, apply, checkpoint, interval_ms, seed=project.tables["signatures"])


def merge_stream(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Drain a stream of table rows through `merge(batch, batch_id)`, then stop: what was there when it began is processed exactly once."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
