"""Changes between consecutive full snapshots (problem 6).

Every delivered row is tagged twice, as the state after its own snapshot and as the state before the next delivered one; one
aggregation by (repo, snapshot, path) keeps per side the row ingested last and classifies from the two sides' row hashes. What is
shuffled is the key and four numbers a row, whatever the rows hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.functions.paths import canonical_path
from srcatlas.plans.runtime import salted_join

#: Instants below this are seconds, others milliseconds (year 5138 in seconds, 1973 in milliseconds).
SECONDS_BELOW = 100_000_000_000


def snapshot_steps(rows: DataFrame) -> DataFrame:
    """Per repo the delivered snapshot numbers with the ones before and after; numbers never delivered do not appear."""
    w = Window.partitionBy("repo").orderBy("snapshot_no")
    return (
        rows.where(F.col("repo").isNotNull() & F.col("snapshot_no").isNotNull())
        .groupBy("repo", "snapshot_no")
        .agg(F.min("taken_at").alias("taken_at"))
        .select("repo", "snapshot_no", "taken_at", F.lag("snapshot_no").over(w).alias("before_no"), F.lead("snapshot_no").over(w).alias("next_no"))
    )


def snapshot_changes(rows: DataFrame) -> DataFrame:
    """(repo, snapshot_no, path, change), change being create, remove, modify or touch.

    Rows without repo, snapshot number or path do not count. Rows that differ only in the spelling of the path are one; of
    several rows of one path in a snapshot the one ingested last holds (ties: the greatest first 15 hexadecimal digits of the hash,
    then the greatest 64-bit hash of the whole, then mtime). A null hash equals any hash, a null mtime any mtime. The first snapshot of a repo has no changes. Empty input gives an empty result; other
    columns are ignored.
    """
    steps = snapshot_steps(rows)
    mtime = F.when(F.abs("mtime_ms") < SECONDS_BELOW, F.col("mtime_ms")).otherwise(F.floor(F.col("mtime_ms") / 1000)).cast("bigint")
    # the row's hash, null for a null one, and what orders it among rows ingested at the same instant
    low = F.lower("hash")
    head = F.conv(F.substring(low, 1, 15), 16, 10).cast("bigint")
    facts = rows.select(
        "repo", "snapshot_no", canonical_path(F.col("path")).alias("path"), F.struct("ingested_at", head.alias("head"), F.when(low.isNotNull(), F.xxhash64(low)).alias("hash"), mtime.alias("mtime")).alias("state")
    ).where(F.col("path").isNotNull())
    # one row per snapshot; a project with a large part of all rows is salted where these are many
    tagged = (
        salted_join(facts, steps.select("repo", "snapshot_no", "before_no", "next_no"), ["repo", "snapshot_no"], "path")
        .select(
            "repo", "path", "state",
            F.explode(F.array(
                F.struct(F.when(F.col("before_no").isNotNull(), F.col("snapshot_no")).alias("step"), F.lit(True).alias("after")),
                F.struct(F.col("next_no").alias("step"), F.lit(False).alias("after")),
            )).alias("side"),
        )
        .where(F.col("side.step").isNotNull())
    )
    sides = tagged.groupBy("repo", F.col("side.step").alias("snapshot_no"), "path").agg(
        F.max(F.when(F.col("side.after"), F.col("state"))).alias("a"), F.max(F.when(~F.col("side.after"), F.col("state"))).alias("b")
    )
    change = (
        F.when(F.col("b").isNull(), "create")
        .when(F.col("a").isNull(), "remove")
        .when(F.col("a.hash") != F.col("b.hash"), "modify")
        .when(F.col("a.mtime") != F.col("b.mtime"), "touch")
    )
    return sides.select("repo", "snapshot_no", "path", change.alias("change")).where(F.col("change").isNotNull())


def snapshot_change_counts(rows: DataFrame) -> DataFrame:
    """(repo, snapshot_no, change, n): the changes counted per step."""
    return snapshot_changes(rows).groupBy("repo", "snapshot_no", "change").agg(F.count(F.lit(1)).alias("n"))
