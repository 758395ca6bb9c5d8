"""Differences between signatures of a tree, and the latest batch of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signature_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, kind) from two (path, bytes, mtime_ms): create, remove or modify."""
    a, b = before.select("path", F.struct("bytes", "mtime_ms").alias("was")), after.select("path", F.struct("bytes", "mtime_ms").alias("now"))
    kind = F.when(F.col("was").isNull(), "create").when(F.col("now").isNull(), "remove").when(~F.col("was").eqNullSafe(F.col("now")), "modify")
    return a.join(b, "path", "full_outer").select("path", kind.alias("kind")).where(F.col("kind").isNotNull())


def latest(changes: DataFrame) -> DataFrame:
    """The newest batch of (sequence, updated_at_ms, path, kind)."""
    top = changes.agg(F.max("sequence").alias("top"))
    return changes.join(F.broadcast(top), changes["sequence"] == top["top"]).drop("top")  # one row


def hot(changes: DataFrame, limit: int = 20) -> DataFrame:
    """The first paths of the newest batch."""
    return latest(changes).select("path").distinct().orderBy("path").limit(limit)
