"""The usage log and what reading less has saved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.text import estimate_tokens

COUNTERS = ("bytes_raw", "bytes_out", "tokens_raw_est", "tokens_out_est", "tokens_saved_est")


def savings_source(level: Column, has_range: Column, has_cap: Column) -> Column:
    return (
        F.when(level == "compact", "compact").when(level == "aggressive", "aggressive")
        .when(has_range & has_cap, "line_range_and_byte_cap").when(has_range, "line_range").when(has_cap, "byte_cap").otherwise("full_read")
    )


def with_estimates(events: DataFrame) -> DataFrame:
    """Token estimates from bytes_raw and bytes_out; what is saved is never negative."""
    raw, out = estimate_tokens(F.col("bytes_raw")), estimate_tokens(F.col("bytes_out"))
    return events.withColumns({"tokens_raw_est": raw, "tokens_out_est": out, "tokens_saved_est": F.greatest(F.lit(0).cast("bigint"), raw - out)})


def _buckets(events: DataFrame) -> DataFrame:
    blank = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "unknown").otherwise(c)
    return events.select(
        blank(F.col("mode")).alias("mode"),
        F.when(F.col("level") == "normal", F.concat(F.lit("normal_"), F.coalesce("savings_source", F.lit("read")))).otherwise(F.col("level")).alias("level"),
        F.coalesce("parser", F.when(F.col("fallback"), "fallback").otherwise("not_applicable")).alias("parser"),
        F.coalesce("savings_source", F.lit("unknown")).alias("savings_source"),
        *[F.col(c).cast("bigint").alias(c) for c in COUNTERS],
    )


def gain(events: DataFrame) -> DataFrame:
    """(dimension, bucket, events, five sums, ratio) in one pass over the log: total, mode, level, parser and savings_source.

    A null level is in no level bucket; the ratio is saved to raw tokens of the sums, 0 if there are none.
    """
    sets = [["mode"], ["level"], ["parser"], ["savings_source"], []]
    keys = ["mode", "level", "parser", "savings_source"]
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTERS]
    grouped = _buckets(events).groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(F.grouping_id(*keys).alias("g"), F.count(F.lit(1)).alias("events"), *sums)
    # grouping_id has a bit for each key that is not grouped by
    dimension = F.when(F.col("g") == 7, "mode").when(F.col("g") == 11, "level").when(F.col("g") == 13, "parser").when(F.col("g") == 14, "savings_source").otherwise("total")
    bucket = F.when(F.col("g") == 7, F.col("mode")).when(F.col("g") == 11, F.col("level")).when(F.col("g") == 13, F.col("parser")).when(F.col("g") == 14, F.col("savings_source")).otherwise("total")
    rows = grouped.select(dimension.alias("dimension"), bucket.alias("bucket"), "events", *COUNTERS).where(F.col("bucket").isNotNull())
    # an empty log still has a total, of zeros
    none = events.sparkSession.range(1).select(F.lit("total").alias("dimension"), F.lit("total").alias("bucket"), *[F.lit(0).cast("bigint").alias(c) for c in ("events", *COUNTERS)])
    summed = rows.unionByName(none).groupBy("dimension", "bucket").agg(*[F.sum(c).alias(c) for c in ("events", *COUNTERS)])
    ratio = F.when(F.col("tokens_raw_est") == 0, 0.0).otherwise(F.col("tokens_saved_est") / F.col("tokens_raw_est"))
    return summed.withColumn("ratio", ratio)
