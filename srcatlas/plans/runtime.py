"""Session-level helpers shared by all operators: reading, sizing, checkpoints, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side may be broadcast once it has been measured.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, at_least: int | None = None) -> DataFrame:
    """Give per-row work enough tasks: a small table in few files is dealt out round robin, one of many files or splits is left alone."""
    spark = df.sparkSession
    want = at_least or spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= want * split or len(df.inputFiles()) >= want:
        return df
    return df.repartition(max(want, shuffle_partitions(spark)))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; one of our own only where none is set, as in tests."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "srcatlas-checkpoints")
    spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table into the shared checkpoint folder and read it from there, so that lost executors cost no recomputation.

    Each row is computed once, where a checkpoint of the rows would compute them for a count and again for writing. The table goes
    when the driver's process ends.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def _width(df: DataFrame) -> Column:
    """Bytes a row takes, the lengths of its texts and arrays counted, 8 for anything else."""
    width = F.lit(0)
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        part = F.octet_length(F.col(f"`{f.name}`")) if kind in ("string", "binary") else F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))) if kind in ("array", "struct", "map") else F.lit(8)
        width = width + F.coalesce(part, F.lit(0)) + 8
    return width


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows and bytes; no more than rows + 1 of its rows are measured."""
    n, total = df.limit(rows + 1).select(_width(df).alias("w")).agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).head()
    return n <= rows and total <= size


def checked_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast df only if it was measured to be small in rows and bytes; else leave the join to Catalyst."""
    return F.broadcast(df) if fits(df) else df


def salted_join(rows: DataFrame, unique: DataFrame, keys: list[str], salt_by: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """Join rows, of which one key may hold a large part, with at most one row per key: broadcast if measured small, else salted."""
    if fits(unique):
        return rows.join(F.broadcast(unique), keys, how)
    copies = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")).join(copies, [*keys, "_salt"], how).drop("_salt")
