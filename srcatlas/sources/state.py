"""The usage log and the state of watched changes, as files of JSON lines."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.operators.edit import write_atomically

USAGE_SCHEMA = (
    "v int, ts string, session string, session_source string, cmd string, mode string, file string, level string, parser string, fallback boolean, savings_source string, "
    "bytes_raw bigint, bytes_out bigint, tokens_raw_est bigint, tokens_out_est bigint, tokens_saved_est bigint"
)
REQUIRED = ("bytes_raw", "bytes_out", "tokens_raw_est", "tokens_out_est", "tokens_saved_est")
CHANGES_SCHEMA = "sequence bigint, updated_at_ms bigint, changes array<struct<path: string, kind: string>>"


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """The usage events of a log; blank and malformed lines and rows without one of the five numbers are passed over."""
    return spark.read.schema(USAGE_SCHEMA).option("mode", "DROPMALFORMED").json(path).dropna(subset=list(REQUIRED))


def append_usage(events: DataFrame, folder: str) -> bool:
    """Append events; a log that cannot be written never fails the caller."""
    try:
        events.write.mode("append").json(folder)
        return True
    except Exception:  # noqa: BLE001
        return False


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """(sequence, updated_at_ms, path, kind) of the state file; empty if there is none, an error if it is broken."""
    flat = "sequence bigint, updated_at_ms bigint, path string, kind string"
    if not os.path.exists(path):
        return spark.createDataFrame([], flat)
    with open(path, encoding="utf-8") as f:
        state = json.load(f)
    return spark.createDataFrame([(state["sequence"], state["updated_at_ms"], c["path"], c["kind"]) for c in state["changes"]], flat)


def write_changes(path: str, batch: list[tuple[str, str]], at_ms: int) -> int:
    """Replace the state by the newest batch with the next sequence number, which is returned."""
    try:
        with open(path, encoding="utf-8") as f:
            sequence = json.load(f)["sequence"] + 1
    except (FileNotFoundError, ValueError, KeyError):
        sequence = 1
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    write_atomically(path, json.dumps({"sequence": sequence, "updated_at_ms": at_ms, "changes": [{"path": p, "kind": k} for p, k in batch]}).encode())
    return sequence


def flat_changes(df: DataFrame) -> DataFrame:
    return df.select("sequence", "updated_at_ms", F.explode("changes").alias("c")).select("sequence", "updated_at_ms", "c.path", "c.kind")
