"""References to records that do not exist (problem 2).

Keys are 64-bit hashes cut into ranges, as many as keep a range's parents and references within bounds. Each range of the parents
becomes one sorted array (with a running maximum of the death times beside it) and is probed with vectorised batches of references by
binary search; a second, independent hash guards against collisions. A range that still is hit by many references, because one
key is, is split over several tasks, each with its own copy of the range's parents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.paths import canonical_path, module_targets, parent_dir
from srcatlas.plans.runtime import checked_broadcast, cut, shuffle_partitions

#: Parents and references that a range holds on average, at most.
PER_RANGE = 200_000
#: References that one copy of a range answers; ranges with more are split.
PROBES_PER_SPLIT = 4 * PER_RANGE
#: Ranges per shuffle partition, at least.
RANGES_PER_PARTITION = 4
FOREVER = np.iinfo(np.int64).max


def _micros(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def _keyed(kind: str, *parts: Column) -> list[Column]:
    return [F.xxhash64(F.lit(kind), *parts).alias("k"), F.xxhash64(*parts, F.lit("#"), F.lit(kind)).alias("k2")]


def parents_of(files: DataFrame) -> DataFrame:
    """(k, k2, born, gone): every file once by its id and once by its repo and path, with its life time in microseconds.

    A file without first_seen_at was never seen; one without deleted_at lives on.
    """
    life = [_micros("first_seen_at").alias("born"), F.coalesce(_micros("deleted_at"), F.lit(int(FOREVER))).alias("gone")]
    seen = files.where(F.col("first_seen_at").isNotNull())
    by_id = seen.where(F.col("file_id").isNotNull()).select(*_keyed("id", F.col("file_id")), *life)
    by_path = seen.where(F.col("path").isNotNull()).select(*_keyed("path", F.col("repo"), canonical_path(F.col("path"))), *life)
    return by_id.unionByName(by_path)


def references_of(imports: DataFrame) -> DataFrame:
    """(import_id, ref_field, at, k, k2, n_targets): one row per record a reference may mean.

    ref_field is resolved_file_id, resolved_path or module; an unresolved relative module stands for all its candidate paths, and
    for one impossible key when it leaves the root, so that it is still counted.
    """
    at = _micros("indexed_at").alias("at")
    usable = imports.where(F.col("import_id").isNotNull() & F.col("indexed_at").isNotNull())
    ids = usable.where(F.col("resolved_file_id").isNotNull()).select("import_id", F.lit("resolved_file_id").alias("ref_field"), at, *_keyed("id", F.col("resolved_file_id")))
    paths = usable.where(F.col("resolved_path").isNotNull()).select("import_id", F.lit("resolved_path").alias("ref_field"), at, *_keyed("path", F.col("repo"), canonical_path(F.col("resolved_path"))))
    loose = usable.where(
        F.col("kind").isin("es_import", "common_js_require")
        & F.rlike("module", F.lit(r"^\.\.?/"))
        & F.col("resolved_path").isNull()
        & F.col("resolved_file_id").isNull()
    )
    targets = module_targets(parent_dir(canonical_path(F.col("path"))), F.col("module"))
    modules = loose.select("import_id", "repo", "indexed_at", F.explode_outer(targets).alias("target")).select(
        "import_id", F.lit("module").alias("ref_field"), at, *_keyed("path", F.col("repo"), F.coalesce("target", F.lit("\x00")))
    )
    return ids.unionByName(paths).unionByName(modules)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parents of a range come before its references; answers alive, seen before and seen later for each reference."""
    current, gathered, table = None, [], None

    def index() -> tuple[np.ndarray, ...]:
        if not gathered:
            empty = np.empty(0, np.int64)
            return empty, empty, empty, empty, empty
        k, k2, born, gone = (np.concatenate(x) for x in zip(*gathered))
        order = np.lexsort((born, k2, k))
        k, k2, born, gone = k[order], k2[order], born[order], gone[order]
        first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])])
        length = np.diff(np.r_[first, len(k)])
        alive_to = gone.copy()
        # running maximum of the deaths inside each key: doubling steps, as many as the longest key needs
        position = np.arange(len(k)) - np.repeat(first, length)
        step = 1
        while step < (length.max() if len(length) else 0):
            take = position >= step
            shifted = np.full(len(k), np.iinfo(np.int64).min)
            shifted[step:] = alive_to[:-step]
            alive_to = np.where(take, np.maximum(alive_to, shifted), alive_to)
            step *= 2
        return k, k2, born, alive_to, first

    for batch in batches:
        spot = batch.column("range_id").to_numpy(zero_copy_only=False)
        split = batch.column("split").to_numpy(zero_copy_only=False)
        is_probe = batch.column("is_probe").to_numpy(zero_copy_only=False)
        k, k2 = batch.column("k").to_numpy(), batch.column("k2").to_numpy()
        born, gone = batch.column("born").to_numpy(), batch.column("gone").to_numpy()
        edges = np.flatnonzero(np.r_[True, (spot[1:] != spot[:-1]) | (split[1:] != split[:-1]) | (is_probe[1:] != is_probe[:-1])])
        for a, b in zip(edges, np.r_[edges[1:], len(spot)]):
            if (spot[a], split[a]) != current:
                current, gathered, table = (spot[a], split[a]), [], None
            if not is_probe[a]:
                gathered.append((k[a:b], k2[a:b], born[a:b], gone[a:b]))
                table = None
                continue
            if table is None:
                table = index()
            pk, pk2, pborn, alive_to, first = table
            alive, before, later = (np.zeros(b - a, bool) for _ in range(3))
            if len(pk):
                # key groups: first position of each key, found by binary search on k, then k2 compared exactly
                starts = pk[first]
                ends = np.r_[first[1:], len(pk)]
                q, q2, t = k[a:b], k2[a:b], born[a:b]
                g = np.searchsorted(starts, q, "left")
                while True:  # distinct keys of equal k are neighbours
                    miss = (g < len(starts)) & (starts[np.minimum(g, len(starts) - 1)] == q) & (pk2[first[np.minimum(g, len(starts) - 1)]] != q2)
                    if not miss.any():
                        break
                    g = g + miss
                at = np.minimum(g, len(starts) - 1)
                found = (g < len(starts)) & (starts[at] == q) & (pk2[first[at]] == q2)
                lo, hi = first[at], ends[at]
                left, right = lo.copy(), hi.copy()
                while True:  # last birth <= t inside the key's slice
                    open_ = left < right
                    if not open_.any():
                        break
                    mid = (left + right) // 2
                    go = open_ & (pborn[np.minimum(mid, len(pk) - 1)] <= t)
                    left = np.where(go, mid + 1, left)
                    right = np.where(open_ & ~go, mid, right)
                before = found & (left > lo)
                later = found & (left < hi)
                alive = before & (alive_to[np.maximum(left - 1, 0)] > t)
            yield pa.RecordBatch.from_arrays(
                [batch.column("import_id").slice(a, b - a), batch.column("ref_field").slice(a, b - a), batch.column("born").slice(a, b - a), pa.array(alive), pa.array(before), pa.array(later)],
                names=["import_id", "ref_field", "at", "alive", "before", "later"],
            )


def probed_references(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(import_id, ref_field, at, alive, before, later) for every record a reference may mean."""
    partitions = shuffle_partitions(imports.sparkSession)
    refs, parents = references_of(imports), parents_of(files)
    # a few keys per row: enough to choose the number of ranges from the tables' sizes, which Parquet knows without a scan
    bits = (max(partitions * RANGES_PER_PARTITION, 2 * (imports.count() + files.count()) // PER_RANGE) - 1).bit_length()
    range_id = F.shiftrightunsigned(F.col("k"), 64 - bits).cast("int")
    probes = refs.withColumn("range_id", range_id)
    # only ranges far above the mean, so at most (number of references) / PROBES_PER_SPLIT rows
    load = probes.groupBy("range_id").agg(F.ceil(F.count(F.lit(1)) / PROBES_PER_SPLIT).cast("int").alias("splits")).where("splits > 1")
    hot = checked_broadcast(cut(load))
    splits = F.coalesce("splits", F.lit(1))
    none = F.lit(None).cast("bigint")
    left = (
        probes.join(hot, "range_id", "left")
        .select("range_id", F.pmod(F.xxhash64("import_id", "ref_field"), splits).cast("int").alias("split"), F.lit(True).alias("is_probe"), "k", "k2", F.col("at").alias("born"), F.lit(0).cast("bigint").alias("gone"), "import_id", "ref_field")
    )
    right = (
        parents.withColumn("range_id", range_id).join(hot, "range_id", "left")
        .select("range_id", F.explode(F.sequence(F.lit(0), splits - 1)).alias("split"), F.lit(False).alias("is_probe"), "k", "k2", "born", "gone", none.alias("import_id"), F.lit(None).cast("string").alias("ref_field"))
    )
    return (
        right.unionByName(left)
        .repartition(partitions, "range_id", "split")
        .sortWithinPartitions("range_id", "split", "is_probe")
        .mapInArrow(_probe, "import_id bigint, ref_field string, at bigint, alive boolean, before boolean, later boolean")
    )


def orphan_references(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(import_id, ref_field, reason, period): every dangling reference once.

    Exact repeats of a reference count once. reason is deleted if a record meant had been seen by indexed_at, else late if one is
    seen afterwards, else missing. References without import_id or indexed_at cannot be judged and are left out. With no files
    every reference is missing; with no references the result is empty. Other columns are ignored.
    """
    period = F.date_format(F.timestamp_micros("at"), "yyyy-MM")
    # a reference with one target is settled when that is alive; only modules may have another
    open_ = probed_references(imports, files).where(~F.col("alive") | (F.col("ref_field") == "module"))
    verdict = open_.groupBy("import_id", "ref_field", "at").agg(*[F.max(c).alias(c) for c in ("alive", "before", "later")])
    reason = F.when(F.col("before"), "deleted").when(F.col("later"), "late").otherwise("missing")
    return verdict.where(~F.col("alive")).select("import_id", "ref_field", reason.alias("reason"), period.alias("period")).dropDuplicates(["import_id", "ref_field"])


def orphan_report(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(ref_field, period, reason, n): dangling references counted per column, month and reason."""
    return orphan_references(imports, files).groupBy("ref_field", "period", "reason").agg(F.count(F.lit(1)).alias("n"))
