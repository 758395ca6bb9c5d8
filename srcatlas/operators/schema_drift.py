"""Schemas that drift between files (problem 1).

Each log file gets a fingerprint, its sorted fields and types. Files whose fingerprint is the one of the file before have no change.
Every other pair of fingerprints is looked at once: what differs becomes explicit steps, and only where fields both go and come are the
contents of those fields, of those files, compared. The steps (rename, default, cast, drop) are chained and route every record
into one table.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.plans.runtime import checked_broadcast, cut, salted_join, shuffle_partitions, spread

#: Length of a field's content profile: half for the values' magnitudes or hashes, half for their shapes.
PROFILE = 64
#: Score from which a removed and an added field are one renamed field.
RENAME_FROM = 0.8
#: A rename step seen in this share of the field's disappearances lends a doubtful pair KNOWN_ADDS, other pairs without a shared name
#: lose STRANGE_TAKES: shares only, so that a table and several copies of it give the same.
KNOWN_ADDS, KNOWN_SHARE = 0.7, 0.05
STRANGE_TAKES = 0.3
#: file_seq values per bucket of the two-level search for the file before.
SEQ_BUCKET = 1024
FILE = ["stream", "series", "file_seq", "log_file"]
FILE_SCHEMA = "stream string, series string, file_seq bigint, log_file string"


def _reject(name: str) -> None:
    raise ValueError(name)


def _object(raw: str | None) -> dict | None:
    """The JSON object of a line, None for anything else (NaN and Infinity are no JSON)."""
    if not raw or not raw.lstrip().startswith("{"):
        return None
    try:
        value = json.loads(raw, parse_constant=_reject)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def flatten(value: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """Fields set and not null, nested ones named with dots; an array is one field."""
    for key, x in value.items():
        if isinstance(x, dict):
            yield from flatten(x, f"{prefix}{key}.")
        elif x is not None:
            yield prefix + key, x


JSON_TYPES = {bool: "boolean", int: "integer", float: "decimal", list: "array", str: "string"}


def json_type(x: object) -> str:
    return JSON_TYPES[type(x)]


def _profile(x: object, into: list[float]) -> None:
    """Add what a value looks like: numbers by magnitude, texts by hash and by shape."""
    half = PROFILE // 2
    if isinstance(x, list):
        into[half + 1] += 1
        for y in x:
            into[zlib.crc32(str(y).encode("utf-8", "replace")) % half] += 1 / len(x)
        return
    text = str(x).lower() if isinstance(x, bool) else str(x)
    number = None
    if not isinstance(x, bool) and len(text) < 32:
        try:
            number = float(text)
        except ValueError:
            pass
    if number is not None and math.isfinite(number):
        spot = min(math.log2(abs(number) + 1) / 2, half - 2)
        low = int(spot)
        into[low] += 1 - (spot - low)
        into[low + 1] += spot - low
        into[half] += 1
    else:
        into[zlib.crc32(text.encode("utf-8", "replace")) % half] += 1
        kinds = {"a" if c.isalpha() and c.islower() else "A" if c.isalpha() else "0" if c.isdigit() else c for c in set(text)} | {f"length {len(text).bit_length()}"}
        for kind in kinds:
            into[half + 2 + zlib.crc32(kind.encode("utf-8", "replace")) % (half - 2)] += 1 / len(kinds)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fields per file and batch, already summed: what is shuffled grows with files, not with lines."""
    names = [*FILE, "field", "type", "n", "pos"]
    for batch in batches:
        shapes: Counter = Counter()  # the lines of a file hardly differ in their fields
        for *key, raw in zip(*(batch.column(c).to_pylist() for c in (*FILE, "raw"))):
            value = _object(raw)
            if value is not None:
                shapes[tuple(key), tuple([(f, type(x)) for f, x in flatten(value)])] += 1
        seen: dict[tuple, list] = {}
        for (key, shape), times in shapes.items():
            for i, (field, kind) in enumerate(shape):
                got = seen.setdefault((*key, field), ["", 0, 0.0])
                got[0] = max(got[0], JSON_TYPES[kind])
                got[1] += times
                got[2] += times * i / len(shape)
        rows = [(*key, *got) for key, got in seen.items()]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)], names=names)


def _usable(records: DataFrame) -> DataFrame:
    return records.select(*FILE, "raw").where(F.col("raw").isNotNull() & F.col("series").isNotNull() & F.col("file_seq").isNotNull())


def file_schemas(records: DataFrame) -> DataFrame:
    """(stream, series, file_seq, log_file, fields, fingerprint): one row per file with at least one JSON object."""
    parts = spread(_usable(records)).mapInArrow(_described, FILE_SCHEMA + ", field string, type string, n bigint, pos double")
    # by file once; both groupings below go by it
    placed = parts.repartition(shuffle_partitions(records.sparkSession), *FILE)
    per_field = placed.groupBy(*FILE, "field").agg(F.max("type").alias("type"), (F.sum("pos") / F.sum("n")).alias("pos"))
    files = per_field.groupBy(*FILE).agg(F.sort_array(F.collect_list(F.struct("field", "type", "pos"))).alias("fields"))
    text = F.array_join(F.transform("fields", lambda x: F.concat_ws(":", x["field"], x["type"])), ",")
    return files.withColumn("fingerprint", F.sha2(text, 256))


def _with_before(files: DataFrame) -> DataFrame:
    """Each file with the number of the one before it in its series, found in buckets so that no series is sorted as a whole."""
    keys = files.select("stream", "series", "file_seq").distinct().withColumn("bucket", F.floor(F.col("file_seq") / SEQ_BUCKET))
    own = Window.partitionBy("stream", "series", "bucket").orderBy("file_seq")
    inside = keys.withColumn("before_seq", F.lag("file_seq").over(own))
    buckets = keys.groupBy("stream", "series", "bucket").agg(F.max("file_seq").alias("last"))
    earlier = buckets.select("stream", "series", "bucket", F.lag("last").over(Window.partitionBy("stream", "series").orderBy("bucket")).alias("before_bucket"))
    return inside.join(earlier, ["stream", "series", "bucket"]).select("stream", "series", "file_seq", F.coalesce("before_seq", "before_bucket").alias("before_seq"))


def file_steps(files: DataFrame) -> DataFrame:
    """Each file that differs from the one before it in its series: (stream, series, file_seq, log_file, before_seq, before_log, before, was, fields, fingerprint).

    before and fields are the fields of the two files, was and fingerprint their fingerprints. Files of equal fingerprints have no step.
    """
    linked = files.join(_with_before(files), ["stream", "series", "file_seq"])
    held = F.max(F.struct("log_file", "fields", "fingerprint"))
    before = files.groupBy("stream", "series", F.col("file_seq").alias("before_seq")).agg(held.alias("b"))
    joined = linked.where(F.col("before_seq").isNotNull()).join(before, ["stream", "series", "before_seq"]).where(F.col("b.fingerprint") != F.col("fingerprint"))
    return joined.select(*FILE, "before_seq", F.col("b.log_file").alias("before_log"), F.col("b.fields").alias("before"), F.col("b.fingerprint").alias("was"), "fields", "fingerprint")


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Content profiles of the wanted fields per file and batch, already summed."""
    for batch in batches:
        seen: dict[tuple, list[float]] = {}
        known: dict[tuple, list[tuple[int, float]]] = {}  # what a value adds: values repeat
        for *key, raw, wanted in zip(*(batch.column(c).to_pylist() for c in (*FILE, "raw", "wanted"))):
            value = _object(raw)
            if value is None:
                continue
            wanted = set(wanted)
            for field, x in flatten(value):
                if field not in wanted:
                    continue
                into = seen.setdefault((*key, field), [0.0] * PROFILE)
                if isinstance(x, list):
                    _profile(x, into)
                    continue
                adds = known.get((type(x), x))
                if adds is None:
                    one = [0.0] * PROFILE
                    _profile(x, one)
                    adds = known[type(x), x] = [(i, y) for i, y in enumerate(one) if y]
                for i, y in adds:
                    into[i] += y
        columns = list(zip(*seen)) if seen else [()] * 5
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types)), pa.array(list(seen.values()), pa.list_(pa.float64()))], names=[*FILE, "field", "profile"])


def content_profiles(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """(stream, series, file_seq, log_file, profiles): the profiles of the fields (file, field) asked for; a file of many rows is met by all tasks."""
    lists = wanted.distinct().groupBy(*FILE).agg(F.collect_list("field").alias("wanted"))
    rows = salted_join(_usable(records), lists, FILE, "raw")
    parts = spread(rows).mapInArrow(_profiled, FILE_SCHEMA + ", field string, profile array<double>")
    sums = parts.groupBy(*FILE, "field").agg(*[F.sum(F.col("profile")[i]).alias(f"p{i}") for i in range(PROFILE)])
    one = F.struct("field", F.array(*[f"p{i}" for i in range(PROFILE)]).alias("profile"))
    return sums.groupBy(*FILE).agg(F.collect_list(one).alias("profiles"))


def _words(field: str) -> set[str]:
    """The words of a field's own name, plurals cut."""
    return {w.lower().rstrip("s") or w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", field.rpartition(".")[2])}


def _same_content(a: dict, b: dict) -> float:
    """How alike the two content profiles are, 0 to 1: overlap, for numbers also the distance of the mean magnitudes."""
    half = PROFILE // 2

    def overlap(p: list[float], q: list[float]) -> float:
        sp, sq = sum(p) or 1, sum(q) or 1
        return sum(min(x / sp, y / sq) for x, y in zip(p, q))

    p, q = list(a["profile"]), list(b["profile"])
    if p[half] and q[half]:
        mean = [sum(i * x for i, x in enumerate(v[:half])) / (sum(v[:half]) or 1) for v in (p, q)]
        return max(overlap(p[:half], q[:half]), 1 - abs(mean[0] - mean[1]) / 1.5, 0)
    return (overlap(p[:half], q[:half]) + overlap(p[half:], q[half:])) / 2


def _numeric(a: dict) -> bool:
    return a["profile"][PROFILE // 2] > 0


def _comparable(a: str, b: str, x: dict, y: dict) -> bool:
    """Whether a field could go on under the other name at all: same parent, same kind of values."""
    return a.rpartition(".")[0] == b.rpartition(".")[0] and (x["type"] == "array") == (y["type"] == "array") and (x["type"] == "boolean") == (y["type"] == "boolean") and _numeric(x) == _numeric(y)


def match_renames(before: list[dict], after: list[dict], known: frozenset[tuple[str, str]] | None = None) -> dict[str, str]:
    """Which removed field goes on under which added name: best pairs first, one partner each.

    A pair must share its parent and what it holds. Beyond that it needs a shared word in the names, the same texts, or the
    same neighbours in the record; a field appended at the end of its object is no evidence of a rename. What is `known` from
    all series counts too, for a pair or against it; None is no such knowledge.
    """
    old, new = {x["field"]: x for x in before}, {x["field"]: x for x in after}
    gone, come = [f for f in old if f not in new], [f for f in new if f not in old]
    if not gone or not come:
        return {}

    def neighbours(fields: dict[str, dict], common: set[str]) -> dict[str, tuple]:
        ordered, result = sorted(fields, key=lambda f: (fields[f]["pos"], f)), {}
        last, run = None, []
        for f in [*ordered, None]:
            if f is None or f in common:
                for x in run:
                    parent = x.rpartition(".")[0]
                    result[x] = (last if last and last.rpartition(".")[0] == parent else None, f if f and f.rpartition(".")[0] == parent else None)
                last, run = f, []
            else:
                run.append(f)
        return result

    common = set(old) & set(new)
    na, nb = neighbours(old, common), neighbours(new, common)
    order = [[f for f in sorted(x, key=lambda f: (x[f]["pos"], f)) if f in common] for x in (old, new)]
    shuffled = order[0] != order[1]
    scored = []
    for a in gone:
        for b in come:
            x, y = old[a], new[b]
            if not _comparable(a, b, x, y):
                continue
            content = _same_content(x, y)
            shared = _words(a) & _words(b)
            named = 1.0 if shared or (min(len(a.rpartition(".")[2]), len(b.rpartition(".")[2])) >= 3 and (a.rpartition(".")[2].startswith(b.rpartition(".")[2]) or b.rpartition(".")[2].startswith(a.rpartition(".")[2]))) else 0.0
            before_same, after_same = na[a][0] == nb[b][0], na[a][1] == nb[b][1]
            inner = na[a][1] is not None
            placed = (0.8 if before_same and after_same else 0.4 if after_same else 0.0) if inner else 0.0
            if shuffled and not placed:
                placed = 0.35
            texts = content if not _numeric(x) and x["type"] != "boolean" else 0.0
            scored.append((0.6 * content + named + placed + 0.6 * texts + (0 if known is None else KNOWN_ADDS if (a, b) in known else 0 if named else -STRANGE_TAKES), a, b))
    result: dict[str, str] = {}
    for score, a, b in sorted(scored, key=lambda s: (-s[0], s[1], s[2])):
        if score >= RENAME_FROM and a not in result and b not in result.values():
            result[a] = b
    return result


STEP = "step_id bigint, field string, becomes string, chosen boolean"


_STEP = FILE_SCHEMA + ", before_seq bigint, before_log string, step_id bigint"
_FIELDS = "array<struct<field: string, type: string, pos: double>>"
_SETTLED = f"{_STEP}, before {_FIELDS}, fields {_FIELDS}, gone array<string>, come array<string>, changes array<struct<field: string, change: string, becomes: string, type: string>>, open boolean"


def _settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What two fingerprints alone say about a step: its changes if fields only go or only come, else nothing, the contents being needed.

    Each pair of fingerprints is judged once by a worker.
    """
    known: dict[tuple[str, str], tuple] = {}
    for pdf in batches:
        rows = []
        for was, now, before, after in zip(pdf["was"], pdf["fingerprint"], pdf["before"], pdf["fields"]):
            verdict = known.get((was, now))
            if verdict is None:
                old, new = {x["field"]: x["type"] for x in before}, {x["field"]: x["type"] for x in after}
                gone, come = [f for f in old if f not in new], [f for f in new if f not in old]
                open_ = any(_may_be(old[a], new[b]) and a.rpartition(".")[0] == b.rpartition(".")[0] for a in gone for b in come)
                verdict = known[was, now] = (gone if open_ else [], come if open_ else [], [] if open_ else _changes(old, new, {}), open_)
            rows.append(verdict)
        out = pdf.drop(columns=["was", "fingerprint"])
        for i, name in enumerate(("gone", "come", "changes", "open")):
            out[name] = [x[i] for x in rows]
        yield out


def _may_be(a: str, b: str) -> bool:
    """Whether a field of type a may go on as one of type b."""
    return (a == "array") == (b == "array") and (a == "boolean") == (b == "boolean")


def _changes(old: dict[str, str], new: dict[str, str], renames: dict[str, str]) -> list[tuple[str, str, str, str | None]]:
    """(field, change, becomes, type after) of one step."""
    rows: list[tuple[str, str, str, str | None]] = []
    for f in old:
        if f in renames:
            rows.append((f, "renamed", renames[f], new[renames[f]]))
        elif f not in new:
            rows.append((f, "removed", "", None))
        elif new[f] != old[f]:
            rows.append((f, "type_changed", new[f], new[f]))
    taken = set(renames.values())
    return rows + [(f, "added", "", new[f]) for f in new if f not in old and f not in taken]


def _with_profiles(fields: list[dict], profiles: list[dict] | None) -> list[dict]:
    known = {x["field"]: x["profile"] for x in profiles} if profiles is not None else {}
    return [{"field": x["field"], "type": x["type"], "pos": x["pos"], "profile": known.get(x["field"], [0.0] * PROFILE)} for x in fields]


def _first_steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each file the fields that are gone and, without knowledge of other files, what each becomes ('' if nothing), then the further pairs that could be."""
    for pdf in batches:
        rows = []
        for step, before, after, was, now in zip(pdf["step_id"], pdf["before"], pdf["fields"], pdf["before_profiles"], pdf["profiles"]):
            before, after = _with_profiles(before, was), _with_profiles(after, now)
            renames = match_renames(before, after)
            old, new = {x["field"]: x for x in before}, {x["field"]: x for x in after}
            come = [f for f in new if f not in old]
            for f in old.keys() - new.keys():
                rows.append((step, f, renames.get(f, ""), True))
                rows += [(step, f, b, False) for b in come if b != renames.get(f) and _comparable(f, b, old[f], new[b])]
        yield pd.DataFrame(rows, columns=["step_id", "field", "becomes", "chosen"])


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for *head, before, after, was, now, known in zip(*(pdf[c] for c in (*FILE, "before", "fields", "before_profiles", "profiles", "known"))):
            before, after = _with_profiles(before, was), _with_profiles(after, now)
            renames = match_renames(before, after, frozenset() if known is None else frozenset((x["field"], x["becomes"]) for x in known))
            rows += [(*head, *x) for x in _changes({x["field"]: x["type"] for x in before}, {x["field"]: x["type"] for x in after}, renames)]
        yield pd.DataFrame(rows, columns=[*FILE, "field", "change", "becomes", "type"])


CHANGE = FILE_SCHEMA + ", field string, change string, becomes string, type string"


def schema_changes(records: DataFrame) -> DataFrame:
    """Every change of every file against the one before it in its series: (stream, series, file_seq, log_file, field, change, becomes, type).

    change is added, removed, renamed (becomes: the new name) or type_changed (becomes: the new type); type is the type after.
    Lines that are no JSON object, nulls, repeated lines and gaps in file_seq do not matter; a file without any JSON object is
    passed over; rows without stream, series, file_seq or raw are left out; files without a log_file name are compared by names and
    places only. An empty table gives an empty result.
    """
    files = cut(file_schemas(records))  # read three times below; one row per file
    steps = file_steps(files).withColumn("step_id", F.monotonically_increasing_id())
    # one row per file that differs from the one before
    judged = cut(steps.select(*FILE, "before_seq", "before_log", "step_id", "before", "fields", "was", "fingerprint").mapInPandas(_settled, _SETTLED))
    settled = judged.where("not open").select(*FILE, F.inline("changes"))
    open_ = judged.where("open").select("step_id", *FILE, "before_seq", "before_log", "before", "fields", "gone", "come")
    before_key = [F.col("stream"), F.col("series"), F.col("before_seq").alias("file_seq"), F.col("before_log").alias("log_file")]
    wanted = open_.select(*before_key, F.explode("gone").alias("field")).unionByName(open_.select(*FILE, F.explode("come").alias("field")))
    profiles = cut(content_profiles(records, wanted))
    was = profiles.select("stream", "series", F.col("file_seq").alias("before_seq"), F.col("log_file").alias("before_log"), F.col("profiles").alias("before_profiles"))
    known_content = open_.drop("gone", "come").join(profiles, FILE, "left").join(was, ["stream", "series", "before_seq", "before_log"], "left")
    first = cut(known_content.select("step_id", "before", "fields", "before_profiles", "profiles").mapInPandas(_first_steps, STEP))  # no profiles
    # how often each field of all files went, and what it then became
    plain = settled.where("change = 'removed'").select("field", "becomes")
    counts = first.where("chosen").select("field", "becomes").unionByName(plain).groupBy("field", "becomes").agg(F.count(F.lit(1)).alias("seen"))
    totals = counts.groupBy("field").agg(F.sum("seen").alias("total"))
    seen = counts.where("becomes != ''").join(totals, "field").where(F.col("seen") >= KNOWN_SHARE * F.col("total")).select("field", "becomes")
    known = seen.union(seen.select("becomes", "field")).distinct()
    helped = first.where("becomes != ''").join(known, ["field", "becomes"])  # known steps are few, and a hot one is split at run time
    lists = helped.groupBy("step_id").agg(F.collect_set(F.struct("field", "becomes")).alias("known"))
    compared = known_content.join(lists, "step_id", "left").mapInPandas(_compare, CHANGE)
    return settled.unionByName(compared)


#: The rule that each change adds to the route of later records.
RULES = {"renamed": "rename", "added": "default", "type_changed": "cast", "removed": "drop"}


def migration_steps(changes: DataFrame) -> DataFrame:
    """(stream, series, file_seq, log_file, rule, field, target): what carries records of earlier files over each file's changes.

    rename: field goes on as target; default: earlier records have no field, null stands for it, target is its type; cast: values
    of field are cast to the type target; drop: later records have no field, null stands for it.
    """
    rule = F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv])[F.col("change")]
    target = F.when(F.col("change") == "added", F.col("type")).otherwise(F.col("becomes"))
    return changes.select(*FILE, rule.alias("rule"), "field", target.alias("target"))


def schema_versions(records: DataFrame) -> DataFrame:
    """(stream, fingerprint, n_files, n_series, n_fields): the versions of each stream's schema and where they hold."""
    return file_schemas(records).groupBy("stream", "fingerprint").agg(
        F.count(F.lit(1)).alias("n_files"), F.countDistinct("series").alias("n_series"), F.max(F.size("fields")).cast("bigint").alias("n_fields")
    )


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rename steps of one series, oldest first, folded into spans: field f means `canonical` in files from..until."""
    pdf = pdf.sort_values(["file_seq", "field"])
    means: dict[str, tuple[str, int]] = {}
    spans = []
    first = -(2**62)
    for seq, steps in pdf.groupby("file_seq"):
        moved = {}
        for old, new in zip(steps["field"], steps["becomes"]):
            canonical, start = means.pop(old, (old, first))
            spans.append((old, canonical, start, int(seq) - 1))
            moved[new] = (canonical, int(seq))
        means.update(moved)
    spans += [(field, canonical, start, 2**62) for field, (canonical, start) in means.items()]
    return pd.DataFrame([(pdf["stream"].iloc[0], pdf["series"].iloc[0], *s) for s in spans], columns=["stream", "series", "field", "canonical", "from_seq", "until_seq"])


def rename_spans(changes: DataFrame) -> DataFrame:
    """(stream, series, field, canonical, from_seq, until_seq): chained renames. Grouped are rename steps, not records."""
    renames = changes.where("change = 'renamed'").select("stream", "series", "file_seq", "field", "becomes")
    return renames.groupBy("stream", "series").applyInPandas(_chain, "stream string, series string, field string, canonical string, from_seq bigint, until_seq bigint")


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key in pdf.itertuples(index=False):
            value = _object(key.raw)
            if value is not None:
                spans = [] if key.spans is None else key.spans
                names = {s["field"]: s["canonical"] for s in spans if s["from_seq"] <= key.file_seq <= s["until_seq"]}
                cells = {names.get(f, f): (x if isinstance(x, str) else json.dumps(x)) for f, x in flatten(value)}
                rows.append((key.record_id, key.stream, key.series, key.file_seq, cells))
        yield pd.DataFrame(rows, columns=["record_id", "stream", "series", "file_seq", "cells"])


def consistent_records(records: DataFrame) -> DataFrame:
    """(record_id, stream, series, file_seq, cells): every JSON record once, its values under the names its series began with.

    cells maps a canonical field to its value as text; fields that a record lacks are absent (the default is null), see
    `consistent_table` for typed columns. Exact repeats of a line count once; lines that are no JSON object are left out.
    """
    spans = rename_spans(schema_changes(records)).groupBy("stream", "series").agg(F.collect_list(F.struct("field", "canonical", "from_seq", "until_seq")).alias("spans"))
    rows = records.where(F.col("raw").isNotNull()).dropDuplicates(["series", "file_seq", "log_file", "line_no", "raw"])
    routed = rows.select("record_id", "stream", "series", "file_seq", "raw").join(checked_broadcast(spans), ["stream", "series"], "left")
    return routed.mapInPandas(_cells, "record_id bigint, stream string, series string, file_seq bigint, cells map<string,string>")


def consistent_table(records: DataFrame, stream: str, columns: dict[str, str], renames: dict[str, str] | None = None, defaults: dict[str, object] | None = None) -> DataFrame:
    """One typed table of a stream: columns maps canonical fields to Spark types.

    renames maps further names to canonical ones. Values are cast (true, "true" and 1 are one boolean; a number with a fraction
    is rounded where an integer is asked for); a field that a record lacks takes its default, null if there is none. `failed` lists
    the fields whose value could not be cast and is null for that reason. Dots in names become underscores.
    """
    by_type = {
        "boolean": lambda c: F.when(F.lower(c).isin("true", "1"), True).when(F.lower(c).isin("false", "0"), False),
        # whole numbers stay exact beyond 2^53; only what has a fraction or an exponent goes through a decimal
        "bigint": lambda c: F.coalesce(c.try_cast("bigint"), F.round(c.try_cast("decimal(38,10)")).try_cast("bigint"), F.round(c.try_cast("double")).try_cast("bigint")),
    }
    rows = consistent_records(records).where(F.col("stream") == stream)

    def cell(field: str) -> Column:
        return F.coalesce(*[F.col("cells")[f] for f in (field, *[a for a, b in (renames or {}).items() if b == field])])

    def typed(field: str, kind: str) -> Column:
        return by_type.get(kind, lambda c: c.try_cast(kind))(cell(field))

    failed = F.array_compact(F.array(*[F.when(cell(f).isNotNull() & typed(f, t).isNull(), f) for f, t in columns.items()]))
    value = lambda f, t: F.when(cell(f).isNull(), F.lit((defaults or {}).get(f)).cast(t)).otherwise(typed(f, t))
    return rows.select("record_id", "series", "file_seq", *[value(f, t).alias(f.replace(".", "_")) for f, t in columns.items()], failed.alias("failed"))
