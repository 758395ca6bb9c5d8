"""Index tables of a collection of files: files, words, trigrams, symbols, imports, edges; saved, loaded and merged.

A files table has at least (file_id, path, text); `files_table` adds sizes, offsets and the hash. All tables are long form, so that
every step is a join, an explode or a grouping that Catalyst can plan.
"""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srcatlas.functions.policy import eligible, looks_binary
from srcatlas.functions.text import line_count, line_offsets, split_lines, trigram_terms, word_terms
from srcatlas.plans.runtime import checked_broadcast, cut, spread
from srcatlas.sources.config import Config

#: New files of one change up to which they are ranked in one window.
FEW_NEW = 10_000
#: Raised whenever a saved index must be rebuilt.
INDEX_VERSION = 2
TABLES = ("files", "words", "trigrams", "symbols", "imports", "edges")
#: What saved tables are sorted by.
SORTED_BY = {"files": ("file_id",), "words": ("term", "file_id"), "trigrams": ("term", "file_id"), "symbols": ("path", "ord"), "imports": ("path", "ord"), "edges": ("dst_id", "src_id")}


def files_from_text(df: DataFrame, id_col: str, text_col: str, path: Column | None = None) -> DataFrame:
    """Any table of texts as a files table; null texts are left out."""
    name = path if path is not None else F.concat(F.lit("doc/"), F.lpad(F.col(id_col).cast("string"), 10, "0"), F.lit(".txt"))
    return df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("file_id"), name.alias("path"), F.col(text_col).alias("text"))


def numbered(rows: DataFrame, key: str, id_name: str, start: int = 0) -> DataFrame:
    """The rows with consecutive ids from start on in the order of key, whatever their number: no task sorts them all.

    The rows are put into ranges and sorted there once, written to the checkpoint folder, and only then counted, so that the
    counts and the rows come from the same ranges however the plan is changed at run time.
    """
    placed = cut(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    # one row per partition: bounded
    before = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_skip"))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").select((inside + F.col("_skip") + start).cast("bigint").alias(id_name), *rows.columns)


def decoded(scan: DataFrame) -> DataFrame:
    """(path, bytes, mtime_ms, hash, ext, is_utf8, text) of a tree scan's rows, binary ones dropped."""
    kept = scan.where(~looks_binary(F.col("content")))
    # undecodable bytes become replacement characters; the scan says whether there were any
    lossy = F.make_valid_utf8(F.col("content").cast("string"))
    return kept.select("path", F.length("content").cast("bigint").alias("bytes"), "mtime_ms", F.sha2("content", 256).alias("hash"), extension(F.col("path")).alias("ext"), "is_utf8", lossy.alias("text"))


def files_from_scan(scan: DataFrame) -> DataFrame:
    """(path, bytes, mtime_ms, content) of a tree scan as files: binary ones dropped, ids the rank of the path."""
    return numbered(decoded(scan), "path", "file_id")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def files_table(files: DataFrame) -> DataFrame:
    """(file_id, path, bytes, lines, line_offsets, hash, ext, is_utf8, text) from (file_id, path, text), other columns kept if present."""
    have = set(files.columns)
    made = {
        "bytes": F.octet_length("text").cast("bigint"), "lines": line_count(F.col("text")), "line_offsets": line_offsets(F.col("text")), "hash": F.sha2("text", 256),
        "ext": extension(F.col("path")), "is_utf8": F.lit(True), "mtime_ms": F.lit(None).cast("bigint"),
    }
    return files.select("file_id", "path", *[(F.col(c) if c in have else e).alias(c) for c, e in made.items()], "text")


def lines_table(files: DataFrame) -> DataFrame:
    """(file_id, path, line, text): one row per line, counted from 1."""
    rows = files.select("file_id", "path", F.posexplode(split_lines(F.col("text"))).alias("n", "text"))
    return rows.select("file_id", "path", (F.col("n") + 1).cast("bigint").alias("line"), "text")


def word_postings(files: DataFrame) -> DataFrame:
    """(term, file_id), distinct."""
    return spread(files.select("file_id", "text")).select(F.explode(word_terms(F.col("text"))).alias("term"), "file_id")


def trigram_postings(files: DataFrame) -> DataFrame:
    """(term, file_id), distinct."""
    return spread(files.select("file_id", "text")).select(F.explode(trigram_terms(F.col("text"))).alias("term"), "file_id")


#: File ids per block of a posting list.
BLOCK = 1 << 16


def inverted(postings: DataFrame, block: int = BLOCK) -> DataFrame:
    """(term, block, file_ids): the grouped view, sorted. Blocks of file ids bound each array, however many files hold a term."""
    return postings.groupBy("term", F.floor(F.col("file_id") / block).alias("block")).agg(F.sort_array(F.collect_set("file_id")).alias("file_ids"))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("n_files"))


def build(files: DataFrame) -> dict[str, DataFrame]:
    """All index tables, lazily."""
    from srcatlas.operators.graph import edges, resolve_imports
    from srcatlas.operators.imports import extract_imports
    from srcatlas.operators.symbols import extract_symbols

    full = files_table(files)
    imports = resolve_imports(extract_imports(full), full)
    return {"files": full, "words": word_postings(full), "trigrams": trigram_postings(full), "symbols": extract_symbols(full), "imports": imports, "edges": edges(imports)}


def status(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of counts, each exact: one aggregation per table."""
    wanted = {
        "files": {"files": F.count(F.lit(1))}, "words": {"words": F.countDistinct("term")}, "trigrams": {"trigrams": F.countDistinct("term")},
        "symbols": {"symbols": F.count(F.lit(1)), "symbol_names": F.countDistinct("name_lc")}, "imports": {"deps_files": F.countDistinct("file_id")},
        "edges": {"deps_forward": F.countDistinct("src_id"), "deps_reverse": F.countDistinct("dst_id")},
    }
    rows, names = None, []
    for table, counts in wanted.items():
        names += counts
        if table in tables:
            one = tables[table].agg(*[c.alias(n) for n, c in counts.items()])
            one = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).alias("n")) for n in counts])).alias("c")).select("c.k", "c.n")
            rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy().pivot("k", names).agg(F.first("n"))


def tree(files: DataFrame, limit: int | None = None) -> DataFrame:
    """(path, lines, bytes, hash) in path order."""
    rows = files.select("path", "lines", "bytes", "hash").orderBy("path")
    return rows if limit is None else rows.limit(limit)


def format_tree(files: DataFrame) -> DataFrame:
    """`path<TAB>n lines<TAB>n bytes` of each file."""
    return files.select(F.concat(F.col("path"), F.lit("\t"), F.col("lines").cast("string"), F.lit(" lines\t"), F.col("bytes").cast("string"), F.lit(" bytes")).alias("value"))


def format_status(counts: DataFrame, root: str | None = None) -> DataFrame:
    """`name: value` of the root, if there is one, and of each count."""
    names = {"files": "files", "words": "words", "trigrams": "trigrams", "symbols": "symbols", "symbol_names": "symbol names", "deps_files": "deps files"}
    lines = [F.concat(F.lit(f"{label}: "), F.col(c).cast("string")) for c, label in names.items()]
    if root is not None:
        lines.insert(0, F.lit(f"root: {root}"))
    return counts.select(F.explode(F.array_compact(F.array(*lines))).alias("value"))


# saving and loading -------------------------------------------------------------------------------------------------------------


def save(tables: dict[str, DataFrame], folder: str, config: dict | None = None, root: str | None = None) -> dict:
    """Write every table into a new version folder, then point the manifest at it: readers see the old version or the new one whole.

    Tables that are looked up by a key are put into ranges of it and sorted, so that a lookup skips all row groups but a few.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"v{time.time_ns() // 1_000_000}"

    def write(name: str) -> None:
        df = tables[name]
        keys = [k for k in SORTED_BY.get(name, ()) if k in df.columns]
        placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
        placed.write.mode("overwrite").parquet(f"{folder}/{version}/{name}")

    with ThreadPoolExecutor(len(tables)) as pool:  # a job each: small tables do not wait for large ones
        list(pool.map(inheritable_thread_target(spark)(write), tables))
    manifest = {"version": INDEX_VERSION, "data": version, "tables": sorted(tables), "config": config or {}, "root": root, "built_ms": int(time.time() * 1000)}
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest.json")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    return manifest


def drop_versions(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Remove all but the newest versions of a saved index; a reader of the one before may still be at work."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(x.getPath().getName() for x in fs.listStatus(path) if x.getPath().getName()[:1] == "v")
    for name in found[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)


def read_manifest(spark: SparkSession, folder: str) -> dict | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest.json")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    try:
        return json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).head()[0])
    except (ValueError, TypeError):
        return None


def load(spark: SparkSession, folder: str, config: dict | None = None, root: str | None = None) -> dict[str, DataFrame] | None:
    """The saved tables, or None if there is no manifest, or one of another version, configuration or root: the caller rebuilds."""
    manifest = read_manifest(spark, folder)
    if not manifest or manifest.get("version") != INDEX_VERSION or config is not None and manifest.get("config") != config or root is not None and manifest.get("root") != root:
        return None
    return {t: spark.read.parquet(f"{folder}/{manifest['data']}/{t}") for t in manifest["tables"]}


def snapshot_info(spark: SparkSession, folder: str) -> DataFrame:
    """One row about the saved index: whether it exists, its version, stamp and counts."""
    manifest = read_manifest(spark, folder)
    tables = load(spark, folder) if manifest else None
    row = (folder, manifest is not None, manifest and manifest.get("version"), manifest and manifest.get("data"), tables["files"].count() if tables else None)
    return spark.createDataFrame([row], "folder string, saved boolean, version int, stamp string, files bigint")


# incremental maintenance ----------------------------------------------------------------------------------------------------------


def upsert_files(base: DataFrame, changed: DataFrame, config: Config | None = Config()) -> DataFrame:
    """Replace files by path: a changed file keeps its id, a new one gets the ids after the greatest (1 on an empty table).

    `changed` has (path, text), and if need be the other columns of a files table; what of them the base has is made from the text
    where it is absent. Changed files that are not eligible by the configuration are removed; without one all are taken. Of rows that repeat a path one
    holds; null paths are left out, a null text removes the file.
    """
    rows = _identified(base, base.select("path", "file_id"), changed, config)
    return base.join(checked_broadcast(changed.select("path").distinct()), "path", "left_anti").select(*base.columns).unionByName(rows)


def _identified(base: DataFrame, known: DataFrame, changed: DataFrame, config: Config | None) -> DataFrame:
    """The eligible ones of changed files with their ids, those of `known` (path, file_id) or new ones, and the columns of base."""
    wanted = changed.where(F.col("path").isNotNull() & F.col("text").isNotNull()).dropDuplicates(["path"])
    if config is not None:
        wanted = wanted.where(eligible(F.col("path"), F.octet_length("text"), config.max_file_size, config.allow_sensitive, config.include_hidden))
    top = base.agg(F.max("file_id")).head()[0] or 0
    matched = wanted.join(known.select("path", F.col("file_id").alias("_old")), "path", "left")
    kept, new = matched.where(F.col("_old").isNotNull()).withColumn("file_id", F.col("_old")), matched.where(F.col("_old").isNull())
    few = new.limit(FEW_NEW + 1).count() <= FEW_NEW
    fresh = new.withColumn("file_id", (F.row_number().over(Window.orderBy("path")) + top).cast("bigint")) if few else numbered(new, "path", "file_id", top + 1)
    rows = kept.select("file_id", *wanted.columns).unionByName(fresh.select("file_id", *wanted.columns))
    rows = files_table(rows) if {"bytes", "hash"} <= set(base.columns) else rows
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in base.dtypes])


def overlay(base: DataFrame, created: list[tuple[str, str]], modified: list[tuple[str, str]], removed: list[str], top: int) -> DataFrame:
    """(file_id, path, text) of a files table with a few changes laid over it, without a job of its own: (path, text) of new and of changed files.

    New files get the ids after `top`, the greatest of the base. For few changes, as they come between two builds: they are part of the plan.
    """
    spark, rows = base.sparkSession, base.select("file_id", "path", "text")
    touched = [p for p, _ in created] + [p for p, _ in modified] + removed
    result = rows.where(~F.col("path").isin(*touched)) if touched else rows
    if modified:
        now = spark.createDataFrame(modified, "path string, text string")
        result = result.unionByName(rows.where(F.col("path").isin(*[p for p, _ in modified])).select("file_id", "path").join(F.broadcast(now), "path"))
    if created:
        new = [(top + i, p, t) for i, (p, t) in enumerate(sorted(created), 1)]
        result = result.unionByName(spark.createDataFrame(new, "file_id bigint, path string, text string"))
    return result


def merge_postings(base: DataFrame, changed_ids: DataFrame, new: DataFrame) -> DataFrame:
    """A per-file table with the rows of changed files replaced."""
    return _replaced(base, checked_broadcast(changed_ids.select("file_id").distinct()), new)


def _replaced(base: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    return base.join(gone, "file_id", "left_anti").select(*base.columns).unionByName(new.select(*base.columns))


def apply_changes(tables: dict[str, DataFrame], changed: DataFrame, removed: DataFrame, config: Config | None = Config()) -> dict[str, DataFrame]:
    """All tables after `changed` files (path, text, ...) were created or modified and `removed` ones (path) have gone.

    Equal to an index built anew but for the ids of new files. Files that are no longer eligible go like removed ones. Imports of
    changed files are extracted anew; of the others those are resolved again that could mean a changed or removed path.
    """
    from srcatlas.operators.graph import edges, resolve_again
    from srcatlas.operators.imports import extract_imports
    from srcatlas.operators.symbols import extract_symbols

    old, changed = tables["files"], changed.drop("file_id")
    touched = checked_broadcast(cut(changed.select("path").union(removed.select("path")).where(F.col("path").isNotNull()).distinct()))
    known = cut(old.join(touched, "path", "left_semi").select("path", "file_id"))
    now = cut(_identified(old, known, changed, config))
    files = old.join(touched, "path", "left_anti").select(*old.columns).unionByName(now)
    gone = checked_broadcast(known.select("file_id").union(now.select("file_id")).distinct())
    result = {"files": files}
    for name, made in (("words", word_postings), ("trigrams", trigram_postings), ("symbols", extract_symbols)):
        if name in tables:
            result[name] = _replaced(tables[name], gone, made(now))
    if "imports" in tables:
        fresh = extract_imports(now)
        merged = _replaced(tables["imports"], gone, fresh.select(*[F.col(c) if c in fresh.columns else F.lit(None).cast(t).alias(c) for c, t in tables["imports"].dtypes]))
        result["imports"] = resolve_again(merged, files, touched, now)
        result["edges"] = edges(result["imports"])
    return result | {name: df for name, df in tables.items() if name not in result}


def remove_files(tables: dict[str, DataFrame], removed_ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the removed files; imports that pointed at them mean the next candidate that exists, or none."""
    paths = tables["files"].join(checked_broadcast(removed_ids.select("file_id").distinct()), "file_id", "left_semi").select("path")
    return apply_changes(tables, tables["files"].limit(0), paths)
