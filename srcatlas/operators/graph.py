"""Resolution of relative JS/TS imports and the dependency graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.paths import parent_dir, resolve_dots
from srcatlas.plans.runtime import checked_broadcast, cut

# Extensions probed for importers in JavaScript and for others, in this order.
JS_FIRST = ("js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts")
TS_FIRST = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs")


def candidates(importer: Column, module: Column) -> Column:
    """Paths a relative module may mean, best first: itself, with each extension, as a folder's index; itself alone if it has one."""
    base = resolve_dots(F.concat_ws("/", parent_dir(importer), module))
    known = F.rlike(base, F.lit(r"[^/]\.(?:%s)$" % "|".join(JS_FIRST)))
    lists = [F.array(base, *[F.concat(base, F.lit("." + e)) for e in order], *[F.concat(base, F.lit("/index." + e)) for e in order]) for order in (JS_FIRST, TS_FIRST)]
    probed = F.when(F.rlike(importer, F.lit(r"\.(?:js|jsx|mjs|cjs)$")), lists[0]).otherwise(lists[1])
    return F.when(base.isNull(), F.array().cast("array<string>")).when(known, F.array(base)).otherwise(probed)


KEYS = ("file_id", "path", "ord", "module", "line", "kind")


def _relative(imports: DataFrame) -> DataFrame:
    return imports.where(F.col("kind").isin("es_import", "common_js_require") & F.rlike("module", F.lit(r"^\.\.?/")))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports with resolved_path and resolved_file_id, stale values replaced.

    Only es_import and common_js_require starting with ./ or ../ resolve; a path above the root does not. The first candidate that
    exists wins: an equi-join on the candidates and one aggregation per import.
    """
    plain = imports.select(*KEYS)
    probes = _relative(plain).select("file_id", "ord", "line", F.posexplode(candidates(F.col("path"), F.col("module"))).alias("rank", "target"))
    known = files.select(F.col("path").alias("target"), F.col("file_id").alias("target_id")).groupBy("target").agg(F.min("target_id").alias("target_id"))
    best = probes.join(known, "target").groupBy("file_id", "ord", "line").agg(F.min(F.struct("rank", "target", "target_id")).alias("hit"))
    return plain.join(best, ["file_id", "ord", "line"], "left").select(*KEYS, F.col("hit.target").alias("resolved_path"), F.col("hit.target_id").alias("resolved_file_id"))


def resolve_again(imports: DataFrame, files: DataFrame, touched: DataFrame, changed: DataFrame) -> DataFrame:
    """Imports after a change: those that may mean one of the `touched` paths, and those of `changed` files, are resolved anew."""
    rows = _relative(imports)
    hit = rows.select("file_id", F.explode(candidates(F.col("path"), F.col("module"))).alias("target")).join(touched.withColumnRenamed("path", "target"), "target", "left_semi")
    again = checked_broadcast(cut(hit.select("file_id").union(changed.select("file_id")).distinct()))  # used twice below
    rest = imports.join(again, "file_id", "left_anti")
    return rest.select(*imports.columns).unionByName(resolve_imports(imports.join(again, "file_id", "left_semi"), files).select(*imports.columns))


def edges(imports: DataFrame) -> DataFrame:
    """(src_id, dst_id), distinct."""
    return imports.where(F.col("resolved_file_id").isNotNull()).select(F.col("file_id").alias("src_id"), F.col("resolved_file_id").alias("dst_id")).distinct()


def deps(imports: DataFrame, path: str) -> DataFrame:
    """Imports of one file in order."""
    return imports.where(F.col("path") == path).orderBy("ord")


def rdeps(edge_rows: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """(file_id, path) of files that import a file directly, by id; none for an unknown path."""
    target = files.where(F.col("path") == path).select(F.col("file_id").alias("dst_id"))
    sources = edge_rows.join(F.broadcast(target.limit(1)), "dst_id").select(F.col("src_id").alias("file_id")).distinct()
    return files.select("file_id", "path").join(sources, "file_id").orderBy("file_id")


def adjacency(edge_rows: DataFrame, reverse: bool = False, block: int = 1 << 16) -> DataFrame:
    """(file_id, block, neighbours) of files with any, sorted; blocks of neighbours bound each array, however many files import one."""
    a, b = ("dst_id", "src_id") if reverse else ("src_id", "dst_id")
    return edge_rows.groupBy(F.col(a).alias("file_id"), F.floor(F.col(b) / block).alias("block")).agg(F.sort_array(F.collect_set(b)).alias("neighbours"))


def format_imports(imports: DataFrame) -> DataFrame:
    """`path:line kind module -> target` of each import, without the arrow where it has no target."""
    target = F.when(F.col("resolved_path").isNotNull(), F.concat(F.lit(" -> "), F.col("resolved_path"))).otherwise("")
    return imports.select(F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(" "), F.col("kind"), F.lit(" "), F.col("module"), target).alias("value"))
