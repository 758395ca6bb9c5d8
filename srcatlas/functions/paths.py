"""Path expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings a module path may carry itself, in probing order (fixed values).
MODULE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mts", "cts", "mjs", "cjs")


def canonical_path(path: Column) -> Column:
    """Slashes for backslashes, no doubled separators, no leading ./; null stays null."""
    slashed = F.regexp_replace(F.translate(path, "\\", "/"), "/{2,}", "/")
    return F.regexp_replace(slashed, r"^(\./)+", "")


def parent_dir(path: Column) -> Column:
    """The folder part of a canonical path, '' at the root."""
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def resolve_dots(path: Column) -> Column:
    """Fold . and .. segments; null if the path climbs above its root."""
    up = F.lit("<up>")
    folded = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "") | (x == "."), acc)
        .when(
            x == "..",
            F.when((F.size(acc) == 0) | F.array_contains(acc, up), F.concat(acc, F.array(up))).otherwise(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))),
        )
        .otherwise(F.concat(acc, F.array(x))),
    )
    return F.when(~F.array_contains(folded, up), F.array_join(folded, "/"))


def module_targets(importer_dir: Column, module: Column) -> Column:
    """All paths a relative module may stand for, best first; an empty array if it leaves the root."""
    base = resolve_dots(F.concat_ws("/", importer_dir, module))
    known = F.rlike(base, F.lit(r"\.(%s)$" % "|".join(MODULE_EXTENSIONS)))
    tried = F.array(base, *[F.concat(base, F.lit("." + e)) for e in MODULE_EXTENSIONS], *[F.concat(base, F.lit("/index." + e)) for e in MODULE_EXTENSIONS])
    return F.when(base.isNull(), F.array().cast("array<string>")).when(known, F.array(base)).otherwise(tried)
