"""Leveled reads of a file: normal, compact and aggressive, with ranges and byte caps, as (ord, line_no, text)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.functions.policy import is_sensitive, is_unsafe, parse_line_range
from srcatlas.functions.text import split_lines

# What begins an import-like and a structural line.
IMPORT_LIKE = ("use ", "mod ", "import ", "from ", "include ", "#include", "require", "package ", "module ")
STRUCTURAL = ("fn ", "pub fn ", "def ", "class ", "struct ", "enum ", "interface ", "type ", "impl ", "trait ", "function ", "export function ")
#: Languages that reads can parse; others fall back to plain rules.
READ_PARSERS = {
    "rs": "tree-sitter-rust", **dict.fromkeys(("js", "mjs", "cjs"), "tree-sitter-javascript"), **dict.fromkeys(("ts", "mts", "cts"), "tree-sitter-typescript"),
    **dict.fromkeys(("tsx", "jsx"), "tree-sitter-tsx"), **dict.fromkeys(("py", "pyw"), "tree-sitter-python"),
}
COMPACT_LINES, AGGRESSIVE_LINES, HEAD_LINES = 20, 120, 40
STRUCTURE_KINDS = ("function", "method", "class", "struct", "enum", "interface", "trait", "impl", "type", "const", "module")


class ReadError(ValueError):
    """A refused read; kind is unsafe, sensitive, binary, hash or missing."""

    def __init__(self, kind: str) -> None:
        super().__init__(kind)
        self.kind = kind


def _starts(c: Column, beginnings: tuple[str, ...]) -> Column:
    return F.rlike(F.ltrim(c), F.lit("^(?:" + "|".join(map(re.escape, beginnings)) + ")"))


def import_like(c: Column) -> Column:
    return _starts(c, IMPORT_LIKE)


def structural(c: Column) -> Column:
    return _starts(c, IMPORT_LIKE + STRUCTURAL)


def guarded(files: DataFrame, path: str, expected_hash: str | None = None) -> DataFrame:
    """The one file of a path, after the checks: safe and not sensitive path, no NUL in the text, the expected hash."""
    row = files.where(F.col("path") == path)
    hash_ = F.col("hash") if "hash" in files.columns else F.sha2("text", 256)
    checked = row.select(is_unsafe(F.col("path")).alias("unsafe"), is_sensitive(F.col("path")).alias("sensitive"), F.contains(F.substring("text", 1, 8192), F.lit("\x00")).alias("binary"), hash_.alias("hash")).head()
    if checked is None:
        raise ReadError("missing")
    for kind in ("unsafe", "sensitive", "binary"):
        if checked[kind]:
            raise ReadError(kind)
    if expected_hash is not None and checked["hash"] != expected_hash:
        raise ReadError("hash")
    return row


def capped(text: Column, max_bytes: int | None) -> Column:
    """The text cut after max_bytes bytes, before it is split; a character cut in two becomes a replacement character."""
    if max_bytes is None:
        return text
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, max_bytes).cast("string")))


def numbered(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """(file_id, path, ext, line_no, text) of every line."""
    have = files if "ext" in files.columns else files.withColumn("ext", F.lower(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1)))
    rows = have.select("file_id", "path", "ext", F.posexplode(split_lines(capped(F.col("text"), max_bytes))).alias("n", "text"))
    return rows.select("file_id", "path", "ext", (F.col("n") + 1).cast("bigint").alias("line_no"), "text")


def within(lines: DataFrame, line_range: str | None) -> DataFrame:
    """Only the lines of a range; notices, which have no number, stay until the first numbered line beyond its end."""
    if line_range is None:
        return lines
    first, last = parse_line_range(line_range)
    numbers = F.col("line_no")
    if "ord" not in lines.columns:
        return lines.where(numbers.between(first, last))
    beyond = lines.where(numbers > last).groupBy("file_id").agg(F.min("ord").alias("_stop"))
    joined = lines.join(beyond, "file_id", "left")
    notice = numbers.isNull() & (F.col("_stop").isNull() | (F.col("ord") < F.col("_stop")))
    return joined.where(numbers.between(first, last) | notice).drop("_stop")


def read_normal(files: DataFrame, line_range: str | None = None, max_bytes: int | None = None) -> DataFrame:
    rows = numbered(files, max_bytes).select("file_id", "path", F.col("line_no").alias("ord"), "line_no", "text")
    return within(rows, line_range)


def _parsed(files: DataFrame) -> Column:
    return F.col("ext").isin(*READ_PARSERS)


def read_compact(files: DataFrame, symbols: DataFrame, line_range: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """Long function bodies are left out behind a notice; files without a parser show their head and structural lines.

    Lines are joined to the omitted spans of their own file (an equi-join with a range condition), never across files.
    """
    lines = numbered(files, max_bytes)
    spans = symbols.where(F.col("kind").isin("function", "method") & F.col("signature_end_line").isNotNull() & (F.col("end_line") - F.col("line") + 1 > COMPACT_LINES) & (F.col("end_line") > F.col("signature_end_line")))
    spans = spans.select("file_id", F.col("signature_end_line").alias("a"), F.col("end_line").alias("b"))
    # a span inside another one is hidden by it
    outer = Window.partitionBy("file_id").orderBy("a", F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.distinct().withColumn("before", F.max("b").over(outer)).where(F.col("before").isNull() | (F.col("a") >= F.col("before"))).drop("before")
    parsed = lines.where(_parsed(lines))
    hidden = parsed.join(spans, "file_id").where((F.col("line_no") > F.col("a")) & (F.col("line_no") <= F.col("b"))).select("file_id", "line_no")
    shown = parsed.join(hidden, ["file_id", "line_no"], "left_anti").select("file_id", "path", (F.col("line_no") * 2).alias("ord"), "line_no", "text")
    indent = F.regexp_extract("text", r"^(\s*)", 1)
    heads = parsed.join(spans, (parsed["file_id"] == spans["file_id"]) & (parsed["line_no"] == spans["a"])).select(
        parsed["file_id"], "path", (F.col("line_no") * 2 + 1).alias("ord"), F.lit(None).cast("bigint").alias("line_no"),
        F.concat(indent, F.lit("    ... body omitted ("), (F.col("b") - F.col("a")).cast("string"), F.lit(" lines)")).alias("text"),
    )
    fallback = _fallback(lines.where(~_parsed(lines)), HEAD_LINES)
    return within(shown.unionByName(heads).unionByName(fallback), line_range).orderBy("file_id", "ord")


def _fallback(lines: DataFrame, head: int) -> DataFrame:
    """A notice, the head and the structural lines, with a notice wherever lines are left out."""
    kept = lines.where((F.col("line_no") <= head) | structural(F.col("text")))
    before = F.coalesce(F.lag("line_no").over(Window.partitionBy("file_id").orderBy("line_no")), F.lit(0))
    marked = kept.withColumn("gap", F.col("line_no") - before - 1)
    rows = marked.select("file_id", "path", (F.col("line_no") * 2).alias("ord"), "line_no", "text")
    gaps = marked.where(F.col("gap") > 0).select("file_id", "path", (F.col("line_no") * 2 - 1).alias("ord"), F.lit(None).cast("bigint").alias("line_no"), F.concat(F.lit("... "), F.col("gap").cast("string"), F.lit(" lines omitted")).alias("text"))
    notice = lines.groupBy("file_id", "path").agg(F.lit(0).cast("bigint").alias("ord")).select("file_id", "path", "ord", F.lit(None).cast("bigint").alias("line_no"), F.lit("... no parser for this language, showing structural lines").alias("text"))
    return rows.unionByName(gaps).unionByName(notice)


def read_aggressive(files: DataFrame, symbols: DataFrame, line_range: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """Import-like lines and the first lines of declarations, cut at the first {; at most AGGRESSIVE_LINES of them, after the range."""
    lines = numbered(files, max_bytes)
    firsts = symbols.where(F.col("kind").isin(*STRUCTURE_KINDS)).select("file_id", F.col("line").alias("line_no")).distinct()
    parsed = lines.where(_parsed(lines))
    wanted = parsed.where(import_like(F.col("text"))).select("file_id", "line_no").union(firsts).distinct()
    cut = F.when(import_like(F.col("text")), F.col("text")).otherwise(F.rtrim(F.regexp_extract("text", r"^([^{]*)", 1)))
    rows = parsed.join(wanted, ["file_id", "line_no"], "left_semi").select("file_id", "path", (F.col("line_no") * 2).alias("ord"), "line_no", cut.alias("text"))
    rest = lines.where(~_parsed(lines))
    fallback = rest.where(structural(F.col("text"))).select("file_id", "path", (F.col("line_no") * 2).alias("ord"), "line_no", "text")
    ranged = within(rows.unionByName(fallback), line_range)
    ranked = ranged.withColumn("r", F.row_number().over(Window.partitionBy("file_id").orderBy("ord")))
    shown = ranked.where(F.col("r") <= AGGRESSIVE_LINES).drop("r")
    over = ranked.where(F.col("r") == AGGRESSIVE_LINES + 1).select("file_id", "path", "ord", F.lit(None).cast("bigint").alias("line_no"), F.lit(f"... cut after {AGGRESSIVE_LINES} lines").alias("text"))
    notice = rest.groupBy("file_id", "path").agg(F.lit(0).cast("bigint").alias("ord")).select("file_id", "path", "ord", F.lit(None).cast("bigint").alias("line_no"), F.lit("... no parser for this language, showing structural lines").alias("text"))
    return shown.unionByName(over).unionByName(notice).orderBy("file_id", "ord")


def format_lines(rows: DataFrame) -> DataFrame:
    """`N: text`, notices without a number."""
    return rows.orderBy("file_id", "ord").select(F.concat(F.coalesce(F.concat(F.col("line_no").cast("string"), F.lit(": ")), F.lit("")), F.col("text")).alias("value"))
