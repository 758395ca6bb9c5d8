"""Literal, case-insensitive line search, with and without the trigram index, and word lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.text import ascii_lower, split_lines, trim_unicode
from srcatlas.plans.runtime import checked_broadcast


#: Candidate files up to which they are named in the plan instead of joined.
FEW_CANDIDATES = 1000


def query_trigrams(query: str) -> list[str]:
    q = query.lower()
    return sorted({q[i : i + 3] for i in range(len(q) - 2) if all(" " <= c <= "~" for c in q[i : i + 3])})


def candidate_files(query: str, trigrams: DataFrame) -> DataFrame | None:
    """(file_id) of files that hold all of the query's trigrams, a superset of the hits; None if the query has none: all files."""
    wanted = query_trigrams(query)
    if not wanted:
        return None
    return trigrams.where(F.col("term").isin(*wanted)).groupBy("file_id").agg(F.countDistinct("term").alias("n")).where(F.col("n") == len(wanted)).select("file_id")


def search(files: DataFrame, query: str, limit: int | None = 20, trigrams: DataFrame | None = None) -> DataFrame:
    """(file_id, path, line, text): lines that contain the query, by file then line; at most `limit`.

    Case does not matter, in Unicode's sense; a line counts once; the text is trimmed. An empty query matches every line, one with a
    line end none, a limit of 0 none. Files that are not valid UTF-8, if is_utf8 tells, are passed over. With a persisted
    trigram table only candidate files are read.
    """
    rows = files.where(F.col("is_utf8")) if "is_utf8" in files.columns else files
    rows = rows.where(F.col("text").isNotNull()).select("file_id", "path", "text")
    if limit == 0 or "\n" in query:
        return rows.select("file_id", "path", F.lit(0).cast("bigint").alias("line"), "text").limit(0)
    candidates = candidate_files(query, trigrams) if trigrams is not None else None
    if candidates is not None:
        some = candidates.limit(FEW_CANDIDATES + 1).collect()
        if len(some) <= FEW_CANDIDATES:  # a filter that reaches the scan: saved files lie in the order of their ids
            rows = rows.where(F.col("file_id").isin(*[r["file_id"] for r in some]) if some else F.lit(False))
        else:
            rows = rows.join(checked_broadcast(candidates), "file_id", "left_semi")
    needle = F.lit(query.lower())
    # whole texts without the query are dropped before they are split into lines
    hits = (
        rows.where(F.contains(F.lower("text"), needle) | F.lit(query == ""))
        .select("file_id", "path", F.posexplode(split_lines(F.col("text"))).alias("n", "line_text"))
        .where(F.contains(F.lower("line_text"), needle))
        .select("file_id", "path", (F.col("n") + 1).cast("bigint").alias("line"), trim_unicode(F.col("line_text")).alias("text"))
    )
    ordered = hits.orderBy("file_id", "line")
    return ordered if limit is None else ordered.limit(limit)


def word(files: DataFrame, words: DataFrame, term: str, limit: int | None = 20) -> DataFrame:
    """(file_id, path) of files with the word, by id; the word is taken as it is, in ASCII lower case."""
    hits = words.where(F.col("term") == ascii_lower(F.lit(term))).select("file_id").distinct().orderBy("file_id")
    if limit is not None:
        hits = hits.limit(limit)
    return files.select("file_id", "path").join(hits, "file_id", "left_semi").orderBy("file_id")


def format_hits(hits: DataFrame) -> DataFrame:
    """`path:line: text` of each hit."""
    return hits.select(F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(": "), F.col("text")).alias("value"))
