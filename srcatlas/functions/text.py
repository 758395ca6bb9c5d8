"""Lines, words, trigrams and offsets of texts as native column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_lines(text: Column) -> Column:
    """Lines without their ends: one \\r before \\n goes too, a final line end opens no line, '' has none."""
    parts = F.split(text, "\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(text: Column) -> Column:
    return F.size(split_lines(text)).cast("bigint")


@F.arrow_udf(returnType=ArrayType(LongType()))
def _line_starts(texts: pa.Array) -> pa.Array:
    """Line starts of a whole batch from one look for line ends over its bytes: linear, where a native fold would copy its array for every line."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]] if len(texts) else np.empty(0, np.uint8)
    begin, end = bounds[:-1] - bounds[0], bounds[1:] - bounds[0]
    starts = np.flatnonzero(data == 10) + 1
    row = np.searchsorted(end, starts, "left")  # the text a line end belongs to; an empty text ends where it begins
    inner = starts < end[row] if len(row) else np.empty(0, bool)
    starts, row = starts[inner], row[inner]
    n = np.bincount(row, minlength=len(texts)) + 1
    offsets = np.r_[0, np.cumsum(n)]
    values = np.zeros(offsets[-1], np.int64)
    rest = np.ones(offsets[-1], bool)
    rest[offsets[:-1]] = False
    values[rest] = starts - begin[row]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values), mask=texts.is_null())


def line_offsets(text: Column) -> Column:
    """Byte offsets of line starts; always begins with 0, a final line end adds none; null for a null text."""
    return _line_starts(text)


def trim_unicode(c: Column) -> Column:
    """Without white space, in Unicode's sense, at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def word_terms(text: Column) -> Column:
    """Distinct ASCII-lower words [A-Za-z0-9_] of two and more characters."""
    return F.array_distinct(F.transform(F.filter(F.split(text, "[^A-Za-z0-9_]+"), lambda w: F.length(w) > 1), lambda w: F.lower(w)))


def trigram_terms(text: Column) -> Column:
    """Distinct windows of three printable ASCII characters of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?=([\x20-\x7e]{3}))"), F.lit(1)))


def estimate_tokens(size: Column) -> Column:
    """Four bytes a token."""
    return F.floor(size / 4).cast("bigint")


def utc_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
