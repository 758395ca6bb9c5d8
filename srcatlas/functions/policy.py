"""Which paths are eligible: hidden, generated and sensitive names, size, binary content, path safety. Native and plain forms."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders never indexed, and names that hold secrets.
GENERATED_DIRS = (".git", ".srcatlas", "node_modules", "target", "dist", "build", ".next", ".cache", ".venv", "__pycache__")
SENSITIVE = r"^(?:\.env|\.env\..*|.*\.pem|.*\.key|id_rsa|id_ed25519|credentials.*|secrets.*)$"
SNIFFED_BYTES = 8192
DEFAULT_MAX_BYTES = 1 << 20


def _parts(path: Column) -> Column:
    return F.split(path, r"[/\\]")


def is_hidden(path: Column) -> Column:
    return F.exists(_parts(path), lambda c: c.startswith(".") & ~c.isin(".", ".."))


def in_generated_dir(path: Column) -> Column:
    return F.exists(_parts(path), lambda c: F.lower(c).isin(*GENERATED_DIRS))


def is_sensitive(path: Column) -> Column:
    return F.exists(_parts(path), lambda c: F.lower(c).rlike(SENSITIVE))


def is_unsafe(path: Column) -> Column:
    """Climbing, empty inner parts, absolute or drive paths."""
    parts = _parts(path)
    return path.rlike(r"^[A-Za-z]:") | path.rlike(r"^[/\\]") | F.exists(parts, lambda c: (c == "..") | (c == ""))


def looks_binary(content: Column) -> Column:
    """A NUL among the first bytes."""
    return F.instr(F.decode(F.substring(content, 1, SNIFFED_BYTES), "ISO-8859-1"), "\x00") > 0


def eligible(path: Column, size: Column, max_bytes: int = DEFAULT_MAX_BYTES, allow_sensitive: bool = False, include_hidden: bool = False) -> Column:
    """Indexed or not; an unknown size is kept."""
    ok = ~in_generated_dir(path) & (size.isNull() | (size <= max_bytes))
    if not include_hidden:
        ok &= ~is_hidden(path)
    if not allow_sensitive:
        ok &= ~is_sensitive(path)
    return ok


def sensitive_name(path: str) -> bool:
    return any(re.match(SENSITIVE, p.lower()) for p in re.split(r"[/\\]", path))


def generated_name(path: str) -> bool:
    return any(p.lower() in GENERATED_DIRS for p in path.split("/"))


def hidden_name(path: str) -> bool:
    return any(p.startswith(".") and p not in (".", "..") for p in path.split("/"))


def parse_size(text: str) -> int:
    """Bytes of a literal such as 512, 64kb, 2MB or 10b; ValueError otherwise."""
    m = re.fullmatch(r"\s*(\d+)\s*(kb|mb|b|)\s*", text.lower())
    if not m:
        raise ValueError(f"no size: {text!r}")
    size = int(m.group(1)) * {"kb": 1 << 10, "mb": 1 << 20, "b": 1, "": 1}[m.group(2)]
    if size >= 1 << 63:
        raise ValueError(f"size too large: {text!r}")
    return size


def size_literal(c: Column) -> Column:
    """parse_size over a column; null where it is no size."""
    t = F.lower(F.trim(c))
    n = F.regexp_extract(t, r"^(\d+)\s*(kb|mb|b|)$", 1)
    unit = F.regexp_extract(t, r"^(\d+)\s*(kb|mb|b|)$", 2)
    return n.try_cast("bigint") * F.when(unit == "kb", 1 << 10).when(unit == "mb", 1 << 20).otherwise(1)


def parse_line_range(text: str) -> tuple[int, int]:
    """`a-b` or `a`, counted from 1; ValueError otherwise."""
    m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", text)
    if not m or int(m.group(1)) < 1 or m.group(2) is not None and int(m.group(2)) < int(m.group(1)):
        raise ValueError(f"no line range: {text!r}")
    return int(m.group(1)), int(m.group(2) or m.group(1))


def resolve_in_root(root: str, path: str) -> str:
    """The real path of a relative path, which must stay in the root."""
    if re.match(r"^[A-Za-z]:|^[/\\]", path) or any(p in ("", "..") for p in re.split(r"[/\\]", path)):
        raise PermissionError(f"unsafe path: {path!r}")
    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, *re.split(r"[/\\]", path)))
    if os.path.commonpath([base, full]) != base:
        raise PermissionError(f"outside the root: {path!r}")
    return full
