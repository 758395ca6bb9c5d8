"""Guarded line edits: as column expressions over texts, and atomically on files of the driver."""

from __future__ import annotations

import fcntl
import hashlib
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.policy import resolve_in_root, sensitive_name

STATE_DIR = ".srcatlas"


class EditError(ValueError):
    """A refused edit; kind is range, hash, sensitive, state, encoding or content."""

    def __init__(self, kind: str) -> None:
        super().__init__(kind)
        self.kind = kind


def edited(text: str, op: str, start: int, end: int | None = None, content: str = "") -> str:
    """The text after replacing or deleting lines start..end, or inserting before line start.

    end defaults to start. Inserted text that is not terminated gets a line end if a line follows; appending behind an
    unterminated last line first ends it. Line ends stay CRLF where the text has any.
    """
    crlf = "\r\n" in text
    parts = text.split("\n")
    lines = [x + "\n" for x in parts[:-1]] + ([parts[-1]] if parts[-1] else [])
    n = len(lines)
    end = start if end is None else end
    if op == "insert":
        if not 1 <= start <= n + 1:
            raise EditError("range")
        before, after = lines[: start - 1], lines[start - 1 :]
    elif op in ("replace", "delete"):
        if not 1 <= start <= end <= n:
            raise EditError("range")
        before, after = lines[: start - 1], lines[end:]
    else:
        raise EditError("range")
    new = "" if op == "delete" else content.replace("\r\n", "\n")
    if crlf:
        new = new.replace("\n", "\r\n")
    eol = "\r\n" if crlf else "\n"
    if new and after and not new.endswith("\n"):
        new += eol
    if new and before and not before[-1].endswith("\n"):
        before[-1] += eol
    return "".join(before) + new + "".join(after)


def edit_column(files: DataFrame, op: str, start: int, end: int | None = None, content: str = "") -> DataFrame:
    """(file_id, path, text) after the same edit of every file whose lines reach that far, natively; LF texts."""
    stop = start if end is None else end
    parts = F.split("text", "\n", -1)
    lines = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    unended = F.element_at(parts, -1) != ""
    rows = files.select("file_id", "path", "text", lines.alias("l"), unended.alias("u")).where(F.size("l") >= (start - 1 if op == "insert" else stop))
    new = content.removesuffix("\n").split("\n") if op != "delete" and content else []
    before = F.slice("l", 1, start - 1) if start > 1 else F.array().cast("array<string>")
    skip = start - 1 if op == "insert" else stop
    after = F.slice("l", skip + 1, F.greatest(F.size("l") - skip, F.lit(0)))
    body = F.array_join(F.concat(before, F.array(*map(F.lit, new)).cast("array<string>"), after), "\n")
    # ended like the text if its last line is kept, else like the content
    kept_last = F.size("l") > skip
    ended = F.when(kept_last, ~F.col("u")).otherwise(F.lit(content.endswith("\n") if new else True))
    size = F.size("l") - (0 if op == "insert" else stop - start + 1) + len(new)
    return rows.select("file_id", "path", F.when((size > 0) & ended, F.concat(body, F.lit("\n"))).otherwise(body).alias("text"))


def content_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def edit_file(root: str, path: str, op: str, start: int, expected_hash: str, end: int | None = None, content: str = "") -> dict:
    """Edit one file under a lock per root; the hash must be the file's, which is replaced atomically and keeps its mode."""
    full = resolve_in_root(root, path)
    if path.replace("\\", "/").split("/")[0] == STATE_DIR:
        raise EditError("state")
    if sensitive_name(path):
        raise EditError("sensitive")
    os.makedirs(os.path.join(root, STATE_DIR), exist_ok=True)
    with open(os.path.join(root, STATE_DIR, "edit.lock"), "a") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        with open(full, "rb") as f:
            data = f.read()
        if content_hash(data) != expected_hash:
            raise EditError("hash")
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            raise EditError("encoding") from None
        new = edited(text, op, start, end, content).encode("utf-8")
        if os.path.basename(full) == ".srcatlasrc.toml":
            from srcatlas.sources.config import parse_config

            try:
                parse_config(new.decode("utf-8"))
            except ValueError:
                raise EditError("content") from None
        write_atomically(full, new)
        return {"path": path, "hash": content_hash(new), "bytes": len(new)}


def write_atomically(path: str, data: bytes) -> None:
    """A temporary sibling with the same mode, flushed to disk, takes the file's place."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".tmp-")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if os.path.exists(path):
            os.chmod(temporary, os.stat(path).st_mode & 0o7777)
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise
