"""Generated, minified or vendored source files (problem 4): belief propagation over directory trees.

Every file gives evidence for the labels handwritten, generated, minified, vendored and blob, every folder's name too. Folders carry
the same labels; compatibilities say which labels a folder's files and subfolders have. Messages go up the tree level by level and
down again, so that a file without marks of its own is judged by its folder and siblings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.plans.runtime import cut, salted_join, spread

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
#: P(label of a child | label of its folder), rows by folder.
COMPATIBLE = (
    (0.820, 0.040, 0.030, 0.085, 0.025),
    (0.060, 0.900, 0.010, 0.010, 0.020),
    (0.300, 0.050, 0.600, 0.025, 0.025),
    (0.030, 0.010, 0.010, 0.940, 0.010),
    (0.400, 0.050, 0.025, 0.025, 0.500),
)
#: Log odds of a top folder's labels, and what names of folders add.
ROOT = (0.0, -7.0, -7.0, -8.0, -7.0)
#: Log odds of a file without any mark: generated, minified and blob files are hardly ever unmarked, vendored ones often.
UNMARKED = (0.0, -5.0, -8.0, -0.7, -7.0)
FOLDER_NAMES = (
    (re.compile(r"(?i)^(?:vendor|vendored|third[_\-]?party|node_modules|bower_components|external|externals|extern|contrib|deps|subprojects|jspm_packages)$"), 3, 14.0),
    (re.compile(r"(?i)^(?:vendors|dependencies|imported|libs)$"), 3, 0.5),
    (re.compile(r"^[A-Za-z][\w\-]*?[-_@]v?\d+[._]\d+(?:[._]\d+)*$"), 3, 3.0),
    (re.compile(r"(?i)^(?:gen|generated|__generated__|autogen|auto_generated|_generated|pb)$"), 1, 7.0),
    (re.compile(r"(?i)^(?:min|minified)$"), 2, 3.0),
    (re.compile(r"(?i)^(?:blobs?|weights)$"), 4, 1.0),
)
#: Below it the evidence for vendored marks configuration.
NO_CODE = -10.0
#: A file found in so many repos counts as copied.
COPY_REPOS, COPY_ODDS = 2, 5.0

_CODE = frozenset("py pyw js mjs cjs jsx ts mts cts tsx rs go java c h cc cpp hpp cs rb php kt swift scala css".split())
_COMMENT = re.compile(r"^\s*(?://+!?|#+|/\*+!?|\*+|<!--|--|;+)\s?(.*?)\s*(?:\*/|-->)?\s*$")
_BLOCKS = (("/*", "*/"), ("<!--", "-->"), ("=begin", "=end"))
_INNER = re.compile(r"^\s*\**\s?(.*?)\s*$")
_TOOL = re.compile(
    r"(?i)^(?:code generated by \S+|this (?:file|code) (?:was|is|has been) (?:auto[- ]?)?(?:matically )?generated\b|auto-?generated\b|@generated\b|<auto-?generated\b|do not (?:edit|modify)[!.]? *(?:re)?generate\b|automatically (?:created|generated|produced) (?:on|by|from)\b"
    r"|automatisch (?:erzeugt|generiert)\b|generated (?:by|from|on) \S+|g[eé]n[eé]r[eé] automatiquement|generado autom[aá]ticamente|machine[- ]generated\b|\S+ v?\d+(?:\.\d+)+ output, \S+ digest\b)"
)
_TOOL_LINE = re.compile(r"(?m)^\s*(?://|#|\*)\s*(?:source|@@protoc_insertion_point|origin): ?\S+:\d+\s*$")
_UPSTREAM = re.compile(
    r"(?i)^(?:[\w\-@/.]+ v?\d+\.\d+(?:\.\d+)?(?: (?:-|–|\|) https?://\S+)?$|copyright (?:\(c\) |©)?(?:\d{4}[-, \d]* )?(?:the )?\S+ contributors\b|imported from upstream\b|upstream: ?\S+|vendored from\b|redistribution in (?:source|binary)\b.*\bupstream\b|originally from \S+://|taken from \S+ v?\d+\.\d+)"
)
_OWN = re.compile(r"(?i)licen[cs]e file of this project|rewritten (?:here )?by hand|hand-?written|maintained by hand")
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'')
_NUMERIC = re.compile(r"[-+\d.,\s\[\]{}eExX]+")
_BASE64 = re.compile(r"""["'`][A-Za-z0-9+/=_\-]{24,}["'`]""")
_SHAPE = re.compile(r"[A-Za-z_$][\w$]*")
_NUMBERED = re.compile(r"[A-Za-z_]\d+\b")
_GEN_NAME = re.compile(r"(?i)(?:\.gen|\.generated|_generated|\.g|_pb2?(?:_grpc)?|\.pb|\.designer|zz_generated\.\w+|\.auto)\.\w+$")
_LOCK_NAME = re.compile(r"(?i)(?:^|[-_.])lock\.(?:json|ya?ml|toml)$|-lock\.\w+$|\.lock$|npm-shrinkwrap\.json$")
_MIN_NAME = re.compile(r"(?i)[.\-]min\.\w+$|(?:^|[.\-_])(?:bundle|chunk|app|vendor|main)[.\-]\S*[0-9a-f]{6,}\.\w+$")


def head_comments(lines: list[str]) -> Iterator[str]:
    """What each line of the leading run of comments says, lines inside block comments included, however long it is."""
    close = ""
    for line in lines:
        if close:
            said, end, rest = line.partition(close)
            yield _INNER.match(said).group(1)
            if end and rest.strip():
                return
            close = "" if end else close
            continue
        bare = line.strip()
        start, close = next((b for b in _BLOCKS if bare.startswith(b[0])), ("", ""))
        m = _COMMENT.match(line)
        if not m and not close:
            return
        yield m.group(1) if m else bare[len(start) :].strip()
        if close in bare[len(start) :]:
            close = ""


def file_evidence(path: str | None, ext: str | None, text: str | None) -> list[float]:
    """Log potentials of a file's own labels, handwritten being 0."""
    e = list(UNMARKED)
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1]
    if _GEN_NAME.search(name):
        e[1] += 2.5
    if _LOCK_NAME.search(name):
        e[1] += 2.5
    if not text:
        return e
    text = text.replace("\r\n", "\n")
    code = (ext or "").lower() in _CODE
    lines = [x for x in text.split("\n") if x.strip()]
    tool = upstream = own = False
    for said in head_comments(lines):
        tool |= bool(_TOOL.match(said))
        upstream |= bool(_UPSTREAM.match(said))
        own |= bool(_OWN.search(said))
    if tool:
        e[1] += 14.0
    if upstream and code:
        e[3] += 9.0
    if own:
        e[1], e[2], e[3] = e[1] - 3, e[2] - 3, e[3] - 3
    if len(_TOOL_LINE.findall(text)) >= 2:
        e[1] += 9.0
    size = len(text)
    if size > 400:
        numeric = 1 - len(_NUMERIC.sub("", text)) / size
        base64 = sum(map(len, _BASE64.findall(text))) / size
        if numeric > 0.75 or base64 > 0.55:
            e[4] += 14.0
        elif numeric > 0.62 or base64 > 0.4:
            e[4] += 9.0
    if not code:
        if re.match(r'\s*\{\s*"(?:lockfileVersion|lockVersion|_resolved)"', text) or text.count('"integrity"') >= 3 and '"version"' in text:
            e[1] += 14.0
        e[2], e[3] = e[2] - 12, e[3] - 12  # configuration is not minified or vendored code
        return e
    bare = _STRING.sub('""', text)
    longest = max(map(len, bare.split("\n")))
    if longest > 200 and size > 300:
        spaces = bare.count(" ") / len(bare)
        e[2] += 14.0 if longest > 400 or spaces < 0.08 else 8.0
        if "sourceMappingURL=" in text:
            e[2] += 2.0
    if _MIN_NAME.search(name):
        e[2] += 1.0
    if len(lines) >= 16:
        shapes = {_SHAPE.sub("a", re.sub(r"\d+", "0", x.strip())) for x in lines}
        same = 1 - len(shapes) / len(lines)
        numbered = sum(bool(_NUMBERED.search(x)) for x in lines) / len(lines)
        if same > 0.85 and numbered > 0.2 and e[4] < 0:
            e[1] += 10.0
        elif same > 0.85:
            e[1] += 3.0
    return e


def body_key(text: str | None) -> int | None:
    """A key of the text without comments at its head, blanks and line ends; None if little remains."""
    if not text:
        return None
    lines = text.replace("\r\n", "\n").split("\n")
    at = 0
    while at < len(lines) and (not lines[at].strip() or _COMMENT.match(lines[at]) and not lines[at].lstrip().startswith(("#include", "#[", "#define"))):
        at += 1
    body = "\n".join(x.strip() for x in lines[at:] if x.strip())
    data = body.encode("utf-8", "replace")
    return (crc32(data) << 31 | crc32(data[::-1]) >> 1) if len(body) > 200 else None


def folder_evidence(name: str | None) -> list[float]:
    e = [0.0] * 5
    for pattern, label, odds in FOLDER_NAMES:
        if name and pattern.match(name):
            e[label] += odds
    return e


_FILE_SCHEMA = "file_id bigint, repo string, folder string, body bigint, e0 double, e1 double, e2 double, e3 double, e4 double"
_COLUMNS = [f"e{i}" for i in range(5)]


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, repos, paths, exts, texts = (batch.column(c) for c in ("file_id", "repo", "path", "ext", "text"))
        paths = [(p or "").replace("\\", "/") for p in paths.to_pylist()]
        folders = ["/" + p.rpartition("/")[0].strip("/") for p in paths]
        rows = [(file_evidence(p, e or p.rpartition(".")[2], t), body_key(t) if (e or "").lower() in _CODE else None) for p, e, t in zip(paths, exts.to_pylist(), texts.to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [ids, repos, pa.array(folders, pa.string()), pa.array([b for _, b in rows], pa.int64()), *[pa.array([e[i] for e, _ in rows], pa.float64()) for i in range(5)]],
            names=["file_id", "repo", "folder", "body", *_COLUMNS],
        )


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Name evidence of folders."""
    for batch in batches:
        rows = [folder_evidence((f or "").rpartition("/")[2]) for f in batch.column("folder").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("repo"), batch.column("folder"), *[pa.array([e[i] for e in rows], pa.float64()) for i in range(5)]], names=["repo", "folder", *_COLUMNS])


_LOG_COMPATIBLE = np.log(np.array(COMPATIBLE))


def _message(values: np.ndarray, to_child: bool) -> np.ndarray:
    """log sum over the sender's labels of its potential times the compatibility with each of the receiver's; rows by rows."""
    table = _LOG_COMPATIBLE.T if to_child else _LOG_COMPATIBLE
    return np.logaddexp.reduce(values[:, None, :] + table[None, :, :], axis=2)


def _told(e: np.ndarray) -> np.ndarray:
    """A file's message to its folder. Configuration lies in folders of every kind and says nothing about them."""
    m = _message(e, False)
    m[e[:, 3] < NO_CODE] = 0
    return m


def _matrix(batch: pa.RecordBatch, prefix: str) -> np.ndarray:
    return np.column_stack([batch.column(f"{prefix}{i}").to_numpy(zero_copy_only=False) for i in range(5)]).astype(float)


def _with(batch: pa.RecordBatch, keep: list[str], prefix: str, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(values[:, i]) for i in range(5))], names=[*keep, *(f"{prefix}{i}" for i in range(5))])


def _upwards(batches: Iterator[pa.RecordBatch], prefix: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """What files or folders (their potentials under prefix) tell the folder above."""
    for batch in batches:
        x = _matrix(batch, prefix)
        yield _with(batch, keep, "m", _told(x) if prefix == "e" else _message(x, False))


def _downwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A folder's belief d from its own u and the belief q of the folder above without what this one has told it."""
    for batch in batches:
        u, q = _matrix(batch, "u"), _matrix(batch, "q")
        cavity = q - _message(u, False)
        d = u + _message(cavity - cavity.max(axis=1, keepdims=True), True)
        yield _with(batch, ["repo", "folder"], "d", d - d.max(axis=1, keepdims=True))


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        e, d = _matrix(batch, "e"), _matrix(batch, "d")
        cavity = d - _told(e)
        belief = e + _message(cavity - cavity.max(axis=1, keepdims=True), True)
        share = np.exp(belief - np.logaddexp.reduce(belief, axis=1)[:, None]) if len(belief) else belief
        best = belief.argmax(axis=1) if len(belief) else np.empty(0, int)
        yield pa.RecordBatch.from_arrays([batch.column("file_id"), pa.array([LABELS[i] for i in best], pa.string()), pa.array(share[:, 0])], names=["file_id", "label", "p_handwritten"])


def _doubles(prefix: str) -> str:
    return ", ".join(f"{prefix}{i} double" for i in range(5))


def _parent(folder: Column) -> Column:
    return F.when(folder == "/", None).otherwise(F.coalesce(F.nullif(F.regexp_replace(folder, "/[^/]*$", ""), F.lit("")), F.lit("/")))


def file_labels(files: DataFrame) -> DataFrame:
    """(file_id, label, p_handwritten): the label with the greatest belief of every file, and the belief that it is handwritten.

    Null paths lie at their repo's root, null texts and extensions give no evidence of their own. Repeated rows give repeated
    results. Configuration files are never minified or vendored. An empty table gives an empty result.
    """
    rows = spread(files.where(F.col("file_id").isNotNull()).select("file_id", F.coalesce("repo", F.lit("")).alias("repo"), "path", "ext", "text"))
    seen = rows.mapInArrow(_observe, _FILE_SCHEMA)
    seen = cut(seen)
    # copies of one body in several repos
    copied = seen.where(F.col("body").isNotNull()).groupBy("body").agg(F.countDistinct("repo").alias("repos")).where(F.col("repos") >= COPY_REPOS).select("body", F.lit(True).alias("copied"))
    observed = salted_join(seen, copied, ["body"], "file_id", "left").withColumn("e3", F.col("e3") + F.when(F.col("copied") & (F.greatest("e1", "e2", "e4") < 0), COPY_ODDS).otherwise(0.0)).drop("copied", "body")
    # upwards: what the files tell their folders
    told = observed.select("repo", "folder", *_COLUMNS).mapInArrow(partial(_upwards, prefix="e", keep=["repo", "folder"]), "repo string, folder string, " + _doubles("m"))
    from_files = cut(told.groupBy("repo", "folder").agg(*[F.sum(f"m{i}").alias(f"s{i}") for i in range(5)], F.count(F.lit(1)).alias("n")))
    parts = F.split(F.ltrim(F.col("folder"), F.lit("/")), "/")
    ancestors = F.when(F.col("folder") == "/", F.array(F.lit("/"))).otherwise(
        F.concat(F.array(F.lit("/")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))))
    )
    folders = from_files.select("repo", F.explode(ancestors).alias("folder")).distinct().mapInArrow(_named, "repo string, folder string, " + _doubles("e"))
    zero = F.lit(0.0)
    depth = F.when(F.col("folder") == "/", 0).otherwise(F.size(F.split("folder", "/")) - 1)
    nodes = cut(
        folders.join(from_files, ["repo", "folder"], "left").select(
            "repo", "folder", _parent(F.col("folder")).alias("parent"), depth.alias("depth"), *[(F.col(f"e{i}") + F.coalesce(f"s{i}", zero) + F.when(F.col("folder") == "/", F.lit(ROOT[i])).otherwise(zero)).alias(f"u{i}") for i in range(5)]
        )
    )
    deepest = nodes.agg(F.max("depth")).head()[0]
    if deepest is None:
        return seen.select("file_id", F.lit("handwritten").alias("label"), F.lit(1.0).alias("p_handwritten"))
    up = {deepest: nodes.where(F.col("depth") == deepest)}
    for level in range(deepest - 1, -1, -1):
        below = up[level + 1].select("repo", F.col("parent").alias("folder"), *[f"u{i}" for i in range(5)]).mapInArrow(partial(_upwards, prefix="u", keep=["repo", "folder"]), "repo string, folder string, " + _doubles("m"))
        gathered = below.groupBy("repo", "folder").agg(*[F.sum(f"m{i}").alias(f"c{i}") for i in range(5)])
        up[level] = cut(nodes.where(F.col("depth") == level).join(gathered, ["repo", "folder"], "left").select("repo", "folder", "parent", "depth", *[(F.col(f"u{i}") + F.coalesce(f"c{i}", zero)).alias(f"u{i}") for i in range(5)]))
    # downwards: each folder's belief without what the receiver itself has said
    down = up[0].select("repo", "folder", *[F.col(f"u{i}").alias(f"d{i}") for i in range(5)])
    beliefs = [down]
    for level in range(1, deepest + 1):
        above = down.select("repo", F.col("folder").alias("parent"), *[F.col(f"d{i}").alias(f"q{i}") for i in range(5)])
        joined = salted_join(up[level], above, ["repo", "parent"], "folder")
        down = cut(joined.select("repo", "folder", *[f"u{i}" for i in range(5)], *[f"q{i}" for i in range(5)]).mapInArrow(_downwards, "repo string, folder string, " + _doubles("d")))
        beliefs.append(down)
    every = beliefs[0]
    for b in beliefs[1:]:
        every = every.unionByName(b)
    joined = salted_join(observed, every, ["repo", "folder"], "file_id")
    return joined.select("file_id", *_COLUMNS, *[f"d{i}" for i in range(5)]).mapInArrow(_decide, "file_id bigint, label string, p_handwritten double")


def not_handwritten(files: DataFrame) -> DataFrame:
    """(file_id) of each file more likely generated, minified, vendored or a blob than handwritten, once."""
    return file_labels(files).where(F.col("p_handwritten") < 0.5).select("file_id").distinct()
