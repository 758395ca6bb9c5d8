"""Import statements of ten languages as rows (file_id, path, ord, module, line, kind).

Java, C, C#, and Ruby imports are lines with a known beginning and need no lexer: they are native expressions. The others are
found by small expressions over masked text, in batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.text import split_lines, trim_unicode
from srcatlas.operators.lexing import FAMILY, Positions, masked
from srcatlas.plans.runtime import spread

KINDS = ("rust_use", "rust_mod", "es_import", "common_js_require", "python_import", "python_from_import", "go_import", "php_use", "php_require", "java_import", "c_include", "c_sharp_using", "ruby_require")
SCHEMA = "file_id bigint, path string, ord bigint, module string, line bigint, kind string"
JS_EXTENSIONS = ("js", "mjs", "cjs", "ts", "mts", "cts", "tsx", "jsx")
LEXED = ("rs", "go", "php", "py", "pyw", *JS_EXTENSIONS)

#: What begins an import line, by language; a line is trimmed first.
LINE_RULES = {
    "java_import": (("java",), ("import ",)),
    "c_include": (("c", "h", "cc", "cpp", "cxx", "hpp", "hh", "hxx"), ("#include",)),
    "c_sharp_using": (("cs",), ("using ",)),
    "ruby_require": (("rb",), ("require_relative ", "require ")),
}

_ESCAPE = re.compile(r"\\(?:(?P<x>x[0-9A-Fa-f]{2})|(?P<u>u[0-9A-Fa-f]{4})|(?P<b>u\{[0-9A-Fa-f]{1,6}\})|(?P<n>\r\n|[\s\S]))")
_SIMPLE = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "v": "\v"}


def decode_js_literal(body: str) -> str | None:
    """The value of a JS string's inside; None for octal and broken escapes."""
    broken = False

    def one(m: re.Match) -> str:
        nonlocal broken
        if m["x"] or m["u"]:
            return chr(int(m.group()[2:], 16))
        if m["b"]:
            code = int(m["b"][2:-1], 16)
            broken |= code > 0x10FFFF
            return chr(min(code, 0x10FFFF))
        c = m["n"]
        if c in ("\n", "\r", "\r\n", "\u2028", "\u2029"):
            return ""
        if c == "0":
            after = body[m.end() : m.end() + 1]
            broken |= after.isdigit()
            return "\0"
        broken |= c in "123456789xu"
        return _SIMPLE.get(c, c)

    if re.search(r"(?<!\\)(?:\\\\)*\\$", body):
        return None
    text = _ESCAPE.sub(one, body)
    if broken:
        return None
    try:
        return text.encode("utf-16", "surrogatepass").decode("utf-16")
    except UnicodeDecodeError:
        return None


_JS_STRING = r"(?P<q>[\"'`])(?P<m>(?:[^\\\n]|\\[\s\S])*?)(?P=q)"
_JS_FROM = re.compile(rf"(?<![\w$.])(?:import\s*(?:type\s+)?(?:[\w$*{{][\w$\s*,{{}}]*?from\s*)?|export\s*(?:type\s+)?(?:\*(?:\s*as\s+[\w$]+)?|{{[\w$\s,*]*}})\s*from\s*){_JS_STRING}")
_JS_CALL = re.compile(rf"(?<![\w$.])(?P<f>require|import)\s*\(\s*{_JS_STRING}\s*[,)]")


def _js(text: str, mask: str) -> Iterator[tuple[int, str, str]]:
    for pattern, kind in ((_JS_FROM, "es_import"), (_JS_CALL, None)):
        for m in pattern.finditer(text):
            if mask[m.start()] != text[m.start()] or mask[m.start("q")] != m["q"]:
                continue  # inside a comment or string
            body = m["m"]
            if m["q"] == "`" and re.search(r"(?<!\\)\$\{", body) or m["q"] != "`" and "\n" in body.replace("\\\n", ""):
                continue
            module = decode_js_literal(body)
            if module is not None:
                yield m.start(), module, kind or ("common_js_require" if m["f"] == "require" else "es_import")


def _rust(text: str, mask: str) -> Iterator[tuple[int, str, str]]:
    for m in re.finditer(r"(?m)(?<![\w#])(?P<vis>pub(?:\s*\([^)]*\))?\s+)?use\s+(?P<body>[^;]*);?", mask):
        whole = text[m.start() : m.end()].strip().removesuffix(";").strip()
        yield m.start(), whole if m["vis"] else whole.removeprefix("use").strip(), "rust_use"
    for m in re.finditer(r"(?<![\w#])(?:pub(?:\s*\([^)]*\))?\s+)?mod\s+(?P<n>(?:r#)?\w+)\s*[;{]", mask):
        yield m.start(), m["n"], "rust_mod"


def _python(text: str, mask: str) -> Iterator[tuple[int, str, str]]:
    statement = r"(?P<body>(?:\([^)]*\)|\\\n|[^\n;#(])*)"
    for m in re.finditer(rf"(?m)(?:^[ \t]*|;[ \t]*|:[ \t]+)(?P<k>import|from)\b(?=[ \t(.*\\]){statement}", mask):
        body = text[m.start("body") : m.end("body")].strip()
        yield m.start("k"), body, "python_import" if m["k"] == "import" else "python_from_import"


def _go(text: str, mask: str) -> Iterator[tuple[int, str, str]]:
    for m in re.finditer(r'(?m)^\s*import\s*(?:\((?P<many>[^)]*)\)|(?P<one>[^\n]*))', mask):
        group = "many" if m["many"] is not None else "one"
        for s in re.finditer(r'"[^"\n]*"|`[^`]*`', text[m.start(group) : m.end(group)]):
            at = m.start(group) + s.start()
            if mask[at] == text[at]:
                yield at, s.group()[1:-1], "go_import"


def _php(text: str, mask: str) -> Iterator[tuple[int, str, str]]:
    for m in re.finditer(r"(?m)^[ \t]*use\s+(?P<body>[^;({]+(?:\{[^}]*\})?)\s*;", mask):
        yield m.start() + m.group().index("use"), text[m.start("body") : m.end("body")].strip(), "php_use"
    for m in re.finditer(r"(?<![\w$>])(?:require|include)(?:_once)?\s*\(?\s*'(?P<m>[^'\n]*)'", text):
        if mask[m.start()] == text[m.start()]:
            yield m.start(), m["m"], "php_require"


_RULES = {"rs": _rust, "js": _js, "py": _python, "go": _go, "php": _php}


def imports_of(ext: str, text: str) -> list[tuple[str, int, str]]:
    """(module, line, kind) of a text in order, for the lexed languages."""
    family = FAMILY.get(ext)
    if family not in _RULES or not text:
        return []
    mask, at = masked(text, family), Positions(text)
    return [(module, at.line(p), kind) for p, module, kind in sorted(_RULES[family](text, mask))]


def _lexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(i, p, n, *x) for i, p, e, t in zip(pdf["file_id"], pdf["path"], pdf["ext"], pdf["text"]) for n, x in enumerate(imports_of(e, t))]
        yield pd.DataFrame(rows, columns=["file_id", "path", "ord", "module", "line", "kind"])


def _clean(line: Column, kind: str) -> Column:
    if kind == "java_import":
        return trim_unicode(F.regexp_replace(trim_unicode(F.regexp_replace(line, "^import ", "")), ";+$", ""))
    if kind == "c_include":
        return F.regexp_replace(trim_unicode(F.regexp_replace(line, "^#include", "")), '^[<"]+|[>"]+$', "")
    if kind == "c_sharp_using":
        return trim_unicode(F.regexp_replace(trim_unicode(F.regexp_replace(line, "^using ", "")), ";+$", ""))
    return F.regexp_replace(trim_unicode(F.regexp_replace(line, "^require(?:_relative)? ", "")), "^[\"']+|[\"']+$", "")


def line_imports(files: DataFrame) -> DataFrame:
    """Imports of the languages in LINE_RULES, natively: one row per matching line."""
    exts = [e for es, _ in LINE_RULES.values() for e in es]
    rows = spread(files.where(F.col("ext").isin(*exts)).select("file_id", "path", "ext", "text"))
    lines = rows.select("file_id", "path", "ext", F.posexplode(split_lines(F.col("text"))).alias("n", "raw")).withColumn("t", trim_unicode(F.col("raw")))
    kind = F.lit(None).cast("string")
    module = F.lit(None).cast("string")
    for name, (es, beginnings) in LINE_RULES.items():
        hit = F.col("ext").isin(*es) & F.rlike("t", F.lit("^(?:" + "|".join(map(re.escape, beginnings)) + ")"))
        kind, module = F.when(hit, name).otherwise(kind), F.when(hit, _clean(F.col("t"), name)).otherwise(module)
    found = lines.select("file_id", "path", (F.col("n") + 1).cast("bigint").alias("line"), kind.alias("kind"), module.alias("module")).where(F.col("kind").isNotNull())
    # ord: the line number orders the imports of a file; ranks would need a window per file
    return found.select("file_id", "path", F.col("line").alias("ord"), "module", "line", "kind")


def extract_imports(files: DataFrame) -> DataFrame:
    """(file_id, path, ord, module, line, kind) of all files; ord ascends in the order of the text. Null texts have none."""
    have = files if "ext" in files.columns else files.withColumn("ext", F.lower(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1)))
    lexed = have.where(F.col("ext").isin(*LEXED) & F.col("text").isNotNull()).select("file_id", "path", "ext", "text")
    return spread(lexed).mapInPandas(_lexed, SCHEMA).unionByName(line_imports(have.where(F.col("text").isNotNull())))
