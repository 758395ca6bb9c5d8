"""Declarations of twelve languages and keys of three configuration formats as rows.

Code is masked (lexing.py), declarations are matched by expressions per language, bodies by bracket pairs. Python is read with the
standard parser where it parses. YAML keys are native expressions.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.text import ascii_lower, split_lines
from srcatlas.operators.lexing import FAMILY, Enclosing, Positions, brackets, masked
from srcatlas.plans.runtime import spread

KINDS = ("function", "method", "class", "struct", "enum", "interface", "trait", "impl", "type", "const", "module", "variable", "key")
SCHEMA = "file_id bigint, ord bigint, name string, kind string, path string, line bigint, column bigint, end_line bigint, signature_end_line bigint"
JS = ("js", "mjs", "cjs", "ts", "mts", "cts", "tsx", "jsx")
LEXED = ("rs", "go", "php", "java", "cs", "c", "h", "cc", "cpp", "cxx", "hpp", "hh", "hxx", "rb", "py", "pyw", "json", "toml", *JS)

_ID = r"[A-Za-z_$\u0080-\U0010ffff][\w$]*"
_MOD = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|native|synchronized|default|virtual|override|async|readonly|partial|extern|unsafe|new|volatile|transient|strictfp|non-sealed)\s+|@\w[\w.]*(?:\s*\([^()]*\))?\s*|\[[\w.]+(?:\([^()]*\))?\]\s*)*"
_TYPE = r"[\w$.]+(?:\s*<[^;{}()=]*>)?(?:\s*\[\s*\])*\??"
_NOT_NAMES = r"(?!(?:if|for|while|switch|catch|return|else|do|new|throw|case|function|await|typeof|synchronized|using|lock|foreach|sizeof|elif|match|with|super|this)\b)"


class Found:
    """One declaration: position of its node, its name, kind, where its body opens (or None) and its last position."""

    __slots__ = ("start", "name", "kind", "body", "end")

    def __init__(self, start: int, name: str, kind: str, body: int | None, end: int) -> None:
        self.start, self.name, self.kind, self.body, self.end = start, name, kind, body, end


def _opening(mask: str, at: int, pairs: dict[int, int], stop: str = ";") -> int | None:
    """The { that opens the body of a declaration whose head goes on at `at`; None if a stop comes first."""
    while at < len(mask):
        c = mask[at]
        if c == "{":
            return at
        if c in stop or c == "}":
            return None
        at = pairs.get(at, at) + 1 if c in "([" else at + 1
    return None


_SOLID = re.compile(r"\S")
_STOPS = re.compile(r"[;\n}(\[{]")


def _statement_end(mask: str, at: int, pairs: dict[int, int]) -> int:
    """The last position of a statement: its ; or the line end that no bracket or operator spans."""
    begin = at
    while m := _STOPS.search(mask, at):
        at, c = m.start(), m.group()
        if c == ";":
            return at
        if c == "}":
            return at - 1
        if c == "\n":
            before = at - 1
            while before >= begin and mask[before].isspace():
                before -= 1
            after = _SOLID.search(mask, at)
            goes_on = after and after.group() in ".?:=+-*/&|," or before >= begin and mask[before] in "=,+-*/&|(?:"
            if not goes_on:
                return at - 1
            at = begin = after.start() if after else len(mask)  # the white space between is looked at once
            continue
        at = pairs.get(at, at) + 1
    return len(mask) - 1


def _rust(text: str, mask: str, pairs: dict[int, int]) -> list[Found]:
    found, impls = [], set()
    vis = r"(?:pub(?:\s*\([^)]*\))?\s+)?"
    for m in re.finditer(rf"(?<![\w#]){vis}(?:default\s+)?(?:unsafe\s+)?impl\b", mask):
        body = _opening(mask, m.end(), pairs)
        if body is None:
            continue
        head = re.split(r"\bwhere\b", text[m.end() : body])[0].strip()
        if head.startswith("<"):
            depth = 0
            for i, c in enumerate(head):
                depth += (c == "<") - (c == ">" and head[i - 1] != "-")
                if not depth:
                    head = head[i + 1 :].strip()
                    break
        end = pairs.get(body, len(mask) - 1)
        impls.add(body)
        found.append(Found(m.start(), " for ".join(re.sub(r"\s+", " ", x).strip() for x in re.split(r"\s+for\s+", head)), "impl", body, end))
    around = Enclosing(mask, pairs, unclosed=impls)
    methods = around.within(impls)
    for m in re.finditer(rf"(?<![\w#]){vis}(?:(?:default|const|async|unsafe)\s+|extern\s*(?:\"[^\"]*\")?\s*)*fn\s+(?P<n>(?:r#)?\w+)", mask):
        body = _opening(mask, m.end(), pairs)
        if body is not None:
            found.append(Found(m.start(), m["n"], "method" if around(m.start()) in methods else "function", body, pairs.get(body, len(mask) - 1)))
    for m in re.finditer(rf"(?<![\w#]){vis}(?:unsafe\s+)?(?P<k>struct|enum|trait|mod|type|const)\s+(?P<n>(?:r#)?[A-Za-z_]\w*)(?!\s*!)", mask):
        if m["k"] == "const" and m["n"] in ("fn", "unsafe", "async", "extern"):
            continue
        body = _opening(mask, m.end(), pairs)
        if m["k"] in ("type", "const"):
            body = None
        end = pairs.get(body, len(mask) - 1) if body is not None else _statement_end(mask, m.end(), pairs)
        found.append(Found(m.start(), m["n"], {"mod": "module"}.get(m["k"], m["k"]), body, end))
    return found


def _js(text: str, mask: str, pairs: dict[int, int], typed: bool) -> list[Found]:
    found, classes = [], set()
    for m in re.finditer(rf"(?<![\w$.])class\s+(?P<n>{_ID})", mask):
        if re.search(r"\babstract\s+$", mask[max(0, m.start() - 12) : m.start()]):
            body = _opening(mask, m.end(), pairs)
            if body is not None:
                classes.add(body)
            continue
        body = _opening(mask, m.end(), pairs)
        if body is not None:
            end = pairs.get(body, len(mask) - 1)
            classes.add(body)
            found.append(Found(m.start(), m["n"], "class", body, end))
    for m in re.finditer(rf"(?<![\w$.])(?:async\s+)?function\s+(?P<n>{_ID})\s*(?=[(<])", mask):
        if re.search(r"[=(,:?&|]\s*$|\breturn\s+$", mask[max(0, m.start() - 10) : m.start()]):
            continue  # an expression
        body = _opening(mask, m.end(), pairs)
        if body is not None:
            found.append(Found(m.start(), m["n"], "function", body, pairs.get(body, len(mask) - 1)))
    around = Enclosing(mask, pairs, unclosed=classes)
    # a method's head lies directly in its class's body; white space is not gone through for every line end in it
    head = re.compile(rf"(?<=[{{}};\n])[^\S\n]*(?P<all>(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*(?:\*\s*)?{_NOT_NAMES}(?P<n>#?{_ID})\s*(?:<[^;{{}}()]*>\s*)?\()")
    for m in head.finditer(mask) if classes else ():
        close = pairs.get(m.end() - 1)
        if close is None or around(m.start("all")) not in classes:
            continue
        body = _opening(mask, close + 1, pairs)
        if body is not None:
            found.append(Found(m.start("all"), m["n"], "method", body, pairs.get(body, len(mask) - 1)))
    if typed:
        for m in re.finditer(rf"(?<![\w$.])interface\s+(?P<n>{_ID})", mask):
            body = _opening(mask, m.end(), pairs)
            if body is None:
                continue
            end = pairs.get(body, len(mask) - 1)
            found.append(Found(m.start(), m["n"], "interface", body, end))
            for s in re.compile(rf"(?<=[{{;,\n])[^\S\n]*(?P<n>{_ID})\??\s*(?:<[^;{{}}()]*>\s*)?\(").finditer(mask, body, end):
                close = pairs.get(s.end() - 1)
                if close is not None:
                    found.append(Found(s.start("n"), s["n"], "method", None, _statement_end(mask, close, pairs)))
        for m in re.finditer(rf"(?<![\w$.])type\s+(?P<n>{_ID})\s*(?:<[^=;]*>)?\s*=(?!=)", mask):
            found.append(Found(m.start(), m["n"], "type", None, _statement_end(mask, m.end(), pairs)))
    in_class = around.within(classes)
    for m in re.finditer(rf"(?<![\w$.])(?:let|const|var)\s+(?P<n>{_ID}|\{{[^}}]*\}}|\[[^\]]*\])", mask):
        if around(m.start()) in in_class or re.match(r"enum\b", m["n"]):
            continue
        if _LOOP.match(mask, m.end()):
            continue  # a loop's own variable is no declaration
        value = _INITIAL.match(mask, m.end())
        kind = "variable"
        if value:
            at = value.end()
            if _FUNCTION.match(mask, at) or _is_arrow(mask, at, pairs):
                kind = "function"
            elif _CLASS.match(mask, at):
                kind = "class"
        found.append(Found(m.start(), text[m.start("n") : m.end("n")], kind, None, _statement_end(mask, m.end(), pairs)))
    return found


_LOOP, _FUNCTION, _CLASS = re.compile(r"\s+(?:of|in)\b"), re.compile(r"(?:async\s+)?function\b"), re.compile(r"class\b")
_INITIAL = re.compile(r"(?:\s*:[^=;\n]*(?:=>[^=;\n]*)?)?\s*=(?!=)\s*")
_ASYNC, _ONE_NAME, _ARROW = re.compile(r"async\s*"), re.compile(r"[\w$]+"), re.compile(r"\s*(?::[^=;]*)?=>")


def _is_arrow(mask: str, at: int, pairs: dict[int, int]) -> bool:
    """Whether an arrow function begins here: parameters in brackets or one name, then an arrow, however long they are."""
    for start in {at, m.end() if (m := _ASYNC.match(mask, at)) else at}:
        end = pairs[start] + 1 if mask[start : start + 1] == "(" and start in pairs else m.end() if (m := _ONE_NAME.match(mask, start)) else None
        if end is not None and _ARROW.match(mask, end):
            return True
    return False


def _go(text: str, mask: str, pairs: dict[int, int]) -> list[Found]:
    found, in_brackets = [], Enclosing(mask, pairs, "(")
    for m in re.finditer(r"(?m)^func\s+(?P<r>\([^)]*\)\s*)?(?P<n>\w+)", mask):
        body = _opening(mask, m.end(), pairs, "")
        line_end = mask.find("\n", m.end())
        if body is not None and (0 <= line_end < body) and in_brackets(body) < 0:
            body = None if not mask[m.end() : line_end].rstrip().endswith(("(", "{", ",")) else body
        found.append(Found(m.start(), m["n"], "method" if m["r"] else "function", body, pairs.get(body, len(mask) - 1) if body is not None else _statement_end(mask, m.end(), pairs)))
    for m in re.finditer(r"(?m)^[ \t]*(?P<k>type|const|var)\s+(?P<g>\()?", mask):
        kind = {"type": "type", "const": "const", "var": "variable"}[m["k"]]
        if m["g"]:
            inner, end = m.end(), pairs.get(m.end() - 1, len(mask))
            at = inner
            while at < end:
                s = re.compile(r"\s*(?P<n>\w+)").match(mask, at, end)
                if not s:
                    break
                stop = _statement_end(mask, s.end(), pairs)
                found.append(Found(s.start("n"), s["n"], kind, None, stop))
                at = max(stop + 1, s.end())
        else:
            s = re.compile(r"(?P<n>\w+)").match(mask, m.end())
            if s:
                found.append(Found(s.start(), s["n"], kind, None, _statement_end(mask, s.end(), pairs)))
    return found


def _braced(text: str, mask: str, pairs: dict[int, int], ext: str) -> list[Found]:
    """Java, C# and PHP."""
    found = []
    words = {"java": "class|interface|enum", "cs": "class|interface|enum|struct", "php": "class|interface|trait"}[ext]
    owners = set()
    for m in re.finditer(rf"(?<![\w$.@]){_MOD}(?P<k>{words})\s+(?P<n>[\w$]+)", mask):
        body = _opening(mask, m.end(), pairs)
        if body is None:
            continue
        end = pairs.get(body, len(mask) - 1)
        owners.add(body)
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        found.append(Found(start, m["n"], m["k"], body, end))
    around = Enclosing(mask, pairs, unclosed=owners)
    if ext == "php":
        methods = around.within(owners)
        for m in re.finditer(r"(?<![\w$>])(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?\s*(?P<n>\w+)\s*\(", mask):
            body = _opening(mask, m.end() - 1, pairs)
            end = pairs.get(body, len(mask) - 1) if body is not None else _statement_end(mask, m.end(), pairs)
            found.append(Found(m.start(), m["n"].lstrip("$"), "method" if around(m.start()) in methods else "function", body, end))
        return found
    head = re.compile(rf"(?<=[;{{}}\n\]])[^\S\n]*(?P<all>{_MOD}(?:<[^;{{}}()]*>\s*)?(?:{_NOT_NAMES}{_TYPE}\s+)?{_NOT_NAMES}(?P<n>[\w$]+)\s*\()")
    for m in head.finditer(mask) if owners else ():
        close = pairs.get(m.end() - 1)
        if close is None or around(m.start("all")) not in owners:
            continue
        body = _opening(mask, close + 1, pairs)
        if body is None and not _NO_BODY.match(mask, close + 1):
            continue
        found.append(Found(m.start("all"), m["n"], "method", body, pairs.get(body, len(mask) - 1) if body is not None else _statement_end(mask, close, pairs)))
    if ext == "cs":
        inner = around.within(owners)
        for m in re.finditer(rf"(?<=[;{{}}\n])[^\S\n]*(?P<all>{_MOD}{_NOT_NAMES}{_TYPE}\s+(?P<n>\w+)\s*)(?=\{{\s*(?:get|set|init|private|protected|internal)\b|=>)", mask):
            if around(m.start("all")) in inner:
                body = _opening(mask, m.end(), pairs)
                found.append(Found(m.start("all"), m["n"], "variable", None, pairs.get(body, m.end()) if body is not None else _statement_end(mask, m.end(), pairs)))
    return found


_NO_BODY = re.compile(r"\s*(?:throws\s+[\w.,\s]+)?;|\s*=>")


def _c(text: str, mask: str, pairs: dict[int, int], ext: str) -> list[Found]:
    code = re.sub(r"(?m)^[ \t]*#(?:[^\n\\]|\\.)*", lambda m: re.sub(r"[^\n]", " ", m.group()), mask, flags=re.S)
    found = []
    for m in re.finditer(rf"(?<![\w.])(?P<k>struct|class|enum|union)\s+(?:class\s+)?(?P<n>[A-Za-z_]\w*)", code):
        if m["k"] == "union":
            continue
        after = re.compile(r"\s*(?::[^{;()]*)?\{").match(code, m.end())
        body = after.end() - 1 if after else None
        found.append(Found(m.start(), m["n"], m["k"], body, pairs.get(body, m.end() - 1) if body is not None else m.end() - 1))
    for m in re.finditer(r"(?<![\w.])(?P<k>typedef)\b", code):
        end = _statement_end(code, m.end(), pairs)
        head = code[m.end() : end]
        names = re.findall(r"[A-Za-z_]\w*", re.sub(r"\b(?:struct|union|enum|const|unsigned|signed|int|char|long|short|void|float|double)\b", " ", head))
        if names:
            found.append(Found(m.start(), names[0], "type", None, end))
    if ext not in ("c", "h"):
        for m in re.finditer(r"(?<![\w.])using\s+(?P<n>\w+)\s*=", code):
            found.append(Found(m.start(), m["n"], "type", None, _statement_end(code, m.end(), pairs)))
    for m in re.finditer(rf"(?m)(?:^|(?<=[;}}{{]))[ \t]*(?P<all>(?:[A-Za-z_][\w:]*(?:\s*<[^;{{}}()]*>)?[\s*&]+)*{_NOT_NAMES}(?P<n>[A-Za-z_~][\w:~]*)\s*\()", code):
        close = pairs.get(m.end() - 1)
        if close is None or re.match(r"\s*(?:struct|class|enum|union|typedef|namespace)\s+\w+\s*\{", m["all"]):
            continue
        after = re.compile(r"\s*(?:const|noexcept|override|final|\s)*(?::[^{;]*)?\{").match(code, close + 1)
        if after:
            body = after.end() - 1
            # the first identifier of the node names it
            head = re.sub(r"\b(?:static|inline|extern|const|unsigned|signed|int|char|long|short|void|float|double|bool|struct|class|enum|virtual|explicit|constexpr|auto|register|volatile)\b", " ", m["all"])
            name = re.search(r"[A-Za-z_~][\w:~]*", head)
            found.append(Found(m.start("all"), name.group() if name else m["n"], "function", body, pairs.get(body, len(code) - 1)))
    return found


def _ruby(text: str, mask: str) -> list[tuple[int, str, str, int, int]]:
    """(line, name, kind, column, end line): Ruby's blocks close with `end`, so lines are counted instead of brackets."""
    rows, stack = [], []
    opener = re.compile(r"^(?:.*[=(]\s*)?(?:class|module|def|if|unless|while|until|case|begin|for)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$")
    for n, line in enumerate(mask.split("\n"), 1):
        bare = line.strip()
        m = re.match(r"(?P<k>class|module|def)\s+(?:self\.)?(?P<n>[A-Za-z_]\w*(?:::\w+)*[?!=]?)", bare)
        column = len(line) - len(line.lstrip()) + 1
        if m:
            rows.append([n, m["n"], {"class": "class", "module": "module", "def": "function"}[m["k"]], column, n])
        elif a := re.match(r"(?P<n>(?:@{0,2}|\$)?[A-Za-z_]\w*(?:\.\w+)*)\s*=(?![=~>])", bare):
            rows.append([n, a["n"], "variable", column, n])
        if opener.search(bare) and not re.search(r"\bend\b\s*$", bare) and not re.match(r"def\s+[\w.?!]+(?:\([^)]*\))?\s*=\s", bare):
            stack.append(rows[-1] if m else None)
        if re.match(r"end\b", bare) and stack:
            done = stack.pop()
            if done:
                done[4] = n
    return [tuple(r) for r in rows]


def _python(text: str) -> list[tuple[str, str, int, int, int, int | None]] | None:
    """(name, kind, line, column, end line, signature end) in the order of the text; None if the text does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    rows = []
    lines = [x.encode("utf-8", "replace") for x in re.split(r"(?<=\n)|(?<=\r)(?!\n)", text)]  # as the parser counts lines and bytes

    def segment(node: ast.AST) -> str:
        a, b = node.lineno - 1, node.end_lineno - 1
        if a == b:
            return lines[a][node.col_offset : node.end_col_offset].decode("utf-8", "replace")
        return b"".join([lines[a][node.col_offset :], *lines[a + 1 : b], lines[b][: node.end_col_offset]]).decode("utf-8", "replace")

    def walk(node: ast.AST, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            inside = in_class
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if in_class else "function"
                body = child.body[0]
                first = min([body.lineno, *(d.lineno for d in getattr(body, "decorator_list", []))])
                rows.append((child.name, kind, child.lineno, child.col_offset + 1, child.end_lineno, max(child.lineno, first - 1)))
                inside = in_class or kind == "class"
            elif isinstance(child, (ast.Assign, ast.AnnAssign, ast.AugAssign)) and not in_class and not isinstance(child, ast.AugAssign):
                target = child.targets[0] if isinstance(child, ast.Assign) else child.target
                rows.append((segment(target), "variable", child.lineno, child.col_offset + 1, child.end_lineno, None))
            walk(child, inside)

    walk(tree, False)
    return rows


def _python_tolerant(text: str) -> list[tuple[str, str, int, int, int, int | None]]:
    rows, classes = [], []
    lines = masked(text, "py").split("\n")
    for n, line in enumerate(lines, 1):
        m = re.match(r"(\s*)(?:async\s+)?(def|class)\s+(\w+)", line)
        indent = len(line) - len(line.lstrip())
        if line.strip():
            classes = [c for c in classes if c < indent]
        if m:
            end = n
            for k in range(n, len(lines)):
                if lines[k].strip() and len(lines[k]) - len(lines[k].lstrip()) <= indent:
                    break
                end = k + 1 if lines[k].strip() else end
            rows.append((m[3], "class" if m[2] == "class" else "method" if classes else "function", n, indent + 1, end, n))
            if m[2] == "class":
                classes.append(indent)
        elif not classes and (a := re.match(r"\s*([A-Za-z_][\w.]*(?:\s*,\s*[A-Za-z_][\w.]*)*)\s*(?::[^=]*)?=(?!=)", line)):
            rows.append((a[1], "variable", n, indent + 1, n, None))
    return rows


def _json_keys(text: str) -> list[tuple[str, int, int]]:
    """(dotted key, line, column) of all objects' keys, those of one object sorted; a repeated key's last place counts; arrays are not entered."""
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return []
    at = Positions(text)
    token = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+')
    tokens = [(m.group(), m.start()) for m in token.finditer(text)]

    def value(i: int, keep: bool) -> tuple[int, dict | None]:
        t = tokens[i][0]
        if t == "{":
            keys: dict[str, tuple[int, dict | None]] = {}
            i += 1
            while tokens[i][0] != "}":
                if tokens[i][0] == ",":
                    i += 1
                    continue
                name, where = json.loads(tokens[i][0]), tokens[i][1]
                i, child = value(i + 2, keep)
                keys[name] = (where, child)
            return i + 1, keys if keep else None
        if t == "[":
            i += 1
            while tokens[i][0] != "]":
                i = i + 1 if tokens[i][0] == "," else value(i, False)[0]
            return i + 1, None
        return i + 1, None

    rows: list[tuple[str, int, int]] = []

    def emit(keys: dict, prefix: str) -> None:
        for name in sorted(keys):
            where, child = keys[name]
            rows.append((prefix + name, at.line(where), at.column(where)))
            if child:
                emit(child, f"{prefix}{name}.")

    _, top = value(0, True)
    if top:
        emit(top, "")
    return rows


def _toml_keys(text: str) -> list[tuple[str, int, int]]:
    """(dotted key, line, column) of tables and keys in order; arrays of tables are not entered."""
    import tomllib

    try:
        tomllib.loads(text.replace("\r\n", "\n"))
    except (ValueError, RecursionError):
        return []
    rows, prefix, skipping, depth, closing = [], "", False, 0, ""
    named: set[str] = set()
    part = r"(?:[A-Za-z0-9_-]+|\"[^\"\n]*\"|'[^'\n]*')"
    for n, line in enumerate(text.split("\n"), 1):
        if closing:
            closing = "" if closing in line else closing
            continue
        if depth:
            depth += line.count("[") - line.count("]")
            continue
        m = re.match(rf"\s*(\[\[?)\s*({part}(?:\s*\.\s*{part})*)\s*\]", line)
        if m:
            names = [x.strip("\"'") for x in re.findall(part, m[2])]
            skipping, prefix = m[1] == "[[", ".".join(names) + "."
            if not skipping:
                rows.append((prefix[:-1], n, m.start(2) + 1))
                named.add(prefix[:-1])
            continue
        m = re.match(rf"\s*({part}(?:\s*\.\s*{part})*)\s*=\s*(.*)", line)
        if m:
            names = [x.strip("\"'") for x in re.findall(part, m[1])]
            if not skipping:
                for k in range(1, len(names) + 1):
                    key = prefix + ".".join(names[:k])
                    if k == len(names) or key not in named:
                        rows.append((key, n, m.start(1) + 1))
                        named.add(key)
            value = m[2]
            for q in ('"""', "'''"):
                if value.startswith(q) and q not in value[3:]:
                    closing = q
            if value.startswith("["):
                bare = re.sub(r"\"[^\"]*\"|'[^']*'|#.*", "", value)
                depth = max(0, bare.count("[") - bare.count("]"))
            if value.startswith("{") and not skipping:
                for k in re.finditer(rf"[{{,]\s*({part})\s*=", value):
                    rows.append((prefix + ".".join(names) + "." + k[1].strip("\"'"), n, m.start(2) + k.start(1) + 1))
                    named.add(rows[-1][0])
    return rows


def symbols_of(ext: str, text: str) -> list[tuple[str, str, int, int, int, int | None]]:
    """(name, kind, line, column, end_line, signature_end_line) of a text's declarations in the order of the text."""
    if not text:
        return []
    if ext in ("json", "toml"):
        return [(name, "key", line, column, line, None) for name, line, column in (_json_keys if ext == "json" else _toml_keys)(text)]
    if ext in ("py", "pyw"):
        rows = _python(text)
        return rows if rows is not None else _python_tolerant(text)
    family = FAMILY.get(ext)
    if family is None:
        return []
    mask = masked(text, family)
    if ext == "rb":
        return [(name, kind, line, column, end, line if kind != "variable" else None) for line, name, kind, column, end in _ruby(text, mask)]
    pairs = brackets(mask)
    if family == "rs":
        found = _rust(text, mask, pairs)
    elif family == "js":
        found = _js(text, mask, pairs, True)
    elif family == "go":
        found = _go(text, mask, pairs)
    elif ext in ("java", "cs", "php"):
        found = _braced(text, mask, pairs, ext)
    else:
        found = _c(text, mask, pairs, ext)
    at = Positions(text)
    found.sort(key=lambda f: (f.start, -f.end))
    return [(f.name, f.kind, at.line(f.start), at.column(f.start), at.line(max(f.start, f.end)), at.line(f.body) if f.body is not None else None) for f in found]


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(i, n, name, kind, p, *rest) for i, p, e, t in zip(pdf["file_id"], pdf["path"], pdf["ext"], pdf["text"]) for n, (name, kind, *rest) in enumerate(symbols_of(e, t))]
        out = pd.DataFrame(rows, columns=["file_id", "ord", "name", "kind", "path", "line", "column", "end_line", "signature_end_line"])
        out["signature_end_line"] = out["signature_end_line"].astype("Int64")
        yield out


def yaml_keys(files: DataFrame) -> DataFrame:
    """Keys before the first colon of YAML lines, natively; comments, blank lines and list items are passed over."""
    rows = spread(files.where(F.col("ext").isin("yml", "yaml")).select("file_id", "path", "text"))
    lines = rows.select("file_id", "path", F.posexplode(split_lines(F.col("text"))).alias("n", "raw")).withColumn("t", F.trim("raw"))
    keyed = lines.where((F.col("t") != "") & ~F.rlike("t", F.lit("^[#-]")) & F.contains(F.col("t"), F.lit(":")))
    name = F.trim(F.substring_index("t", ":", 1))
    line = (F.col("n") + 1).cast("bigint")
    column = (F.octet_length(F.regexp_extract("raw", r"^(\s*)", 1)) + 1).cast("bigint")
    return keyed.where(name != "").select("file_id", F.col("n").cast("bigint").alias("ord"), name.alias("name"), F.lit("key").alias("kind"), "path", line.alias("line"), column.alias("column"), line.alias("end_line"), F.lit(None).cast("bigint").alias("signature_end_line"))


def extract_symbols(files: DataFrame) -> DataFrame:
    """(file_id, ord, name, name_lc, kind, path, line, column, end_line, signature_end_line) of all files. Null texts have none."""
    have = files if "ext" in files.columns else files.withColumn("ext", F.lower(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1)))
    some = have.where(F.col("text").isNotNull())
    lexed = spread(some.where(F.col("ext").isin(*LEXED)).select("file_id", "path", "ext", "text")).mapInPandas(_extract, SCHEMA)
    rows = lexed.unionByName(yaml_keys(some))
    return rows.select("file_id", "ord", "name", ascii_lower(F.col("name")).alias("name_lc"), "kind", "path", "line", "column", "end_line", "signature_end_line")


def outline(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("path") == path).orderBy("ord")


def find_symbol(symbols: DataFrame, name: str, limit: int | None = 20) -> DataFrame:
    """Symbols of exactly that name, case aside; if there are none, those that contain it. By file and place."""
    wanted = ascii_lower(F.lit(name))
    exact = symbols.where(F.col("name_lc") == wanted)
    close = symbols.where(F.contains(F.col("name_lc"), wanted))
    any_exact = exact.limit(1).select(F.lit(1).alias("x"))
    # one row at most decides, so the anti-join is a broadcast of a single row
    rows = exact.unionByName(close.withColumn("x", F.lit(1)).join(F.broadcast(any_exact), "x", "left_anti").drop("x")).orderBy("file_id", "ord")
    return rows if limit is None else rows.limit(limit)


def format_symbols(symbols: DataFrame) -> DataFrame:
    """`path:line:column kind name` of each symbol."""
    return symbols.select(F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("column").cast("string"), F.lit(" "), F.col("kind"), F.lit(" "), F.col("name")).alias("value"))
