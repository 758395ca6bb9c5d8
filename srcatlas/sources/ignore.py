"""Ignore rules in git's notation: patterns of one folder, nested files, negation, inherited parents."""

from __future__ import annotations

import os
import re


def _expression(pattern: str) -> str:
    """A glob as an expression: * and ? stay within a segment, ** crosses them."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern[i:] == "**" and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif c == "*":
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]", end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


class Rules:
    """The patterns of one ignore file, applied to paths relative to its folder."""

    def __init__(self, text: str) -> None:
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in text.split("\n"):
            line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\r"))
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[1:] if negated else line
            only_dirs = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            expression = _expression(line.lstrip("/"))
            self.rules.append((re.compile((expression if anchored else f"(?:.*/)?{expression}") + r"\Z", re.S), negated, only_dirs))

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        """True ignored, False kept by a negation, None not mentioned; the last rule that matches counts."""
        result = None
        for pattern, negated, only_dirs in self.rules:
            if (is_dir or not only_dirs) and pattern.match(path):
                result = not negated
        return result


IGNORE_FILES = (".gitignore", ".ignore")


def rules_of(folder: str) -> list[Rules]:
    """The rules of a folder's ignore files, weaker ones first."""
    found = []
    for name in IGNORE_FILES:
        try:
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                found.append(Rules(f.read()))
        except OSError:
            pass
    return found


class Stack:
    """Rules from the outermost folder inwards; the innermost folder that mentions a path decides."""

    def __init__(self, levels: list[tuple[str, list[Rules]]]) -> None:
        self.levels = levels

    @classmethod
    def for_root(cls, root: str) -> Stack:
        """Rules inherited from the folders above the root, the repository's excludes, and the root's own."""
        levels, chain, at = [], [], os.path.abspath(root)
        while True:
            chain.append(at)
            parent = os.path.dirname(at)
            if os.path.isdir(os.path.join(at, ".git")) or parent == at:
                break
            at = parent
        user = os.path.expanduser(os.environ.get("XDG_CONFIG_HOME", "~/.config") + "/git/ignore")
        for path in (user, os.path.join(chain[-1], ".git", "info", "exclude")):
            try:
                with open(path, encoding="utf-8", errors="replace") as f:
                    levels.append((chain[-1], [Rules(f.read())]))
            except OSError:
                pass
        levels += [(folder, r) for folder in reversed(chain) if (r := rules_of(folder))]
        return cls(levels)

    def below(self, folder: str) -> Stack:
        own = rules_of(folder)
        return Stack([*self.levels, (folder, own)]) if own else self

    def ignored(self, full: str, is_dir: bool) -> bool:
        for folder, rules in reversed(self.levels):
            relative = os.path.relpath(full, folder).replace(os.sep, "/")
            for r in reversed(rules):
                verdict = r.verdict(relative, is_dir)
                if verdict is not None:
                    return verdict
        return False
