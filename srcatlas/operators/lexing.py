"""A small masking lexer shared by the symbol and import extractors: positions stay, comments and strings do not matter."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

_DQ, _SQ, _BACK = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'", r"`(?:[^`\\]|\\.)*`"
_C = r"//[^\n]*|/\*.*?(?:\*/|\Z)"

#: Comments and strings of each language family.
PATTERNS = {
    "rs": re.compile(rf'(?P<c>{_C})|(?P<s>b?r(?P<h>#*)".*?"(?P=h)|b?"(?:[^"\\]|\\.)*"|b?\'(?:[^\'\\\n]|\\[^\n]{{1,8}}?)\')', re.S),
    "js": re.compile(rf"(?P<c>{_C})|(?P<s>{_DQ}|{_SQ}|{_BACK})", re.S),
    "go": re.compile(rf"(?P<c>{_C})|(?P<s>{_DQ}|`[^`]*`|{_SQ})", re.S),
    "php": re.compile(rf"(?P<c>{_C}|\#(?!\[)[^\n]*)|(?P<s>{_DQ}|'(?:[^'\\]|\\.)*')", re.S),
    "c": re.compile(rf"(?P<c>{_C})|(?P<s>{_DQ}|{_SQ})", re.S),
    "py": re.compile(rf'(?P<c>\#[^\n]*)|(?P<s>[rRbBuUfF]{{0,2}}(?:"""(?:[^\\]|\\.)*?"""|\'\'\'(?:[^\\]|\\.)*?\'\'\'|{_DQ}|{_SQ}))', re.S),
    "rb": re.compile(rf"(?P<c>\#[^\n]*|^=begin\b.*?^=end[^\n]*)|(?P<s>{_DQ}|'(?:[^'\\]|\\.)*')", re.S | re.M),
}
FAMILY = {
    "rs": "rs", **dict.fromkeys(("js", "mjs", "cjs", "ts", "mts", "cts", "tsx", "jsx"), "js"), "go": "go", "php": "php", **dict.fromkeys(("java", "cs", "c", "h", "cc", "cpp", "cxx", "hpp", "hh", "hxx"), "c"),
    **dict.fromkeys(("py", "pyw"), "py"), "rb": "rb",
}


def _blank(m: re.Match) -> str:
    text = m.group()
    if m.lastgroup == "c":
        return re.sub(r"[^\n]", " ", text)
    return text[0] + re.sub(r"[^\n]", " ", text[1:-1]) + text[-1] if len(text) > 1 else text


def masked(text: str, family: str) -> str:
    """The text with comments and the insides of strings blanked, every character at its place."""
    return PATTERNS[family].sub(lambda m: _blank(m), text)


class Positions:
    """Lines and byte columns, counted from 1, of character positions."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.ascii = text.isascii()

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def column(self, at: int) -> int:
        start = self.starts[self.line(at) - 1]
        return at - start + 1 if self.ascii else len(self.text[start:at].encode("utf-8", "replace")) + 1


def brackets(mask: str) -> dict[int, int]:
    """Where each opening bracket closes; unmatched ones are left out."""
    pairs, stack = {}, []
    close = {")": "(", "]": "[", "}": "{"}
    open_ = dict.fromkeys("([{", 0)
    for m in re.finditer(r"[()\[\]{}]", mask):
        c = m.group()
        if c in open_:
            stack.append((c, m.start()))
            open_[c] += 1
        elif open_[close[c]]:
            while stack[-1][0] != close[c]:
                open_[stack.pop()[0]] -= 1
            open_[close[c]] -= 1
            pairs[stack.pop()[1]] = m.start()
    return pairs


class Enclosing:
    """The innermost pair of one kind of bracket around a position, by one pass over the pairs and a binary search per question."""

    def __init__(self, mask: str, pairs: dict[int, int], kind: str = "{", unclosed: set[int] = frozenset()) -> None:
        """Brackets that are never closed count only if they are named as unclosed; they reach to the end or that of the pair around them."""
        spans = {o: c for o, c in pairs.items() if mask[o] == kind} | {o: len(mask) for o in unclosed if o not in pairs}
        events = sorted([(o, o) for o in spans] + [(c, o) for o, c in spans.items()])
        self.at: list[int] = []
        self.inside: list[int] = []
        #: The pair around each pair, by their openings; -1 for none.
        self.parent: dict[int, int] = {}
        stack, held = [-1], set()
        for at, o in events:
            if at == o:
                self.parent[o] = stack[-1]
                stack.append(o)
                held.add(o)
            elif o in held:
                while (top := stack.pop()) != o:
                    held.discard(top)
                held.discard(o)
            self.at.append(at)
            self.inside.append(stack[-1])

    def __call__(self, position: int) -> int:
        """Where the innermost pair around a position opens, -1 if there is none."""
        i = bisect_left(self.at, position) - 1
        return self.inside[i] if i >= 0 else -1

    def within(self, openings: set[int]) -> set[int]:
        """The pairs that are one of some pairs or lie in one."""
        result: set[int] = set()
        for o in sorted(self.parent):
            if o in openings or self.parent[o] in result:
                result.add(o)
        return result
