"""Source files that do not parse (problem 7).

A file's text is reduced to its token kinds by a few compiled expressions, cut into segments and run through the language's
recogniser (glr.py, grammars.py), which remembers what a segment does to its tables. The first token that no parse can take is the
file's error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.llm import glr, grammars
from srcatlas.plans.runtime import spread

#: What stands for a character that begins no token, among it quotes that are never closed.
BAD = "\x02"
_DQ, _SQ = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'"
_LINE, _BLOCK = r"//[^\n]*", r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"


class Language:
    """A lexer and a recogniser; `comments` and `strings` are expressions, `words` the keywords that stay as they are."""

    grammar = ""
    comments, strings, words = "", "", ""
    name = r"[A-Za-z_$\u0080-\U0010ffff][\w$]*"
    number = r"(?:0[xX][\dA-Fa-f_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*\.?[\d_]*(?:[eE][+-]?[\d_]+)?|\.\d[\d_]*(?:[eE][+-]?[\d_]+)?)[\w]*"
    operators = ""
    cut = r"[^;{}\n]*(?:[;{}\n]|$)"

    def __init__(self) -> None:
        keep = self.words.split()
        self.lexical = re.compile(rf"(?P<c>{self.comments})|(?P<s>{self.strings})|(?P<q>[\"'`])", re.S)
        not_word = rf"(?!(?:{'|'.join(map(re.escape, keep))})(?![\w$]))" if keep else ""
        self.plain = re.compile(rf"(?<![\w$\\]){not_word}{self.name}")
        self.digits = re.compile(rf"(?<![\w$]){self.number}")
        operators = sorted(self.operators.split(), key=len, reverse=True)
        self.token = re.compile("|".join([r"\n|\"|[A-Za-z_$0~#]+", *map(re.escape, operators), r"\S"]))
        self.segment = re.compile(self.cut)
        self.recogniser = glr.Recogniser(self.text())

    def text(self) -> str:
        return self.grammar

    def lexed(self, m: re.Match) -> str:
        if m.lastgroup == "c":
            return self.comment(m.group())
        return '"' if m.lastgroup == "s" else BAD

    def comment(self, text: str) -> str:
        return "\n" if "\n" in text else " "

    def shape(self, text: str) -> str:
        """The text with comments gone and every string, name and number as one character; line ends stay."""
        text = self.lexical.sub(self.lexed, text.replace("\r\n", "\n"))
        text = self.digits.sub("0", self.plain.sub("a", text))
        text = re.sub(r"[ \t\r\f\v]+", " ", text)
        return re.sub(r" ?\n[ \n]*", "\n", text)

    def first_error(self, text: str) -> str | None:
        """None if the text parses, else the token at which it cannot go on ('' at its end)."""
        r = self.recogniser
        r.trim()
        config = r.start
        shape = self.shape(text)
        if not shape.strip():
            return None
        for segment in self.segment.findall(shape):
            got = r.segments[config].get(segment)
            if got is None:
                got = self.run(config, segment)
                if isinstance(got, str):
                    return got
                r.segments[config][segment] = got
                r.remembered += 1
            config = got
        return None if r.accepts(config) else ""

    def run(self, config: int, segment: str) -> int | str:
        """Steps through the tokens of a segment."""
        r = self.recogniser
        for token in self.token.findall(segment):
            if token == "\n":
                continue
            after = r.step(config, token)
            if after == r.stuck:
                return token
            config = after
        return config


class Inserting(Language):
    """Languages in which a line end, } or the end may stand for a semicolon where nothing else parses."""

    #: What never goes on with the line before if a semicolon may stand there.
    restricted = frozenset(("++", "--"))

    def first_error(self, text: str) -> str | None:
        r = self.recogniser
        r.trim()
        config, line = r.start, False
        shape = self.shape(text)
        if not shape.strip():
            return None
        for segment in self.segment.findall(shape):
            key = "\n" + segment if line else segment
            got = r.segments[config].get(key)
            if got is None:
                got = self.run_from(config, segment, line)
                if isinstance(got, str):
                    return got
                r.segments[config][key] = got
                r.remembered += 1
            config = got
            if segment:
                line = segment[-1] == "\n" or line and not segment.strip()
        if r.accepts(config) or (n := r.step(config, ";")) != r.stuck and r.accepts(n):
            return None
        return ""

    def run_from(self, config: int, segment: str, line: bool) -> int | str:
        r = self.recogniser
        for token in self.token.findall(segment):
            if token == "\n":
                line = True
                continue
            after = r.step(config, token)
            if after == r.stuck and (line or token == "}") or line and token in self.restricted:
                ended = r.step(config, ";")
                apart = r.step(ended, token) if ended != r.stuck else ended
                after = after if apart == r.stuck else apart
            if after == r.stuck:
                return token
            config, line = after, False
        return config


class JavaScript(Inserting):
    grammar = grammars.JS
    # a slash begins a regular expression only where no operand can end
    strings = rf"{_DQ}|{_SQ}|`(?:[^`\\$]|\\.|\$(?!\{{)|\$\{{(?:[^{{}}`]|\{{[^{{}}]*\}}|`[^`]*`)*\}})*`|(?:(?<=[=(,:\[!&|?{{}};\n])|(?<=[=(,:\[!&|?{{}};] )|(?<=return ))/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
    comments = rf"{_LINE}|{_BLOCK}|\A\#![^\n]*"
    words = "from of as async get set static type import export default var let const if else for while do return throw try catch finally switch case break continue debugger class extends function yield await new delete typeof void in instanceof"
    operators = ">>>= ... === !== **= <<= &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= ** <<"

    def __init__(self) -> None:
        super().__init__()
        if "type" not in self.recogniser.tokens:
            raise ValueError("grammar")

    def shape(self, text: str) -> str:
        return _NO_VALUE.sub(f"const a {BAD}", super().shape(text))


#: A constant without a value.
_NO_VALUE = re.compile(r"(?<![\w$.])const a ?;")


class TypeScript(JavaScript):
    grammar = grammars.TS
    words = JavaScript.words + " interface enum namespace module declare abstract implements public private protected readonly override keyof infer is asserts satisfies"

    def text(self) -> str:
        # words that are names outside their place
        return self.grammar.replace("| 'let_'", "| 'namespace' | 'module' | 'declare' | 'abstract' | 'readonly' | 'override' | 'keyof' | 'infer' | 'is' | 'asserts' | 'satisfies' | 'public' | 'private' | 'protected' | 'interface' | 'implements'")


    def shape(self, text: str) -> str:
        return Language.shape(self, text)  # a declared constant has no value


class Java(Language):
    grammar = grammars.JAVA
    strings = rf'"""(?:[^"\\]|\\.|"(?!""))*"""|{_DQ}|\'(?:[^\'\\\n]|\\u+[\dA-Fa-f]{{4}}|\\[0-7]{{1,3}}|\\.)\''
    comments = rf"{_LINE}|{_BLOCK}"
    words = (
        "package import static public private protected final abstract native synchronized transient volatile strictfp default class interface enum record extends implements permits sealed throws void int long short byte char boolean float double "
        "if else while do for return throw break continue try catch finally switch case assert yield new instanceof super this var"
    )
    operators = "<<= ... -> :: == != <= >= && || ++ -- += -= *= /= %= &= |= ^= <<"


class C(Language):
    grammar = grammars.C
    strings = rf"(?:L|u8|u|U)?{_DQ}|(?:L|u|U)?'(?:[^'\\\n]|\\.)+'"
    comments = rf"{_LINE}|{_BLOCK}|(?:(?<=\n)|\A)[ \t]*\#[ \t]*(?:include|define|undef|if|ifdef|ifndef|elif|else|endif|error|warning|pragma|line)\b(?:[^\n\\]|\\.)*"
    words = (
        "typedef extern static auto register inline const volatile restrict void char short int long float double signed unsigned struct union enum if else switch case default while do for goto continue break return sizeof asm static_assert alignof"
    )
    operators = "<<= >>= ... -> == != <= >= && || ++ -- += -= *= /= %= &= |= ^= << >>"

    def comment(self, text: str) -> str:
        return "\n" if text.startswith("/*") and "\n" in text else " "


class Go(Language):
    grammar = grammars.GO
    strings = rf"{_DQ}|`[^`]*`|'(?:[^'\\\n]|\\[xuU][\dA-Fa-f]+|\\[0-7]{{3}}|\\.)'"
    comments = rf"{_LINE}|{_BLOCK}"
    words = "package import func var const type struct interface map chan if else for range switch case default select return break continue goto fallthrough go defer"
    operators = "<<= >>= &^= ... := <- == != <= >= && || ++ -- += -= *= /= %= &= |= ^= << >> &^"

    def shape(self, text: str) -> str:
        shape = super().shape(text + "\n")
        return re.sub(r"((?:(?<![\w$])(?:return|break|continue|fallthrough)|(?<![\w$])[a0]|[\"\)\]\}]|\+\+|--)) ?\n", r"\1;\n", shape)


class Rust(Language):
    grammar = grammars.RUST
    strings = r'(?:b|c)?r(#*)".*?"\1|(?:b|c)?"(?:[^"\\]|\\.)*"|b?\'(?:[^\'\\\n]|\\u\{[\dA-Fa-f_]+\}|\\x[\dA-Fa-f]{2}|\\.)\''
    comments = rf"{_LINE}|{_BLOCK}"
    words = (
        "use extern crate mod fn struct enum impl trait const static type pub unsafe where for in if else match loop while let mut ref move return break continue as dyn async await super self union default box"
    )
    number = r"(?:0x[\dA-Fa-f_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?[\d_]+)?)[\w]*"
    operators = "<<= ... ..= :: -> => .. == != <= >= && || += -= *= /= %= &= |= ^= << @"

    def text(self) -> str:
        known = sorted({x for x in re.findall(r"'([^']+)'", self.grammar)} - set("()[]{}"))
        return self.grammar.replace("ANY", " | ".join(f"'{x}'" for x in [*known, "$", ">>="]))

    def shape(self, text: str) -> str:
        text = re.sub(r"'([A-Za-z_]\w*)(?!')(?!\w)", r"\\life ", text) if "'" in text and re.search(r"'[A-Za-z_]\w*(?!')(?!\w)", text) else text
        return super().shape(text).replace("\\life", "life").replace("$a", "a")


#: The name of a class or module that does not begin with a capital.
_SMALL_CONSTANT = re.compile(r"((?<![\w.:@$])(?:class|module)[ \t]+)[a-z_]\w*(?![\w:.])")


class Ruby(Language):
    grammar = grammars.RUBY
    strings = (
        r'"(?:[^"\\#]|\\.|\#(?!\{)|\#\{(?:[^{}]|\{[^{}]*\})*\})*"|\'(?:[^\'\\]|\\.)*\'|`(?:[^`\\]|\\.)*`|%[wWiIqQ]?(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\})|(?:(?<=[=(,\[!&|?{\n])|(?<=[=(,\[!&|?{] ))/(?![ =])(?:[^/\\\n]|\\.)+/[a-z]*|(?<![\w:]):(?:[A-Za-z_]\w*[?!=]?|"[^"\n]*")(?![\w:])'
    )
    comments = r"(?:(?<=\n)|\A)=begin\b.*?\n=end[^\n]*|\#[^\n]*"
    words = "def class module end if unless elsif else case when in while until for do then begin rescue ensure retry redo return break next yield super not and or alias undef BEGIN"
    name = r"(?:@{0,2}|\$)[A-Za-z_\u0080-\U0010ffff]\w*(?:[?!](?![=~]))?"
    number = r"(?:0x[\dA-Fa-f_]+|0b[01_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)r?i?\b"
    operators = "<=> === **= ||= &&= <<= >>= ... -> => == != =~ !~ <= >= && || += -= *= /= %= |= &= ^= ** .. :: &. << >>"
    cut = r"[^\n]*(?:\n|$)"

    def __init__(self) -> None:
        super().__init__()
        self.label = re.compile(r"(?<![\w:?.@$])([A-Za-z_]\w*[?!]?|\"):(?=[ \n,)}])")

    def shape(self, text: str) -> str:
        text = self.lexical.sub(self.lexed, text.replace("\r\n", "\n"))
        text = re.sub(r"\n__END__\n.*", "\n", text, flags=re.S)
        text = _SMALL_CONSTANT.sub(lambda m: m.group(1) + BAD, text)
        text = self.label.sub("\\\\L ", text)
        text = self.digits.sub("0", self.plain.sub("a", text)).replace("\\L", "L")
        text = re.sub(r"[ \t\r\f\v]+", " ", text.replace("\\\n", " "))
        text = re.sub(r" ?\n[ \n]*", "\n", text)
        text = re.sub(r"(?<=[,(\[+*/=&.<-])\n|(?<=\|\|)\n|(?<=&&)\n", " ", text)
        return re.sub(r"\n(?=\.a|&\.|[\])])", " ", text)

    def run(self, config: int, segment: str) -> int | str:
        r = self.recogniser
        for token in self.token.findall(segment):
            after = r.step(config, "nl" if token == "\n" else token)
            if after == r.stuck:
                return token
            config = after
        return config


class Indented(Language):
    """Languages whose lines and indentation are tokens: 'nl', and pseudo tokens around a deeper block."""

    enter, leave = "in_", "out_"
    opening, closing = "([{", ")]}"

    def indented(self, text: str) -> str:
        text = self.lexical.sub(self.lexed, text.replace("\r\n", "\n").replace("\r", "\n"))
        return self.digits.sub("0", self.plain.sub("a", text))

    def line_shape(self, line: str) -> str:
        return re.sub(r"[ \t\f]+", " ", line).strip()

    def advance(self, config: int, segment: str, tokens: list[str] | None = None) -> int | str:
        r = self.recogniser
        got = r.segments[config].get(segment)
        if got is None:
            got = config
            for token in tokens if tokens is not None else self.token.findall(segment):
                after = r.step(got, token)
                if after == r.stuck:
                    return token
                got = after
            r.segments[config][segment] = got
            r.remembered += 1
        return got

    def first_error(self, text: str) -> str | None:
        r = self.recogniser
        r.trim()
        config, depth, stack, narrows = r.start, 0, [0], [0]  # widths of the indentation with tabs of eight and of one
        any_line = False
        depths: dict[str, int] = {}
        for line in self.indented(text).split("\n"):
            shape = self.line_shape(line)
            if not shape:
                continue
            if not depth and not self.joined(any_line):
                head = line[: len(line) - len(line.lstrip(" \t\f"))].rpartition("\f")[2]
                width, narrow = len(head.expandtabs(8)), len(head)
                if (width > stack[-1]) != (narrow > narrows[-1]) or width == stack[-1] and narrow != narrows[-1]:
                    while len(stack) > 1 and width < stack[-1]:  # what remains must agree in both readings of a tab
                        stack.pop()
                        narrows.pop()
                        config = self.advance(config, "\x04", [self.leave])
                        if isinstance(config, str):
                            return config
                    if width != stack[-1] or narrow != narrows[-1]:
                        return shape[:1]
                if width > stack[-1]:
                    if not any_line:
                        return shape[:1]
                    stack.append(width)
                    narrows.append(narrow)
                    config = self.advance(config, "\x03", [self.enter])
                    if isinstance(config, str):
                        return config
                while width < stack[-1]:
                    stack.pop()
                    narrows.pop()
                    if width > stack[-1]:
                        return shape[:1]
                    config = self.advance(config, "\x04", [self.leave])
                    if isinstance(config, str):
                        return config
                if narrow != narrows[-1]:
                    return shape[:1]
            any_line = True
            more = depths.get(shape)
            if more is None:
                more = depths[shape] = sum(shape.count(c) for c in self.opening) - sum(shape.count(c) for c in self.closing)
            continued = shape.endswith("\\")
            self.held = continued
            config = self.advance(config, shape[:-1] if continued else shape)
            if isinstance(config, str):
                return config
            depth = max(0, depth + more)
            if not depth and not continued:
                config = self.advance(config, "\n", ["nl"])
                if isinstance(config, str):
                    return config
        if depth:
            return ""
        while len(stack) > 1:
            stack.pop()
            config = self.advance(config, "\x04", [self.leave])
            if isinstance(config, str):
                return config
        return None if not any_line or r.accepts(config) else ""

    held = False

    def joined(self, any_line: bool) -> bool:
        return any_line and self.held


class Python(Indented):
    grammar = grammars.PYTHON
    strings = r'(?:(?<!\w)[rRbBuUfFtT]{1,2})?(?:"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')'
    comments = r"\#[^\n]*"
    words = "def class if elif else for while try except finally with as import from return raise pass break continue del global nonlocal assert yield lambda in is not and or async await match case type"
    name = r"[^\W\d]\w*"
    number = r"(?:0[xX](?:_?[\dA-Fa-f])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*(?:\.(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|[eE][+-]?\d(?:_?\d)*[jJ]?|[jJ])|0(?:_?0)*|[1-9](?:_?\d)*)(?!\w)"
    operators = "**= //= >>= <<= ... := -> += -= *= /= %= @= &= |= ^= ** // << >> <= >= == !="

    def indented(self, text: str) -> str:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        parts, at = [], 0
        while m := self.lexical.search(text, at):
            if m.lastgroup == "s" and "f" in m.group()[:2].lower().partition('"')[0].partition("'")[0]:
                end = _template_end(text, m.start())
                parts += [text[at : m.start()], '"' if end else BAD]
                at = end or m.end()
            else:
                parts += [text[at : m.start()], self.lexed(m)]
                at = m.end()
        parts.append(text[at:])
        # a number that goes on as a word is one only before a keyword
        bare = _GLUED.sub(r"\1 \2", self.plain.sub("a", "".join(parts)))
        return _NO_NUMBER.sub(BAD, self.digits.sub("0", bare))

    def line_shape(self, line: str) -> str:
        shape = super().line_shape(line)
        return shape.replace("=", BAD, 1) if _LITERAL_TARGET.match(shape) else shape


_GLUED = re.compile(r"(?<![\w.])(\d+)(and|or|if|else|in|is|for|not)(?!\w)")
_NO_NUMBER = re.compile(r"(?<![\w$])\d[\d\w]+")
#: A statement that gives a literal a value.
_LITERAL_TARGET = re.compile(r"(?:0|\"|None|True|False) ?=(?!=)")
_FIELD_STRING = re.compile(r"(?:[fF][rR]?|[rR][fF])?(\"\"\"|'''|\"|')")


def _template_end(text: str, start: int) -> int | None:
    """Behind the end of the f-string that begins at start, whose fields may hold strings again; None if it or a field is not closed."""
    opening = _FIELD_STRING.match(text, start)
    quote, raw = opening.group(1), "r" in opening.group().lower()
    at, depth = opening.end(), 0
    while at < len(text):
        c = text[at]
        if not depth:
            if text.startswith(quote, at):
                return at + len(quote)
            if c == "\n" and len(quote) == 1:
                return None
            if c in "{}" and text[at + 1 : at + 2] == c:
                at += 2
            elif c == "}":
                return None
            elif c == "\\" and (not raw or text[at + 1 : at + 2] not in "{}"):
                at += text.index("}", at) + 1 - at if text.startswith("\\N{", at) and "}" in text[at:] else 2
            else:
                depth += c == "{"
                at += 1
            continue
        if c in "\"'":
            prefix = at
            while prefix > start and text[prefix - 1] in "fFrRbBuU" and at - prefix < 2:
                prefix -= 1
            plain = _PLAIN_STRING.match(text, at)
            end = _template_end(text, prefix) if "f" in text[prefix:at].lower() else plain.end() if plain else None
            if end is None:
                return None
            at = end
        elif c in "([{":
            depth += 1
            at += 1
        elif c in ")]}":
            depth -= 1
            at += 1
        elif c == ":" and depth == 1:  # a format, which may hold fields again
            at += 1
            inner = 0
            while at < len(text) and (inner or text[at] != "}"):
                if text[at] == "\n" and len(quote) == 1 or text.startswith(quote, at) and not inner:
                    return None
                inner += (text[at] == "{") - (text[at] == "}")
                at += 1
        else:
            at += 1
    return None


_PLAIN_STRING = re.compile(r"\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)


class Yaml(Indented):
    grammar = grammars.YAML
    enter, leave = "in", "out"
    opening, closing = "[{", "]}"
    operators = "--- ... <<"

    def __init__(self) -> None:
        self.recogniser = glr.Recogniser(self.grammar)
        self.flow_token = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\'|[\[\]{},]|:(?=[\s,\[\]{}]|$)|#.*|[^\s\[\]{},"\'#:](?:[^\[\]{},:#\n]|:(?=[^\s,\[\]{}])|(?<=\S)#)*|\S')
        self.key = re.compile(r'((?:"(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\'|[^\s\-?:,\[\]{}#&*!|>\'"%@`](?:[^:#\n]|:(?=\S)|(?<=\S)#)*?|[-?:](?=[^\s])(?:[^:#\n]|:(?=\S))*?))\s*:(?=\s|$)')

    def lines(self, text: str) -> Iterator[tuple[int, list[str]]]:
        """(indentation, tokens) of each logical line; block scalars and flow values over several lines are one."""
        rows = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        i = 0
        while i < len(rows):
            row = rows[i]
            i += 1
            bare = row.lstrip(" ")
            if not bare.strip() or bare.lstrip()[:1] == "#" or (bare[0] == "%" and row[0] == "%"):
                continue
            width = len(row) - len(bare)
            if bare[0] == "\t":
                yield width, [BAD]
                continue
            if re.match(r"(?:---|\.\.\.)(?:\s|$)", row):
                yield 0, [row[:3]]
                rest = row[3:].strip()
                if rest and rest[0] != "#":
                    yield 0, self.value(rest)
                continue
            tokens: list[str] = []
            rest = bare.rstrip()
            while re.match(r"-(?:\s|$)", rest):
                tokens.append("-")
                after = rest[1:].lstrip()
                rest = "" if after.startswith("#") else after
                if rest and (self.key.match(rest) or re.match(r"-(?:\s|$)", rest)):
                    inner = len(row.rstrip()) - len(rest)
                    yield width, ["-~"]
                    width, tokens = inner, []
            m = self.key.match(rest) if rest else None
            if m:
                tokens += ["<<" if m.group(1) == "<<" else '"' if m.group(1)[0] in "\"'" else "a", ":"]
                rest = rest[m.end() :].strip()
                if rest.startswith("#"):
                    rest = ""
            if rest:
                block = re.match(r"(?:[&!]\S+\s+)*[|>][+-]?\d?[+-]?\s*(?:#.*)?$", rest)
                if block:
                    tokens.append("|")
                    while i < len(rows) and (not rows[i].strip() or len(rows[i]) - len(rows[i].lstrip(" ")) > width):
                        i += 1
                else:
                    if rest[0] in "[{\"'":
                        while not self.closed(rest) and i < len(rows):
                            rest += " " + rows[i].strip()
                            i += 1
                    tokens += self.value(rest)
            yield width, tokens

    def closed(self, text: str) -> bool:
        if text[0] in "\"'":
            return bool(re.match(r'"(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\'', text))
        depth = 0
        for t in self.flow_token.findall(text):
            depth += (t in "[{") - (t in "]}") if len(t) == 1 else 0
        return depth <= 0

    def value(self, text: str) -> list[str]:
        result = []
        while m := re.match(r"([&!])\S*(?:\s+|$)", text):
            result.append("anchor" if m.group(1) == "&" else "tag")
            text = text[m.end() :]
        if not text or text[0] == "#":
            return result
        if text[0] == "*":
            return [*result, "alias"]
        if text[0] not in "[{\"'":
            plain = re.sub(r"\s#.*", "", text).strip()
            bad = plain[0] in "]},|>@`%" or re.search(r":(?:\s|$)", plain) or re.match(r"[-?:](?:\s|$)", plain)
            return [*result, BAD if bad else "a"]
        for t in self.flow_token.findall(text):
            if t[0] == "#":
                continue
            if len(t) == 1 and t in "[]{},:":
                result.append(t)
            elif t[0] in "\"'":
                result.append('"' if len(t) > 1 else BAD)
            else:
                result.append("alias" if t[0] == "*" else "a" if t[0] not in "|>@`%&!" else BAD)
        return result

    def first_error(self, text: str) -> str | None:
        r = self.recogniser
        r.trim()
        config, stack, any_line = r.start, [0], False
        if text.startswith("\ufeff"):
            text = text[1:]
        for width, tokens in self.lines(text):
            steps = []
            if not any_line and width > 0:
                stack = [width]
            if width > stack[-1]:
                stack.append(width)
                steps.append("in")
            while width < stack[-1]:
                stack.pop()
                if not stack or width > stack[-1]:
                    return "in"
                steps.append("out")
            any_line = True
            for token in [*steps, *(["-"] if tokens == ["-~"] else [*tokens, "nl"])]:
                after = r.step(config, token)
                if after == r.stuck:
                    return token
                config = after
        while len(stack) > 1:
            stack.pop()
            config = r.step(config, "out")
        return None if not any_line or r.accepts(config) else ""


class Json(Language):
    grammar = grammars.JSON
    comments = r"(?!)"
    strings = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[\dA-Fa-f]{4}))*"'
    words = "true false null"
    name = r"[A-Za-z_]\w*"
    number = r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])"
    cut = r"[^{}\n]*(?:[{}\n]|$)"

    def shape(self, text: str) -> str:
        return super().shape(text.removeprefix("\ufeff"))

    def first_error(self, text: str) -> str | None:
        return super().first_error(text) if text.strip() else ""


class Toml(Language):
    grammar = grammars.TOML
    comments = r"\#[^\n]*"
    strings = r'"""(?:[^"\\]|\\.|"(?!""))*"{3,5}|\'\'\'(?:[^\']|\'(?!\'\'))*\'{3,5}|"(?:[^"\\\n]|\\.)*"|\'[^\'\n]*\''
    words = ""
    name = r"[A-Za-z_][\w-]*"
    number = r"(?:\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d(?::\d\d(?:\.\d+)?)?|[+-]?(?:0x[\dA-Fa-f_]+|0o[0-7_]+|0b[01_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?|inf|nan))(?:[\w-]*)"
    cut = r"[^\n]*(?:\n|$)"

    def shape(self, text: str) -> str:
        return super().shape(text.replace("\r\n", "\n") + "\n")

    def run(self, config: int, segment: str) -> int | str:
        return Ruby.run(self, config, segment)


#: Extensions that are judged.
LANGUAGES = {"py": Python, "js": JavaScript, "ts": TypeScript, "rs": Rust, "go": Go, "java": Java, "c": C, "rb": Ruby, "json": Json, "toml": Toml, "yml": Yaml}
_MADE: dict[str, Language] = {}


def first_error(ext: str, text: str) -> str | None:
    """None if the text is valid for the extension's language, else the token it fails at."""
    if ext not in _MADE:
        _MADE[ext] = LANGUAGES[ext]()
    return _MADE[ext].first_error(text)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        errors = [first_error(e, t) for e, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.string())], names=["file_id", "error"])


def judged_files(files: DataFrame) -> DataFrame:
    """(file_id, error) of each file in a language with a grammar: error is null if it parses, else the token at which no parse goes on ('' at the end).

    Files with another or a null extension or a null text are not judged; an empty text parses, but for JSON. Every row is judged.
    """
    rows = files.where(F.col("ext").isin(*LANGUAGES) & F.col("text").isNotNull()).select("file_id", "ext", "text")
    return spread(rows).mapInArrow(_judge, "file_id bigint, error string")


def unparsable_files(files: DataFrame) -> DataFrame:
    """(file_id) of each file that does not parse as the language of its extension, once."""
    return judged_files(files).where(F.col("error").isNotNull()).select("file_id").distinct()


def parse_rates(files: DataFrame, reports: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_bad, rate): judged files per repo and language, the language as smart_reports names it.

    Labels differing in case or outer blanks are one; a file without a label goes by its extension.
    """
    named = reports.where(F.col("language").isNotNull()).groupBy("file_id").agg(F.max(F.lower(F.trim("language"))).alias("named"))
    known = judged_files(files).groupBy("file_id").agg(F.max(F.col("error").isNotNull()).alias("bad"))
    rows = files.select("file_id", "repo", "ext").dropDuplicates(["file_id"]).join(known, "file_id").join(named, "file_id", "left")
    bad = F.sum(F.col("bad").cast("bigint"))
    return rows.groupBy("repo", F.coalesce("named", "ext").alias("language")).agg(F.count(F.lit(1)).alias("n_files"), bad.alias("n_bad"), (bad / F.count(F.lit(1))).alias("rate"))
