"""A table-driven recogniser for bundled grammars, ambiguous ones included.

The LR(0) tables are built as they are needed and reductions are filtered by follow sets. All stacks that may still lead to a parse are
kept at once; stacks are interned linked lists and a set of stacks is one configuration, so that what a whole segment of tokens
does to a configuration is remembered and replayed with one dictionary lookup.
"""

from __future__ import annotations

import re
from itertools import product

_META = re.compile(r"'[^']+'|[A-Za-z_]\w*|[|()?*+%]")
#: The end of a text, no token of any language.
END = "\x00"
#: Remembered steps; beyond it the tables of steps are emptied.
REMEMBERED = 400_000


def read_grammar(text: str) -> dict[str, list[tuple[str, ...]]]:
    """Rules `name: alternatives`, one a line; 'token', rule, ( ), ?, *, + and `X % ','` for a separated list. No rule is empty."""
    rules: dict[str, list[tuple[str, ...]]] = {}

    def fresh(base: str, alternatives: list[tuple[str, ...]]) -> str:
        key = tuple(alternatives)
        if key not in made:
            made[key] = f"{base}~{len(made)}"
            rules[made[key]] = alternatives
        return made[key]

    def repeat(base: str, item: list[tuple[str, ...]], sep: tuple[str, ...] = ()) -> str:
        one = item[0][0] if len(item) == 1 and len(item[0]) == 1 else fresh(base, item)
        name = f"{base}~{one}~{'~'.join(sep)}"
        rules[name] = [(one,), (name, *sep, one)]
        return name

    made: dict[tuple, str] = {}
    for line in filter(None, re.sub(r"\n[ \t]+", " ", text.strip()).split("\n")):
        name, _, body = line.partition(":")
        name, parts, at = name.strip(), _META.findall(body), 0

        def alternatives() -> list[tuple[str, ...]]:
            nonlocal at
            result = sequence()
            while at < len(parts) and parts[at] == "|":
                at += 1
                result += sequence()
            return result

        def sequence() -> list[tuple[str, ...]]:
            nonlocal at
            pieces: list[list[tuple[str, ...]]] = []
            while at < len(parts) and parts[at] not in "|)":
                x = parts[at]
                at += 1
                if x == "(":
                    item = alternatives()
                    at += 1
                else:
                    item = [(x,)]
                while at < len(parts) and parts[at] in "?*+%":
                    op = parts[at]
                    at += 1
                    if op == "?":
                        item = [*item, ()]
                    elif op == "%":
                        item, at = [(repeat(name, item, (parts[at],)),)], at + 1
                    else:
                        item = [(repeat(name, item),)] + ([()] if op == "*" else [])
                if len(item) > 2 and () not in item or len(item) > 3:
                    empty = () in item
                    item = [(fresh(name, [i for i in item if i]),)] + ([()] if empty else [])
                pieces.append(item)
            return [sum(c, ()) for c in product(*pieces)]

        rules[name] = list(dict.fromkeys(a for a in alternatives() if a))
    return rules


class Recogniser:
    """Recognises token streams of a grammar whose start rule is `program`; tokens are the quoted words."""

    def __init__(self, grammar: str) -> None:
        rules = read_grammar(grammar)
        self.productions: list[tuple[str, tuple[str, ...]]] = [("", ("program", f"'{END}'"))]
        self.of: dict[str, list[int]] = {}
        for left, alternatives in rules.items():
            for right in alternatives:
                self.of.setdefault(left, []).append(len(self.productions))
                self.productions.append((left, right))
        missing = {x for _, right in self.productions for x in right if x[0] != "'" and x not in self.of}
        if missing:
            raise ValueError(f"no rule for {sorted(missing)}")
        self.tokens = {x[1:-1] for _, right in self.productions for x in right if x[0] == "'"} - {END}
        self._follow_sets()
        self._reset()

    def _follow_sets(self) -> None:
        first: dict[str, set[str]] = {}
        changed = True
        get = lambda x: {x[1:-1]} if x[0] == "'" else first.setdefault(x, set())
        while changed:
            changed = False
            for left, right in self.productions:
                mine = first.setdefault(left, set())
                before = len(mine)
                mine |= get(right[0])
                changed |= len(mine) > before
        follow: dict[str, set[str]] = {left: set() for left, _ in self.productions}
        changed = True
        while changed:
            changed = False
            for left, right in self.productions:
                for i, x in enumerate(right):
                    if x[0] == "'":
                        continue
                    more = get(right[i + 1]) if i + 1 < len(right) else follow[left]
                    if not more <= follow[x]:
                        follow[x] |= more
                        changed = True
        self.follow = follow

    def _reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.items: list[frozenset] = []
        self.gotos: list[dict[str, int | None]] = []
        self.reduces: list[list[tuple[str, int, set[str]]]] = []
        self.moves: list[dict[str, list]] = []
        self.nodes: dict[tuple[int, int], int] = {}
        self.node_state, self.node_parent = [], []
        self.configs: dict[frozenset[int], int] = {}
        self.config_nodes: list[frozenset[int]] = []
        self.steps: list[dict[str, int]] = []
        #: What whole segments do, by configuration.
        self.segments: list[dict[str, int]] = []
        self.remembered = 0
        start = self._state(frozenset({(0, 0)}))
        self.start = self._config(frozenset({self._node(start, -1)}))
        self.stuck = self._config(frozenset())

    def _state(self, kernel: frozenset) -> int:
        got = self.states.get(kernel)
        if got is not None:
            return got
        items, todo, done = set(kernel), list(kernel), set()
        while todo:
            p, dot = todo.pop()
            right = self.productions[p][1]
            if dot < len(right) and right[dot][0] != "'" and right[dot] not in done:
                done.add(right[dot])
                for q in self.of[right[dot]]:
                    if (q, 0) not in items:
                        items.add((q, 0))
                        todo.append((q, 0))
        number = self.states[kernel] = len(self.items)
        self.items.append(frozenset(items))
        moves: dict[str, list] = {}
        for p, dot in items:
            right = self.productions[p][1]
            if dot < len(right):
                moves.setdefault(right[dot].strip("'") if right[dot][0] == "'" else "<" + right[dot], []).append((p, dot + 1))
        self.moves.append(moves)
        self.gotos.append({})
        self.reduces.append([(self.productions[p][0], len(self.productions[p][1]), self.follow[self.productions[p][0]]) for p, dot in items if dot == len(self.productions[p][1]) and p])
        return number

    def _goto(self, state: int, symbol: str) -> int | None:
        known = self.gotos[state]
        if symbol not in known:
            kernel = self.moves[state].get(symbol)
            known[symbol] = None if kernel is None else self._state(frozenset(kernel))
        return known[symbol]

    def _node(self, state: int, parent: int) -> int:
        key = (state, parent)
        got = self.nodes.get(key)
        if got is None:
            got = self.nodes[key] = len(self.node_state)
            self.node_state.append(state)
            self.node_parent.append(parent)
        return got

    def _config(self, nodes: frozenset[int]) -> int:
        got = self.configs.get(nodes)
        if got is None:
            got = self.configs[nodes] = len(self.config_nodes)
            self.config_nodes.append(nodes)
            self.steps.append({})
            self.segments.append({})
        return got

    def step(self, config: int, token: str) -> int:
        """The configuration after one token; self.stuck if no stack can take it."""
        got = self.steps[config].get(token)
        if got is not None:
            return got
        shifted, seen = set(), set(self.config_nodes[config])
        work = list(seen)
        while work:
            node = work.pop()
            state = self.node_state[node]
            after = self._goto(state, token)
            if after is not None:
                shifted.add(self._node(after, node))
            for left, length, follow in self.reduces[state]:
                if token in follow:
                    below = node
                    for _ in range(length):
                        below = self.node_parent[below]
                    reduced = self._node(self._goto(self.node_state[below], "<" + left), below)
                    if reduced not in seen:
                        seen.add(reduced)
                        work.append(reduced)
        got = self.steps[config][token] = self._config(frozenset(shifted))
        self.remembered += 1
        return got

    def accepts(self, config: int) -> bool:
        return self.step(config, END) != self.stuck

    def trim(self) -> None:
        """Between texts: forget the steps once they are too many."""
        if self.remembered > REMEMBERED or len(self.node_state) > 4 * REMEMBERED:
            self._reset()
