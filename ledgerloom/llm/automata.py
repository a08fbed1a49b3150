"""Regular expressions to deterministic byte automata: parsing, subset construction, minimisation.

The dialect: literals, `.`-free classes, escapes `\\xHH` and `\\` + punctuation, groups (`(...)`, `(?:...)`,
`(?i:...)` for ASCII letters in either case), `|`, `?`, `*`, `+`, `{m}`, `{m,}` and `{m,n}`. Patterns are ASCII.
"""

from __future__ import annotations

import numpy as np

STAR, PLUS, MAYBE = (0, None), (1, None), (0, 1)


class _Parser:
    """Recursive descent to a tree of ("set", frozenset), ("cat", parts), ("alt", parts), ("rep", part, lo, hi)."""

    def __init__(self, pattern: str):
        self.text, self.at, self.fold = pattern, 0, False

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def parse(self):
        tree = self.alternatives()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.peek()!r} at {self.at} in {self.text!r}")
        return tree

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        part = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                end = self.text.index("}", self.at)
                lo, comma, hi = self.text[self.at:end].partition(",")
                self.at = end + 1
                bounds = int(lo), (int(hi) if hi else None) if comma else int(lo)
            else:
                bounds = {"?": MAYBE, "*": STAR, "+": PLUS}[c]
            part = ("rep", part, *bounds)
        return part

    def atom(self):
        c = self.take()
        if c == "(":
            outer = self.fold
            if self.text.startswith("?:", self.at):
                self.at += 2
            elif self.text.startswith("?i:", self.at):
                self.at, self.fold = self.at + 3, True
            tree = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"unclosed group in {self.text!r}")
            self.fold = outer
            return tree
        if c == "[":
            return self.klass()
        return ("set", self.cased({self.escaped() if c == "\\" else ord(c)}))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2:self.at], 16)
        if c.isalnum():
            raise ValueError(f"escape \\{c} is not in this dialect")
        return ord(c)

    def klass(self):
        negated = self.peek() == "^"
        if negated:
            self.take()
        found: set[int] = set()
        while (c := self.take()) != "]":
            low = self.escaped() if c == "\\" else ord(c)
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                c = self.take()
                found |= set(range(low, (self.escaped() if c == "\\" else ord(c)) + 1))
            else:
                found.add(low)
        return ("set", frozenset(range(256)) - found if negated else self.cased(found))

    def cased(self, found: set[int]) -> frozenset[int]:
        both = {b ^ 32 for b in found if chr(b).isascii() and chr(b).isalpha()} if self.fold else set()
        return frozenset(found | both)


def parse(pattern: str):
    return _Parser(pattern).parse()


def reverse(tree):
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", reverse(tree[1]), *tree[2:])
    parts = [reverse(p) for p in tree[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


def shortest(tree):
    """The tree without what its last part may repeat: accepts where a match is first complete."""
    if tree[0] == "rep":
        return ("cat", [tree[1]] * tree[2])
    if tree[0] == "cat":
        parts = list(tree[1])
        while parts:
            last = shortest(parts.pop())
            if last != ("cat", []):
                return ("cat", [*parts, last])
        return ("cat", [])
    return tree


class _Nfa:
    """States with empty moves and byte-set moves."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Wires `tree` behind `start`; its end state."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(part, first)].append(end)
            return end
        _, part, lo, hi = tree
        for _ in range(lo):
            start = self.add(part, start)
        end = self.state()
        if hi is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        for _ in range(hi - lo):
            self.empty[start].append(end)
            start = self.add(part, start)
        self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)


class Dfa:
    """`next[state, byte]`, `accepts[state]` as a bit set of rule numbers; state 0 starts, `dead` leads nowhere (or -1)."""

    def __init__(self, following: np.ndarray, accepts: np.ndarray):
        self.next, self.accepts = following, accepts
        stuck = (following == np.arange(len(following))[:, None]).all(axis=1) & (accepts == 0)
        self.dead = int(np.flatnonzero(stuck)[0]) if stuck.any() else -1

    def __len__(self) -> int:
        return len(self.next)


def compile_rules(trees: list, anywhere: bool) -> Dfa:
    """One minimal automaton for all trees. anywhere: matches may begin at every byte."""
    nfa = _Nfa()
    start = nfa.state()
    ends = {}
    for rule, tree in enumerate(trees):
        first = nfa.state()
        nfa.empty[start].append(first)
        ends[nfa.add(tree, first)] = 1 << rule
    kinds, of_byte = _byte_classes(nfa)
    begin = nfa.closure([start])
    number, order, rows = {begin: 0}, [begin], []
    for states in order:  # grows while it is walked
        row = []
        for byte in kinds:
            to = {t for s in states for found, t in nfa.moves[s] if byte in found}
            target = nfa.closure(to | {start}) if anywhere else nfa.closure(to)
            if target not in number:
                number[target] = len(order)
                order.append(target)
            row.append(number[target])
        rows.append(row)
    accepts = np.array([sum({ends[s] for s in states if s in ends}) for states in order], dtype=np.int64)
    return _minimal(np.array(rows, dtype=np.int64), accepts, of_byte)


def _byte_classes(nfa: _Nfa) -> tuple[list[int], np.ndarray]:
    """One byte of each class of bytes that no move tells apart, and each byte's class."""
    sets = sorted({found for moves in nfa.moves for found, _ in moves}, key=sorted)
    marks = [tuple(b in found for found in sets) for b in range(256)]
    number = {m: k for k, m in enumerate(dict.fromkeys(marks))}
    first = {number[m]: b for b, m in reversed(list(enumerate(marks)))}
    return [first[k] for k in range(len(number))], np.array([number[m] for m in marks])


def _minimal(rows: np.ndarray, accepts: np.ndarray, of_byte: np.ndarray) -> Dfa:
    """Partition refinement: states stay together while their moves lead to the same blocks."""
    _, block = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[rows]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    renamed = {int(b): k for k, b in enumerate(dict.fromkeys(block.tolist()))}  # the start's block comes first
    block = np.array([renamed[int(b)] for b in block])
    _, leaders = np.unique(block, return_index=True)
    return Dfa(block[rows[leaders]][:, of_byte], accepts[leaders])
