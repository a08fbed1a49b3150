"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lowered and every run of signs and white space becomes one space. An item of n characters may
differ from a stretch of a text by k = floor(RATE * n) edits. Cut into k + 1 pieces, one piece at least is
untouched in such a stretch, so exact hits of pieces, found by one Aho-Corasick automaton over all pieces, leave no match
out. The pieces are the leaves of a tree: a node with budget b is cut into two whose budgets add up to b - 1, so that
one of them is kept within its own. A hit is therefore verified from its leaf upwards, by Myers' bit-parallel edit
distance within each node's window, and chance hits end at the first node of two pieces. What the whole item's
search then finds within its budget is a match; of matches of one item that overlap the closest is kept, of
equals the first.

Items go to the tasks in blocks of a bounded number of characters, however many there are, and each block is matched
against all texts. Matches are (doc_id, item_id, start, end, distance), places in code points of the original text.

Null texts are empty. Items of under `LEAST` words and under `CHARS` characters are sought without edits and between
word borders; only items without a letter or digit have no matches. Repeated items and rows each give their own matches; null ids are kept. No items: no matches, and
nothing is dropped. Further columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_slices, record, table, text_rows

RATE = 0.1  # edits a character
LEAST = 8  # words, or
CHARS = 30  # characters, from which an item may have edits and begin or end within a word
BLOCK = 500_000  # characters of items that are matched at once
_GAP = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _GAP.sub(" ", (text or "").lower()).strip()


def places(text: str) -> list[int]:
    """For each character of `normal(text)`, the code point of `text` that it comes from; then the end."""
    plain = text.lower()
    # lowering never takes characters away, so equal lengths mean that each stands where it stood
    origin = range(len(text)) if len(plain) == len(text) else [k for k, c in enumerate(text) for _ in c.lower()]
    out: list[int] = []
    for m in re.finditer(r"[^\W_]+", plain):
        if out:
            out.append(origin[m.start() - 1])
        out += origin[m.start():m.end()]
    return out


@dataclass(frozen=True)
class Node:
    """A stretch of an item that may hold `budget` edits, and the stretch it was cut from."""

    start: int
    end: int
    budget: int
    above: Node | None


def leaves(node: Node) -> Iterator[Node]:
    if not node.budget:
        yield node
        return
    left = (node.budget - 1) // 2
    right = node.budget - 1 - left
    middle = node.start + (node.end - node.start) * (left + 1) // (node.budget + 1)
    yield from leaves(Node(node.start, middle, left, node))
    yield from leaves(Node(middle, node.end, right, node))


@lru_cache(maxsize=20_000)
def masks(text: str) -> dict[str, int]:
    """For each character, the places where the pattern has it."""
    out: dict[str, int] = {}
    for k, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << k
    return out


@lru_cache(maxsize=200_000)
def seeds(text: str, edits: int) -> tuple[str, ...]:
    """Stretches of which one at least stands in whatever is within that many edits of the text."""
    cuts = [len(text) * k // (edits + 1) for k in range(edits + 2)]
    return tuple(text[a:b] for a, b in zip(cuts, cuts[1:]))


class Item:
    def __init__(self, item_id: int | None, text: str, rate: float, least: int = 0):
        self.short = text.count(" ") + 1 < least and len(text) < CHARS
        self.item_id, self.text, self.budget = item_id, text, 0 if self.short else int(rate * len(text))
        self.peq, self.back = masks(text), masks(text[::-1])
        self.pieces = list(leaves(Node(0, len(text), self.budget, None)))

    def holds(self, node: Node, known: Node, text: str, origin: int) -> bool:
        """Whether the text has the node's stretch within its budget where the item would begin at `origin`. known: the part
        of the node that is there; the other part is sought by its seeds before edits are counted."""
        window = text[max(0, origin + node.start - node.budget):max(0, origin + node.end + node.budget)]
        part = self.text[node.start:node.end]
        other = part[:known.start - node.start] or part[known.end - node.start:]
        if not any(seed in window for seed in seeds(other, node.budget)):
            return False
        return any(True for _ in _myers(masks(part), len(part), window, node.budget, 0, True))

    def ends(self, text: str, start: int, stop: int) -> list[tuple[int, int]]:
        """(distance, end) of every end in the window where the item lies within its budget."""
        found = _myers(self.peq, len(self.text), text[start:stop], self.budget, start, True)
        return [(d, e) for d, e in found if not self.short or self._between(text, e)]

    def _between(self, text: str, end: int) -> bool:
        """Whether a short item that ends there lies between word borders."""
        first = end - len(self.text)
        return (first == 0 or text[first - 1] == " ") and (end == len(text) or text[end] == " ")

    def start(self, text: str, end: int, distance: int) -> int:
        """Where the match that ends there begins; of several places the last."""
        low = max(0, end - len(self.text) - distance)
        held = _myers(self.back, len(self.text), text[low:end][::-1], distance, 0, False)
        return end - min((d, at) for d, at in held)[1]


def _myers(peq: dict[str, int], size: int, chars, most: int, base: int, anywhere: bool) -> Iterator[tuple[int, int]]:
    """(distance, characters read + base) wherever the pattern ends within `most` edits. anywhere: it may begin at any
    character, else only at the first."""
    mask, top, first = (1 << size) - 1, 1 << size - 1, 0 if anywhere else 1
    plus, minus, score = mask, 0, size
    for at, c in enumerate(chars, base + 1):
        eq = peq.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(across | plus) & mask
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1 | first) & mask
        plus = down << 1 & mask | ~(vertical | up) & mask
        minus = up & vertical
        if score <= most:
            yield score, at


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE, least: int = LEAST):
        self.items = [Item(i, t, rate, least) for i, t in ((i, normal(t)) for i, t in items) if t]
        found: dict[str, list[tuple[int, Node]]] = {}
        for k, item in enumerate(self.items):
            for node in item.pieces:
                found.setdefault(item.text[node.start:node.end], []).append((k, node))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, uses)
        if found:
            self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """By item, the stretches of a normal text in which it may lie, overlapping ones joined."""
        out: dict[int, list[list[int]]] = {}
        for last, uses in self.automaton.iter(text) if self.items else ():
            for k, node in uses:
                item, origin = self.items[k], last + 1 - node.end
                while (above := node.above) and above.above and item.holds(above, node, text, origin):
                    node = above
                if above and above.above:
                    continue
                start, stop = origin - item.budget, origin + len(item.text) + item.budget
                held = out.setdefault(k, [])
                if held and start <= held[-1][1] and stop >= held[-1][0]:
                    held[-1] = [min(start, held[-1][0]), max(stop, held[-1][1])]
                else:
                    held.append([start, stop])
        return out

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, start, end, distance) in a normal text, without overlap within an item."""
        out = []
        for k, held in sorted(self.windows(text).items()):
            item, kept, merged = self.items[k], [], []
            for start, stop in sorted(held):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(stop, merged[-1][1])
                else:
                    merged.append([start, stop])
            ends = [e for a, b in merged for e in item.ends(text, max(0, a), min(b, len(text)))]
            for distance, end in sorted(ends):
                # what is kept lies in order and apart, so only its last ones that begin before this end can overlap
                at = last = bisect_left(kept, (end,))
                while at and kept[at - 1][1] > end - len(item.text) - item.budget:
                    at -= 1
                if not any(self._overlaps(item, text, distance, end, a, b) for a, b, _ in kept[at:last]):
                    insort(kept, (item.start(text, end, distance), end, distance))
            out += [(k, a, b, d) for a, b, d in kept]
        return out

    @staticmethod
    def _overlaps(item: Item, text: str, distance: int, end: int, a: int, b: int) -> bool:
        """Whether the match that ends there overlaps [a, b); its start is sought only where its length could decide."""
        if end <= a or end - len(item.text) - item.budget >= b:
            return False
        return end - len(item.text) + item.budget < b or item.start(text, end, distance) < b

    def find(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item_id, start, end, distance) in the original text."""
        found = self.matches(normal(text))
        if not found:
            return []
        at = places(text)
        return [(self.items[k].item_id, at[a], at[b - 1] + 1, d) for k, a, b, d in found]

    def touches(self, text: str | None) -> bool:
        plain = normal(text)
        return any(self.items[k].ends(plain, max(0, a), min(b, len(plain)))
                   for k, held in self.windows(plain).items() for a, b in held)


def blocks(items: DataFrame, id_col: str, text_col: str, block: int = BLOCK) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of about that many characters, one block at a time on the driver."""
    rows = text_rows(items, id_col, text_col)
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // block))
    for k in range(count):
        yield [(r["doc_id"], r["text"]) for r in
               rows.filter(F.pmod(F.xxhash64("text"), F.lit(count)) == k).orderBy("doc_id", "text").collect()]


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id: str = "item_id", item_text: str = "text", rate: float = RATE, least: int = LEAST,
                 block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, start, end, distance: a row for each match."""
    rows, out = text_rows(docs, id_col, text_col), None
    for held in blocks(items, item_id, item_text, block):
        found = _matched(rows, held, rate, least)
        out = found if out is None else out.union(found)
    return out


def _matched(rows: DataFrame, held: list, rate: float, least: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(held)  # BLOCK characters or one item

    def one(part):
        matcher = _matcher(shared, rate, least)
        found = [(d, *m) for d, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()) for m in matcher.find(t)]
        columns = list(zip(*found)) or [()] * 5
        return record(**{n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "item_id", "start", "end"), columns)},
                      distance=pa.array(columns[4], pa.int32()))

    return map_slices(rows, one, "doc_id long, item_id long, start long, end long, distance int")


_LAST: dict = {}


def _matcher(shared, rate: float, least: int) -> Matcher:
    """The matcher of a broadcast block, built once in a Python worker; only the last one is kept."""
    held = shared.value
    if _LAST.get("key") != (rate, least) or _LAST["items"] is not held:
        _LAST.update(key=(rate, least), items=held, matcher=Matcher(held, rate, least))
    return _LAST["matcher"]


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", rate: float = RATE, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """The rows of `docs` that no item matches."""
    place = docs.columns.index(text_col)
    for held in blocks(items, item_id, item_text, block):
        shared = docs.sparkSession.sparkContext.broadcast(held)

        def one(part, shared=shared):
            matcher = _matcher(shared, rate, least)
            return part.filter(pa.array([not matcher.touches(t) for t in part.column(place).to_pylist()], pa.bool_()))

        docs = map_slices(docs, one, docs.schema)
    return docs


def op6_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where documents hold items of the benchmark."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_pigeonhole_decontamination": op6_pigeonhole_decontamination}
ORACLE: dict[str, str] = {}
