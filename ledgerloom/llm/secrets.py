"""Secret scans: every rule in one automaton over the bytes of a text.

The rules' regular expressions become one minimal deterministic automaton (`automata`), which takes every
byte once. Bytes are taken in blocks through rows in which every accepting move leads to a trap, so that
a block without a hit costs one table look-up a byte; only a block that ends in the trap is walked again
to note where which rule accepted. Each rule's spans are then settled from those places by its own
backward automaton (leftmost start) and forward automaton (longest end), without overlap within a kind.

Null and empty texts give no span. Repeated rows give one result row each. Only id and text are read,
so further columns never clash. Spans count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import operator
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import automata
from ledgerloom.llm.common import map_slices, record, table, text_rows

BLOCK = 4096


@dataclass(frozen=True)
class Rule:
    """kind: its name. pattern: what is matched, leftmost and longest, without overlap. least: matches whose value is
    shorter are dropped after matching. value: the part of a match whose length counts."""

    kind: str
    pattern: str
    least: int = 1
    value: Callable[[bytes], bytes] = bytes

    def __reduce__(self):
        return (_rule_of, (self.kind,)) if RULES_BY_KIND.get(self.kind) is self else super().__reduce__()


def assigned(match: bytes) -> bytes:
    """What stands behind the separator and an opening quote."""
    separator = min(k for k in (match.find(b":"), match.find(b"=")) if k >= 0)
    rest = match[separator + 1:].lstrip(b" ")
    return rest[1:] if rest[:1] in (b'"', b"'") else rest


BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""",
         6, assigned),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24}[0-9a-f]*"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9\-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_\-]+", 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+", 40),
)
RULES = BASE + MORE
RULES_BY_KIND = {r.kind: r for r in RULES}


def _rule_of(kind: str) -> Rule:
    return RULES_BY_KIND[kind]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        trees = [automata.parse(r.pattern) for r in rules]
        seeks = [automata.shortest(t) for t in trees]  # else the runs at the ends multiply each other's states
        self.all = automata.compile_rules(seeks, anywhere=True)
        self.accepts = self.all.accepts.tolist()
        self.moves = self.all.next.tolist()
        self.trap: list = []
        self.trap.extend([self.trap] * 256)
        rows: list[list] = [[] for _ in self.moves]
        for row, moves in zip(rows, self.moves):
            row.extend(self.trap if self.accepts[to] else rows[to] for to in moves)
        self.rows = rows
        self.number = {id(row): state for state, row in enumerate(rows)}
        self.back = [automata.compile_rules([automata.reverse(t)], anywhere=False) for t in seeks]
        self.ahead = [automata.compile_rules([t], anywhere=False) for t in trees]
        self.single = [automata.compile_rules([t], anywhere=True) for t in seeks]
        for dfas in (self.back, self.ahead, self.single):
            for dfa in dfas:
                dfa.table = dfa.next.tolist()

    def hits(self, data: bytes) -> dict[int, tuple[int, int]]:
        """By rule, the first and the last place where it accepts."""
        found: dict[int, tuple[int, int]] = {}
        state = 0
        for start in range(0, len(data), BLOCK):
            block = data[start:start + BLOCK]
            row = reduce(operator.getitem, block, self.rows[state])
            if row is not self.trap:
                state = self.number[id(row)]
                continue
            for at, byte in enumerate(block, start + 1):
                state = self.moves[state][byte]
                rules = self.accepts[state]
                while rules:
                    rule = (rules & -rules).bit_length() - 1
                    found[rule] = (found[rule][0] if rule in found else at, at)
                    rules &= rules - 1
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, in that order."""
        out = []
        for rule, (first, last) in self.hits(data).items():
            kept = self.rules[rule]
            begin, end_of_hit = 0, first
            while True:
                start = self._leftmost(rule, data, begin, end_of_hit)
                end = self._longest(rule, data, start)
                match = data[start:end]
                if len(kept.value(match)) >= kept.least:
                    out.append((start, rule, end))
                begin = end
                if last <= begin or not (end_of_hit := self._next_hit(rule, data, begin, last)):
                    break
        return sorted(out)

    def _leftmost(self, rule: int, data: bytes, begin: int, end: int) -> int:
        dfa, state, found = self.back[rule], 0, end
        for at in range(end - 1, begin - 1, -1):
            state = dfa.table[state][data[at]]
            if state == dfa.dead:
                break
            if dfa.accepts[state]:
                found = at
        return found

    def _longest(self, rule: int, data: bytes, start: int) -> int:
        dfa, state, found = self.ahead[rule], 0, start
        for at in range(start, len(data)):
            state = dfa.table[state][data[at]]
            if state == dfa.dead:
                break
            if dfa.accepts[state]:
                found = at + 1
        return found

    def _next_hit(self, rule: int, data: bytes, begin: int, last: int) -> int:
        dfa, state = self.single[rule], 0
        for at in range(begin, last):
            state = dfa.table[state][data[at]]
            if dfa.accepts[state]:
                return at + 1
        return 0


@cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def find(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points by start, then by the rules' order."""
    data = (text or "").encode()
    found = scanner(rules).spans(data)
    if not found or len(data) == len(text):
        return [(s, rules[r].kind, e) for s, r, e in found]
    places = sorted({p for s, _, e in found for p in (s, e)})
    chars, count, before = {}, 0, 0
    for p in places:
        count, before = count + len(data[before:p].decode()), p
        chars[p] = count
    return [(chars[s], rules[r].kind, chars[e]) for s, r, e in found]


def redact(text: str, spans: list[tuple[int, str, int]], mark: str = "[{kind}]") -> str:
    """The text with each span, or run of spans that overlap, replaced by a mark of its first kind."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], mark.format(kind=kind)]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and `spans`, an array of (start, kind, end), one row for each row of `docs`."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def one(part):
        found = [[dict(zip(("start", "kind", "end"), x)) for x in find(t, rules)] for t in part["text"].to_pylist()]
        return record(doc_id=part["doc_id"], spans=pa.array(found, kind))

    return map_slices(text_rows(docs, id_col, text_col), one,
                      "doc_id long, spans array<struct<start: long, kind: string, end: long>>")


def scrub(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars",
          rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with every span replaced by its kind in brackets, and `chars_col` counted anew where the text changed."""
    place = docs.columns.index(text_col)
    length = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def one(part):
        columns, texts = list(part.columns), part.column(place).to_pylist()
        clean = [t if t is None else redact(t, find(t, rules)) for t in texts]
        columns[place] = pa.array(clean, pa.string())
        if length is not None:
            lengths = columns[length].to_pylist()
            columns[length] = pa.array([n if a == b else len(b) for n, a, b in zip(lengths, texts, clean)],
                                       columns[length].type)
        return pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return map_slices(docs, one, docs.schema)


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's spans: counts of the base kinds, hash of the base spans, all spans."""
    base = {r.kind for r in BASE}

    def one(part):
        found = [find(t) for t in part["text"].to_pylist()]
        lean = [[x for x in spans if x[1] in base] for spans in found]
        counts = {f"n_{r.kind}": pa.array([sum(x[1] == r.kind for x in spans) for spans in lean], pa.int64())
                  for r in BASE}
        return record(doc_id=part["doc_id"], **counts,
                      base_sha256=pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in lean]),
                      spans=pa.array([joined(x) for x in found], pa.string()))

    return map_slices(text_rows(table(spark, sf_dir, "documents")), one,
                      "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _oracle() -> str:
    """Positions by running lengths of the parts between and within RE2's matches, rule by rule."""
    value = r"""regexp_replace(m, '^[^:=]*[:=]\x20*["'']?', '')"""
    parts = []
    for k, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
    SELECT doc_id, {k} AS ord, '{rule.kind}' AS kind, unnest(range(1, len(ms) + 1)) AS i, ms, gaps, {rule.least} AS least
    FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps
          FROM docs) WHERE len(ms) > 0""")
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({" UNION ALL ".join(parts)}),
placed AS (
    SELECT doc_id, ord, kind, least, ms[i] AS m,
           list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
    FROM hits),
kept AS (
    SELECT doc_id, ord, kind, CAST(s AS BIGINT) AS s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(m) AS BIGINT) AS span
    FROM placed WHERE length(CASE WHEN kind = 'assign' THEN {value} ELSE m END) >= least),
sums AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
           count(*) FILTER (kind = 'hex') AS n_hex,
           coalesce(string_agg(span, ',' ORDER BY s, ord) FILTER (kind IN ({base})), '') AS lean,
           string_agg(span, ',' ORDER BY s, ord) AS spans
    FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(lean, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN sums USING (doc_id)"""


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLE = {"op1_secret_scan": _oracle()}
