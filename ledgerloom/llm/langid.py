"""Language ID: scripts narrow the candidates, word scores rate them, Viterbi labels the spans of a text.

A word's letters fall into scripts by code-point ranges; only the languages that the training texts write in that
script are candidates for it, all others get a fixed penalty. Candidates are scored by the log probabilities of the
word's character n-grams (1 to 3, with word ends) under each language, less the best one's, so that a word says how
much worse each language explains it. The best path through the words then pays `SWITCH` for every change of
language, which labels spans of mixed texts and keeps single words from flipping. A text's language is the one whose
spans hold most letters, its score their share.

Most texts are in one language throughout, which a bound proves without stepping: no stretch of words may gain as
much in another language as the changes would cost (`constant`). For the others the recursion steps through many texts at
once, each step a few array operations over all texts that reach so far.

The model is fitted on a documented bounded sample of labelled texts: `SAMPLE` documents a language, taken by a hash of the
id, and the first `WORDS` words of each. Prediction reads whole texts.

Null texts and texts without letters are `und` with score 0. Without any labelled text all are. Ties go to the
language first in the alphabet. Rows that repeat give a row each; a null doc_id is kept. Further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_slices, record, table, text_rows

UNKNOWN = "und"
SAMPLE = 400  # labelled documents a language that the model is fitted on
WORDS = 2000  # words of each of them
GRAMS = 60_000  # n-grams kept, the most frequent ones
SWITCH = 12.0  # cost of a change of language
ALIEN = 20.0  # cost of a word in a language that does not use its script
SMOOTH = 0.5
HELD = 200_000  # words whose scores one Python worker keeps

# Script ranges of the Unicode standard, first and last code point.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}
# numbers such as ½ count as word characters, but are no letters
_SIGNS = re.escape("".join(c for c in map(chr, range(0x20000)) if c.isnumeric() and not c.isdecimal() and not c.isalpha()))
_WORD = re.compile(rf"[^\W\d_{_SIGNS}]+")
_LIKELY = re.compile(r"[^\W\d_]+")  # far quicker, and the same words unless such a number is among them


def words_of(text: str) -> list[str]:
    found = _LIKELY.findall(text)
    return found if "".join(found).isalpha() else _WORD.findall(text)


def script(word: str) -> str:
    code = ord(word[0])
    return next((name for name, ranges in SCRIPTS.items() if any(a <= code <= b for a, b in ranges)), "other")


def grams(word: str) -> list[str]:
    held = f" {word} "
    return [held[k:k + n] for n in (1, 2, 3) for k in range(len(held) - n + 1) if held[k:k + n] != " "]


class _Rated:
    """The words that the last model used in this Python worker has rated: known, word to row of rows."""

    model, known, rows = None, {}, np.empty((0, 0))


_RATED = _Rated()


@dataclass
class Model:
    """languages in order; rows: log probabilities under each, by the n-gram's number in `weights`, the last row for all
    others; scripts: by script, which languages use it."""

    languages: list[str]
    weights: dict[str, int]
    rows: np.ndarray
    scripts: dict[str, np.ndarray]

    def __post_init__(self):
        """By length of n-gram, their codes in order and their numbers in `rows`."""
        self.codes = {}
        for n in (1, 2, 3):
            own = [g for g in self.weights if len(g) == n]
            codes = _packed(_points("".join(own)).reshape(-1, n).T) if own else np.zeros(0, np.int64)
            order = np.argsort(codes)
            self.codes[n] = codes[order], np.array([self.weights[g] for g in own], np.int64)[order]

    def rate(self, words: list[str]) -> np.ndarray:
        """A row a word: 0 for the language that explains it best, less for the others."""
        points = _points(" " + "  ".join(words) + " ")
        of = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
        total = np.zeros((len(words), len(self.languages)))
        for n, (codes, numbers) in self.codes.items():
            count = len(points) - n + 1
            at = np.flatnonzero((of[:count] == of[n - 1:]) if n > 1 else points != ord(" "))
            wanted = _packed([points[at + k] for k in range(n)])
            row = np.full(len(at), -1)
            if len(codes):
                place = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
                row = np.where(codes[place] == wanted, numbers[place], -1)
            firsts = np.searchsorted(of[at], np.arange(len(words)))
            total += np.add.reduceat(self.rows[row], firsts, axis=0)
        for name, uses in self.scripts.items():
            if uses.any() and not uses.all():
                of = np.array([script(w) == name for w in words])
                total[of] = np.where(uses, total[of], total[of][:, uses].min(axis=1, keepdims=True) - ALIEN)
        return total - total.max(axis=1, keepdims=True)

    def scores(self, words: list[str]) -> np.ndarray:
        held = _RATED
        if held.model is not self:
            held.model, held.known, held.rows = self, {}, np.empty((0, 0))
        known = held.known
        new = list({w for w in words if w not in known})
        if new:
            if len(known) + len(new) > HELD:
                known.clear()
                new = list(set(words))
            size = len(known)
            if size + len(new) > len(held.rows):
                grown = np.empty((2 * (size + len(new)), len(self.languages)))
                if size:
                    grown[:size] = held.rows[:size]
                held.rows = grown
            held.rows[size:size + len(new)] = self.rate(new)
            known.update(zip(new, range(size, size + len(new))))
        return held.rows[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def paths(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The language of each word on each text's best path."""
        sizes = np.array(list(map(len, texts)))
        scores = self.scores([w for t in texts for w in t])
        held, alike = np.split(scores, np.cumsum(sizes)[:-1]), constant(scores, sizes, SWITCH)
        mixed = [k for k, a in enumerate(alike) if a < 0]
        out = [np.full(n, a) for n, a in zip(sizes, alike)]
        for k, path in zip(mixed, viterbi([held[k] for k in mixed], SWITCH) if mixed else []):
            out[k] = path
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, language) in code points; a span reaches from its first word to its last."""
        found = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text or "")]
        if not found or not self.languages:
            return []
        path = self.paths([[w.lower() for _, _, w in found]])[0].tolist()
        out: list[tuple[int, int, str]] = []
        for (start, end, _), k, before in zip(found, path, [None, *path]):
            first = out.pop()[0] if k == before else start
            out.append((first, end, self.languages[k]))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        words = [words_of((t or "").lower()) if self.languages else [] for t in texts]
        out = [(UNKNOWN, 0.0)] * len(texts)
        some = [k for k, w in enumerate(words) if w]
        for k, path in zip(some, self.paths([words[k] for k in some]) if some else []):
            letters = np.bincount(path, weights=np.fromiter(map(len, words[k]), float, len(path)),
                                  minlength=len(self.languages))
            best = int(letters.argmax())
            out[k] = self.languages[best], float(letters[best] / letters.sum())
        return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


def _packed(points) -> np.ndarray:
    """Code points side by side as one number each; a code point has 21 bits."""
    out = np.zeros_like(points[0])
    for p in points:
        out = out << 21 | p
    return out


def constant(scores: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """For each text (scores of all their words, one after the other) the state that its whole best path is in, -1 where
    that is not proven.

    Against the state that is best overall, a run of k stretches in other states within the text costs k + 1 changes, at
    an edge k, over the whole text k - 1. So it never pays if no stretch gains a change's cost, and no prefix and suffix
    together do.
    """
    ends = np.cumsum(sizes)
    firsts, of = ends - sizes, np.repeat(np.arange(len(sizes)), sizes)
    best = np.add.reduceat(scores, firsts, axis=0).argmax(axis=1)
    gains = np.cumsum(scores - scores[np.arange(len(scores)), best[of]][:, None], axis=0)
    gains -= np.concatenate([np.zeros((1, scores.shape[1])), gains[ends[:-1] - 1]])[of]
    before = np.concatenate([np.zeros((1, scores.shape[1])), gains[:-1]])
    before[firsts] = 0.0
    room = np.ptp(gains) + np.ptp(before) + 1.0  # each text's values below the last one's, so that a running least starts anew
    lowest = np.minimum.accumulate(before - of[:, None] * room, axis=0) + of[:, None] * room
    inside = np.maximum.reduceat((gains - lowest).max(axis=1), firsts)
    others = np.arange(scores.shape[1]) != best[:, None]
    last = gains[ends - 1]
    prefix = np.where(others, np.maximum.reduceat(gains, firsts, axis=0), -np.inf).max(axis=1)
    suffix = np.where(others, last - np.minimum.reduceat(before, firsts, axis=0), -np.inf).max(axis=1)
    whole = np.where(others, last, -np.inf).max(axis=1)
    safe = switch - 1e-5
    sure = (inside < safe) & (prefix < safe) & (suffix < safe) & (prefix + suffix < safe) & (whole < -1e-5)
    return np.where(sure, best, -1)


def viterbi(texts: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """For each text's scores (words by states, at least one word), the best path where a change costs `switch`."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    sizes = np.array([len(texts[k]) for k in order])
    firsts = np.cumsum([0, *sizes[:-1]])
    scores = np.concatenate([texts[k] for k in order])
    reach = len(order) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")  # texts with more than t words
    best, states = scores[firsts].copy(), np.arange(scores.shape[1], dtype=np.int16)
    back = np.zeros(scores.shape, np.int16)
    for t in range(1, sizes[0]):
        n = reach[t]
        rows, held = firsts[:n] + t, best[:n]
        top = held.argmax(axis=1)
        moved = held[np.arange(n), top] - switch
        stay = held >= moved[:, None]
        back[rows] = np.where(stay, states, top[:, None])
        best[:n] = np.where(stay, held, moved[:, None]) + scores[rows]
    at, path = best.argmax(axis=1), np.empty(len(scores), np.int64)
    for t in range(sizes[0] - 1, -1, -1):
        n = reach[t]
        rows = firsts[:n] + t
        path[rows] = at[:n]
        at[:n] = back[rows, at[:n]]
    out: list = [None] * len(texts)
    for k, first, size in zip(order, firsts, sizes):
        out[k] = path[first:first + size]
    return out


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> DataFrame:
    """lang and text of at most `sample` documents a language, by a hash of the id; texts that hold nothing are not taken."""
    rows = (docs.filter(docs[lang_col].isNotNull() & docs[text_col].isNotNull())
            .select(docs[id_col].alias("doc_id"), docs[lang_col].alias("lang"), docs[text_col].alias("text")))
    sizes = rows.groupBy("lang").count().collect()  # a row a language
    order = F.xxhash64("doc_id")
    share = (F.pmod(order, F.lit(1 << 30)) / (1 << 30)).cast("double")
    # what a language's share of all hashes leaves is a few times the sample, which a task can rank
    limits = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], 3 * sample / r["count"])])
    likely = share <= limits[F.col("lang")] if sizes else F.lit(False)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))
    return rows.filter(likely).withColumn("rank", rank).filter(F.col("rank") <= sample).select("lang", "text")


def fit(sample: DataFrame) -> Model:
    """The model of a bounded sample (lang, text): n-grams are counted on Spark, a bounded table of them comes back."""

    def tally(batches):
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                words = words_of(text.lower())[:WORDS]
                seen = found.setdefault(lang, Counter())
                for w in words:
                    seen.update(grams(w))
                    seen["script:" + script(w)] += 1
            rows = [(lang, g, n) for lang, c in found.items() for g, n in c.items()]
            if rows:
                lang, gram, n = zip(*rows)
                yield record(lang=pa.array(lang, pa.string()), gram=pa.array(gram, pa.string()), n=pa.array(n, pa.int64()))

    counts = sample.mapInArrow(tally, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = [tuple(r) for r in counts.collect()]
    languages = sorted({r[0] for r in rows})
    place = {x: k for k, x in enumerate(languages)}
    table_, scripts = {}, {}
    for lang, gram, n in rows:
        into = scripts if gram.startswith("script:") else table_
        into.setdefault(gram.removeprefix("script:"), np.zeros(len(languages)))[place[lang]] += n
    kept = sorted(table_, key=lambda g: (-table_[g].sum(), g))[:GRAMS]
    totals = {n: sum((table_[g] for g in kept if len(g) == n), np.zeros(len(languages))) + SMOOTH * len(kept) for n in (1, 2, 3)}
    rows = np.array([*(np.log((table_[g] + SMOOTH) / totals[len(g)]) for g in kept), np.log(SMOOTH / totals[3])])
    whole = sum(scripts.values(), np.zeros(len(languages)))
    return Model(languages, {g: k for k, g in enumerate(kept)}, rows, {s: n > 0.001 * whole for s, n in scripts.items()})


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    return fit(labelled_sample(docs, id_col, text_col, lang_col))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, one row for each row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(part):
        found = shared.value.predict(part["text"].to_pylist())
        return record(doc_id=part["doc_id"], lang_pred=pa.array([f[0] for f in found], pa.string()),
                      score=pa.array([f[1] for f in found], pa.float64()))

    return map_slices(text_rows(docs, id_col, text_col), one, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose text has a language with at least that score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def one(part):
        found = shared.value.predict(part.column(place).to_pylist())
        return part.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return map_slices(docs, one, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Whether the query's model may not learn from a document."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~F.coalesce(held_out(docs["doc_id"]), F.lit(True))))
    return (identify(docs, model)
            .select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score"))


QUERIES = {"op3_language_id": op3_language_id}
ORACLE: dict[str, str] = {}
