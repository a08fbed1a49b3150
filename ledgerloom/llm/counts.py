"""Token counts of documents, each distinct pre-token counted once.

The vocabulary cuts a text into pre-tokens before any merge, so a document's count is the sum, over its
distinct pre-tokens, of how often each occurs times its number of tokens. The distinct pre-tokens of the whole
table are grouped and the library counts each once; their counts are joined to the documents' pre-token
frequencies and summed, and no id list is kept. Pre-tokens that make up at least `SHARE` of all (there can be
no more than 1/SHARE of them, however large the table) are looked up where the texts are read; only the
rarer ones go through the shuffled join, so no frequent pre-token is a hot key. One row of each document
that holds the sum of the looked-up part takes part in the join under a key of its own.

A null text counts as empty: 0 tokens. Repeated rows and doc_ids give a row each; a null doc_id is kept. An empty
table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import record, slices, stored, table, text_rows
from ledgerloom.llm.tokens import PARTS, Encoder, Table, encoder, spelled

SHARE = 1e-6
HELD = 200_000  # distinct pre-tokens that a task adds up before it passes them on
OUT = 20_000  # rows in an output batch
LINE_FEED = spelled("\n")


def special_or_cut(encode: Encoder, text: str) -> tuple[list[str], int]:
    """The pre-tokens of a text that is not plain, as the library itself cuts it, and how many special tokens it holds."""
    pattern = "(" + "|".join(map(re.escape, encode.special)) + ")"
    stretches = re.split(pattern, text) if encode.special else [text]
    return [p for s in stretches[::2] if s for p in encode.pre_tokens(s)], len(stretches) // 2


def distinct_pieces(docs: DataFrame, vocabulary: str) -> DataFrame:
    """piece, n (occurrences), n_tokens of every distinct pre-token of the texts."""

    def tally(batches):
        encode, parts, pieces, plain = encoder(vocabulary), Counter(), Counter(), 0

        def made():
            for part, n in parts.items():
                for piece in encode.spelled_parts[part]:
                    pieces[piece] = pieces.get(piece, 0) + n
            if plain and not encode.layout.lower:  # each text's first part stands behind a line feed that it does not have
                pieces[LINE_FEED] -= plain
            return record(piece=pa.array(pieces.keys(), pa.string()), n=pa.array(pieces.values(), pa.int64()))

        for batch in slices(batches):
            for text in batch["text"].to_pylist():
                if encode.plain(text):
                    parts.update(encode.cut(text))
                    plain += 1
                else:
                    pieces.update(special_or_cut(encode, text)[0])
            if len(parts) + len(pieces) > HELD:
                yield made()
                parts, pieces, plain = Counter(), Counter(), 0
        yield made()

    def count(batches):
        tokens = encoder(vocabulary).library.model.tokenize
        for part in slices(batches, OUT):
            yield record(piece=part["piece"], n=part["n"],
                         n_tokens=pa.array([len(tokens(p)) for p in part["piece"].to_pylist()], pa.int32()))

    found = docs.select("text").mapInArrow(tally, "piece string, n long")
    return found.groupBy("piece").agg(F.sum("n").alias("n")).filter("n > 0").mapInArrow(count, "piece string, n long, n_tokens int")


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 share: float = SHARE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, one row for each row of `docs`."""
    rows = text_rows(docs, id_col, text_col)
    pieces = stored(distinct_pieces(rows, vocabulary), "pre-tokens")
    least = (pieces.agg(F.sum("n")).first()[0] or 0) * share
    common = {r["piece"]: r["n_tokens"] for r in pieces.filter(F.col("n") >= least).collect()}  # 1 / share at most
    common = docs.sparkSession.sparkContext.broadcast(common)

    def split(batches):
        encode, known = encoder(vocabulary), common.value
        key, piece, n, doc, size = [], [], [], [], []

        def divide(pieces: list[str]) -> tuple[int, tuple[str, ...]]:
            """Tokens of the pre-tokens that are looked up, and the others."""
            return sum(known.get(p, 0) for p in pieces), tuple(p for p in pieces if p not in known)

        divided = Table(lambda part: divide(encode.spelled_parts[part]), PARTS)

        def made():
            return record(row=pa.array(key, pa.int64()), piece=pa.array(piece, pa.string()), n=pa.array(n, pa.int64()),
                          doc_id=pa.array(doc, pa.int64()), n_bytes=pa.array(size, pa.int64()))

        def frequencies(text: str) -> tuple[int, dict[str, int]]:
            """The sum of the looked-up part, and how often each other pre-token occurs."""
            if not encode.plain(text):
                pieces, total = special_or_cut(encode, text)
                direct, others = divide(pieces)
                return total + direct, Counter(others)
            total, rest = 0, {}
            for part, times in Counter(encode.cut(text)).items():
                direct, others = divided[part]
                total += times * direct
                for p in others:
                    rest[p] = rest.get(p, 0) + times
            if not encode.layout.lower:
                if LINE_FEED in known:
                    total -= known[LINE_FEED]
                else:
                    rest[LINE_FEED] -= 1
            return total, rest

        for part in slices(batches):
            for row, doc_id, text in zip(*(part[c].to_pylist() for c in ("row", "doc_id", "text"))):
                total, rest = frequencies(text)
                some = [p for p, times in rest.items() if times]
                key += [row] * (len(some) + 1)
                piece += some
                piece.append(f"\0{row}")  # no pre-token: signs and digits never share one
                n += [rest[p] for p in some]
                n.append(total)
                doc += [None] * len(some)
                doc.append(doc_id)
                size += [None] * len(some)
                size.append(len(text.encode()))
            if len(key) >= OUT:
                yield made()
                for column in (key, piece, n, doc, size):
                    column.clear()
        if key:
            yield made()

    dealt = (rows.withColumn("row", F.monotonically_increasing_id())
             .mapInArrow(split, "row long, piece string, n long, doc_id long, n_bytes long"))
    rare = pieces.filter(F.col("n") < least).select("piece", "n_tokens")
    tokens = F.col("n") * F.coalesce(F.col("n_tokens"), F.lit(1))
    return (dealt.join(rare, "piece", "left").groupBy("row")
            .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
                 F.sum(tokens).alias("n_tokens")).drop("row"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has over 1024 tokens."""
    found = count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")
    return found.withColumn("over_limit", F.col("n_tokens") > 1024)


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLE: dict[str, str] = {}
