"""From raw documents to packed training sequences, one operator a stage.

Each stage is written as Parquet below the folder that the cluster shares and read again, so that a lost executor costs
the stage at work and no more. Stages see only what the one before them kept.

Rows. A null or empty text has no language, so its row goes in the first stage; no later stage meets one. Rows with a null
or repeated doc_id are rows of their own throughout: near-dedup keeps of each group the row of the least id, a null id
being least, and of rows with that id the one with the least hash of its text. Texts of any length are read whole; the packed
pieces are cut where the capacity asks for it. Ties of languages go to the first in the alphabet. Further columns ride
along unread up to the last stage, whatever they are called. Without benchmark items nothing is dropped for them; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontam, jaccard, langid, packing, secrets
from ledgerloom.llm.common import stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language that holds at least half of their letters."""
    return langid.keep_identified(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group linked by a Jaccard similarity of five-word shingles of 0.8 or more: SimHash
    links, verified, and the pairs that its bits do not tell."""
    return jaccard.keep_first(docs, words=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark, up to one edit in ten characters."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by their kind."""
    return secrets.scrub(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the documents' token ids in sequences of 4096."""
    return packing.pack(docs, "word_bpe_49k.json", 1)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination),
    ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing),
]

# SQL has no trained model, tokenizer or edit distance within texts: tests/llm/test_pipeline.py compares run() with the
# five stages in plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
