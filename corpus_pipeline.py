"""A corpus pipeline of five stages over documents; each is written and read again before the next.

All stages but the last return the columns of documents, whatever these are called; an empty table gives an empty table.
Null texts count as empty and stay null; a null id is an id of its own; rows are told apart by id and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framequery.llm import jaccard, mixing, packing, secrets, toxicity
from framequery.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from the table's own labels; documents that it finds toxic go. Without labels of both kinds none
    goes; empty texts stay; repeated rows go or stay together; texts are scored whole, however long."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the least id (nulls last), then the least text. All texts
    without words are one group; rows of one id whose texts differ stay as long as their groups do."""
    return jaccard.one_row_of_each_class(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts, and n_chars follows; no document goes, and repeated rows are masked alike."""
    return secrets.redact(docs, length_col="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; texts without words are never taken; null sources are one source."""
    return mixing.sampled(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each with its place in a sequence. An empty text is one piece, a long one several; repeated
    rows are packed like others."""
    return packing.pack(packing.token_pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("source_mix", mix),
    ("best_fit_packing", pack),
]

#: SQL expresses neither the fitted model nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
