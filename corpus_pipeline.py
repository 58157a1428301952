"""The corpus pipeline: toxicity, exact dedup, MinHash near-dedup, benchmark decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papyrine.llm.common import Scratch, table
from papyrine.llm.decontaminate import drop_contaminated
from papyrine.llm.exact_dedup import drop_exact_copies
from papyrine.llm.near_dedup import drop_near_copies
from papyrine.llm.packing import pack
from papyrine.llm.tokens import tokenizer_file
from papyrine.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject.

    Each row is judged by its own text; null text is empty, null ids and repeated rows are rows like others. Without
    labels of both classes nothing that isn't labelled toxic throughout is rejected; an empty table stays empty.
    """
    return drop_toxic(spark, docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id. Null text equals empty text; a null id is smaller than
    all others. Rows that repeat an id with one text are one document each time they come; none of them is lost."""
    return drop_exact_copies(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id. Texts without words, null ones too, are near to
    nothing and stay, as rows without an id do. Rows that repeat an id stay or go together."""
    return drop_near_copies(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Null texts and items have no words; rows go by id and text, so
    of rows that repeat an id, null among them, those without a window stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left in training sequences. Each row is packed, repeated ones too; null text is its end id
    alone, a null id stays null."""
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: The classifier, the signatures and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what a stage returns is written and reread as the next one's documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
