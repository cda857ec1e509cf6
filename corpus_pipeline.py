"""A training corpus from ``documents``: rejected, repeated, near-copied and contaminated documents go, the rest is packed.

Defined results: a null text has no words and goes in the first stage; a null doc_id is an id like others (the first in order);
rows equal in doc_id and text are one document for line dedup and one row after the join; an empty table gives no pieces;
further columns of any name are kept by all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontamination, jaccard_join, line_dedup, packing, quality_rules
from weftline.llm.common import staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees; null and short texts go. Without labels of both classes the trees pass all."""
    return quality_rules.keep_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line of the corpus is like; n_chars follows the text. No row goes, even if no
    line is left."""
    return line_dedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the similarity join links, that of the least id (null comes last); texts without words stay."""
    return jaccard_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Without items all stay."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_copies),
    ("decontamination", decontaminated),
    ("best_fit_packing", packed),
]

#: Boosted trees, tokenizers and components are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
