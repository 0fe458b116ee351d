"""A corpus pipeline: quality rules, quality classifier, near-duplicates, mixing, packing. Each stage is one operator over all that its predecessor kept.

Defined results: an empty table gives an empty table after every stage, with its columns; columns beyond those of documents pass through, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from junctura.llm import mix, packing, quality, rules, simhash
from junctura.llm.common import cut, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Null, empty and short texts fail the base rules; repeated rows are judged alike; a null language is a stratum of its own."""
    return rules.keep(docs, read_table(spark, sf_dir, "labels"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 go. Without labels of both classes among the stage's documents every score is 0.5 and all stay; repeated rows score alike."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest doc_id, null last, and one of rows that are equal in doc_id and text. Texts without words are one group."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, from never to three times. A null source is a source of its own; texts without words weigh nothing."""
    return mix.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its sequence and offset. A null or empty text is one piece, the end id; repeated rows are packed once each."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: Fitted models, certified cutoffs, components and a random rounding are not expressible in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
