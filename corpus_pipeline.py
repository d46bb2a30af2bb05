"""A training corpus from `documents`: toxic ones out, near-duplicates out, repeated passages cut,
sources mixed to weights, and what is left packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkpact.llm.common import Scratch, table
from sparkpact.llm.jaccard import keep_one
from sparkpact.llm.mixing import mixed
from sparkpact.llm.packing import pack
from sparkpact.llm.queries import vocabulary
from sparkpact.llm.suffix import cut_repeats
from sparkpact.llm.toxicity import score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Null and empty texts stay; copies share their fate;
    very long texts are scored whole; all columns stay as they are, and an empty table stays empty."""
    kept = score_toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0")
    return kept.select(*(f"`{c}`" for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: the one of the smallest
    doc_id (null last; ties by a hash of the text, then one of equal rows). Texts without words all stay."""
    return keep_one(docs, shingle=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more that were seen before, in order of doc_id (null first), are cut out;
    documents of which nothing is left go. Null, empty and short texts stay; n_chars is counted anew."""
    return cut_repeats(docs, width=100)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them. Null is a source; texts without words
    are never taken; sources that tie are told apart by name."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row per piece of a document. Null texts are empty and give one piece; long ones
    are cut; repeated rows are packed each."""
    return pack(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("source_mixing", source_mix),
    ("best_fit_packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again by the next. What a stage wrote
    besides is freed when its result is written."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with Scratch.passing():
            docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
