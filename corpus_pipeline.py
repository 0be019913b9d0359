"""Documents through quality rules, exact and near deduplication, repeated passages and packing, each stage written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hopwise.lineage import removed, shared_folder
from hopwise.llm.common import table
from hopwise.llm.exact_dedup import survivors
from hopwise.llm.jaccard import without_similar
from hopwise.llm.packing import packed
from hopwise.llm.quality import fit_ngram_model, rule_keepers
from hopwise.llm.repeats import trimmed


#: Units that a worker remembers in packing: a third of what op5 takes, as the same workers serve the other stages.
REMEMBER = 200_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the n-gram model reject go. The model is fitted on the labelled rows of these documents."""
    return rule_keepers(docs, fit_ngram_model(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the longest stays, then the smallest doc_id."""
    return survivors(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 or more of their five-word shingles, the smallest doc_id stays.

    Texts with a band of their SimHash alike are candidates, its pivot tables discard, the shingles verify what is left.
    """
    return without_similar(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that also start elsewhere go from the texts, whole characters only; n_chars is counted anew."""
    return trimmed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence of at most 2048 tokens."""
    return packed(docs, remember=REMEMBER)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents. Between two, the rows are written as Parquet in the folder of spark.checkpoint.dir, and what the stage before has written goes."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            removed(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the model nor the fingerprints; tests/llm holds run() against brute force.
ORACLE_SQL = None
