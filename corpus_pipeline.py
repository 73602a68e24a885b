"""From raw documents to training tokens: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from culvert.llm.bpe import encode_decode
from culvert.llm.common import table
from culvert.llm.kneser_ney import keep_good
from culvert.llm.mixing import mix
from culvert.llm.simhash import one_of_each
from culvert.llm.substrings import dedup_substrings
from culvert.session import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier rejects go; it is fitted on the trusted ones among its input."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked by SimHash fingerprints, those of op8, the one with the smallest id stays."""
    return one_of_each(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a window of 20 words that also starts earlier are cut; no document goes."""
    return dedup_substrings(docs).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gets the same share of the bytes by Poisson copies, in random order; copies are rows that repeat."""
    return mix(docs).select(docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their digests and those of the decoded text, instead of the text."""
    return encode_decode(docs, keep_ids=True).drop("text")


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("source mixing", mixing_stage),
    ("BPE encoding", token_stage),
]

#: the classifier, fingerprints and token ids are beyond SQL: tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
