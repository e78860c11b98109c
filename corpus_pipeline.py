"""From raw documents to packed training sequences: the stages, in order, and their application.

Each stage works on all rows that its predecessor kept, and its decisions take effect: repetitive
documents go, toxic documents go, one document of each group of near duplicates stays (five-word
shingles, Jaccard similarity of 0.8), passages that earlier documents hold are cut out, and what is
left is packed into sequences of at most 2048 tokens. All stages but the last return the columns of
``documents``. SQL cannot express the whole; ``tests/llm/test_stages.py`` holds each stage, on what its
predecessor kept, against a plain version of it: rules and shingles counted with dictionaries, the
field's sums word by word, cuts character by character, tokens from the library itself.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textveil.llm import common
from textveil.llm.jaccard_join import keep_first
from textveil.llm.packing import pack_documents
from textveil.llm.paragraph_dedup import remove_passages
from textveil.llm.quality_rules import keep_unrepetitive
from textveil.llm.toxicity import fit_field, keep_civil


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.importable(spark)
    return keep_unrepetitive(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.importable(spark)
    return keep_civil(docs, fit_field(docs, common.table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.importable(spark)
    return keep_first(docs, k=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.importable(spark)
    return remove_passages(docs, k=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.importable(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the table ``documents``; what each stage returns is a table in the shared folder, which goes when the next one is there."""
    docs = common.spread(common.table(spark, sf_dir, "documents"), "doc_id")
    folder, before = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        docs = common.stored_at(stage(spark, docs, sf_dir), path)
        if before is not None:
            common.deleted(spark, before)
        before = path
    return docs
