"""Corpus pipeline over ``documents``: quality filter, exact and near de-duplication, PII redaction, packing.

Every stage works on all that its predecessor kept. All but the last return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from custodia.llm import exact_dedup, near_dup, packing, pii, quality
from custodia.llm.common import materialize, table

#: The last stage's tokenizer; a path, so that the file is never part of this repository.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what a model fitted to the labels of these documents accepts (all of them where labels hold one class only)."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the one with the largest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more of their 5-word shingles, the one with the smallest doc_id stays."""
    return near_dup.deduplicate(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in angle brackets; no document goes."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packing.digest(packing.pack(docs, TOKENIZER))


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: Fitting, fingerprints and tokenisation are not SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each stage's rows written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
