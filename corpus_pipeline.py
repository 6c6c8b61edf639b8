"""From raw documents to token digests: each stage works on all that the one before kept.

Language ID drops texts without a language, SimHash keeps one document of each group
of near duplicates, decontamination drops documents with too much of a benchmark in
them, the secret scan marks secrets out of the texts, and byte-level BPE encodes what
is left and decodes it again.

Defined cases: null and empty texts and those without letters have no language and go in
the first stage; rows with a null doc_id are kept like others, the last of their group of
near duplicates; repeated rows are near duplicates of each other, one stays; other columns
are carried through all stages but the last, whatever their names; texts of any length are
taken whole; an empty table gives no rows. The last stage returns digests of each text's
token ids and of the bytes that they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, common, decontam, langid, registry, secrets, simhash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, registry.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(docs, registry.tokenizer_path(registry.MULTI_RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", tokens),
]

#: A trained network and XXH64 are beyond SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = registry.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
