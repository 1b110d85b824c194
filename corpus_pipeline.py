"""From raw documents to token files: five stages, each stored before the next one reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from versegrid.llm import decontaminate, language, mixing, near_dedup, token_files
from versegrid.llm.common import table
from versegrid.session import stage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, by prototypes of the labelled ones and the cut-offs these give."""
    learned = language.prototypes(docs)
    return language.recognised(docs, learned, lowest=language.cutoffs(docs, learned))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more)."""
    return near_dedup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages in a twentieth of their words or more."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; the place of each document in them."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.token_index(token_files.write_tokens(docs, tokenizer, token_files.default_folder(spark)))


STAGES = [
    ("language ID", known_language), ("near duplicates", near_duplicates), ("decontamination", decontamination),
    ("mixing", mixing_sources), ("token files", token_output),
]

#: SQL can express neither the hash vectors nor the signatures; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
