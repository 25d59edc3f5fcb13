"""A training-data pipeline over ``documents``: STAGES in order, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphtally.llm import near, packing, quality, repeats, secrets
from graphtally.llm.common import written
from graphtally.llm.queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then documents that lost too much or fail the base rules."""
    return quality.cleaned_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each group, the one of the least id: five-word shingles, similarity 0.8 or more."""
    return near.one_of_each(docs, near.Near(words=5, percent=80))


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that occur twice go, every occurrence."""
    return repeats.without_repeats(docs, repeats.Repeats(size=50, unit="words", gram=19))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secrets.redacted(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), end_id=1, size=2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("repeat_removal", repeat_removal),
    ("secret_redaction", secret_redaction),
    ("sequence_packing", sequence_packing),
]

#: Tokenizing has no SQL; tests/llm holds the rows of run() against a plain version of all stages on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
