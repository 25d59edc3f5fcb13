"""The operators' queries over the tables of a folder; each returns its contract's digest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, near, negatives, packing, periods, pieces, postings, quality, repeats, secrets, sharding, wavelet, webp


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str) -> str:
    """The text of a public vocabulary file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["kind"].isin(*secrets.BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in secrets.BASE]
    return found.select("row.doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op2_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media(documents(spark, sf_dir).select("doc_id", "text")).drop("media")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(documents(spark, sf_dir).select("doc_id", "text", "lang"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.quality(documents(spark, sf_dir).select("doc_id", "text"))
    return q.select("row.doc_id", *[F.col(f"q.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "words_left")])


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(documents(spark, sf_dir).select("doc_id", "text"), 24)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        proto = f.read()
    return pieces.digests(documents(spark, sf_dir).select("doc_id", "text"), proto)


def op7_radix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return repeats.remove_repeats(docs, repeats.Repeats(size=400, unit="bytes", gram=145), repeats.Repeats(size=50, unit="words", gram=19))


def op8_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), near.Near(words=4, percent=80))


def op9_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"), end_id=1, size=2048)


def op10_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = wavelet.write_and_read(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_file("byte_bpe_50k.json"), end_id=0)
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), postings.Search(window=10, span=15))


def op12_full_sort_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", moved.alias("label"))
    return negatives.mine(rows)


def op13_lpf_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periodic_runs(documents(spark, sf_dir), tails=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_lossless_webp": op2_lossless_webp,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op5_feistel_shards": op5_feistel_shards,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_radix_repeats": op7_radix_repeats,
    "op8_minhash_bayes": op8_minhash_bayes,
    "op9_histogram_packing": op9_histogram_packing,
    "op10_wavelet_shards": op10_wavelet_shards,
    "op11_positional_index": op11_positional_index,
    "op12_full_sort_negatives": op12_full_sort_negatives,
    "op13_lpf_runs": op13_lpf_runs,
}
