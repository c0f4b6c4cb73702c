"""The registered queries of the training-data operators, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontamination, embedding_dedup, html_text, language, licenses, mixing, near_dedup, quality, topk, whitening
from .common import crc_remainder
from .embedding_dedup import embedding_near_duplicates
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .packing import pack


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every fiftieth vector with all others."""
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents as files of a tree: two directories below the source, one file in eight a licence file."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    part = lambda n, salt: F.pmod(F.crc32(F.concat(F.lit(salt), F.col("doc_id").cast("string")).cast("binary")), F.lit(n))
    place = F.when(part(5, "d") == 0, F.lit("")).otherwise(F.concat(F.lit("p"), part(40, "a").cast("string"), F.when(part(3, "e") == 0, F.lit("/")).otherwise(F.concat(F.lit("/m"), part(6, "b").cast("string"), F.lit("/")))))
    name = F.when(part(8, "n") == 0, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = docs.select("doc_id", "text", F.concat(F.coalesce("source", F.lit("unknown")), F.lit("/"), place, name).alias("path"))
    return licenses.scan_licenses(files).select("doc_id", "path", "own_license", F.round("own_score", 9).alias("own_score"), "license", "license_from")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and roles recovered from the lines of all conversations' transcripts, rendered alike; learned from three quarters of the conversations."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    chunks = chat.as_transcripts(turns)
    held_out = F.coalesce(crc_remainder("conv_id", 4) == 2, F.lit(False))
    return chat.parse(chunks, chat.train(chunks.where(~held_out))).withColumn("held_out", held_out)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from two thirds of the labelled ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return quality.score_quality(docs, weights).select("doc_id", held_out, "score", "predicted")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of those with a language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(docs)
    held_out = F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score", "rejected")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a 3:1:2 mixture of one and a half times the corpus takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents over four-word shingles at a similarity of 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, percent=80)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_text.extract_text(pages, html_text.train(pages))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between all vectors of equal label at a cosine of 0.98."""
    return embedding_near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.98)


def op11_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of every vector, fitted on all vectors."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level tokens of every document aligned with its sentencepiece tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return alignment.align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in ten-word windows of benchmark items."""
    return decontamination.contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_top_k": topk.SQL, "op8_minhash_near_dedup": near_dedup.SQL, "op3_mix_sources": mixing.SQL, "op10_embedding_near_dedup": embedding_dedup.SQL, "op13_benchmark_decontamination": decontamination.SQL}
