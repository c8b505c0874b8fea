"""The registered query of each operator, with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, exact_dedup, mixing, url_filter, vector_codes
from .centroids import cluster_vectors
from .common import table
from .exact_dedup import exact_classes
from .imi import embedding_classes
from .language import learn_languages, predict_languages
from .line_dedup import line_report
from .ngram_join import ngram_jaccard_classes
from .quality import fit_quality, fold, score_quality
from .secrets import digest, scan
from .sentencepiece_job import encode_documents
from .token_files import read_token_files, write_token_files
from .vector_codes import compress_vectors


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_classes(table(spark, sf_dir, "embeddings"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_token_files(write_token_files(docs, vocabulary("word_bpe_49k.json"), end_id=1))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    model = vocabulary("piece_bpe_32k.model")
    coded = encode_documents(table(spark, sf_dir, "documents"), model, decode=True)
    return coded.select(
        "doc_id", "n_ids", "ids_crc32", "parity", F.sha2("decoded_text", 256).alias("decoded_sha256"), F.length("decoded_text").cast("long").alias("decoded_chars")
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_classes(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(table(spark, sf_dir, "pages"), list(url_filter.RULES))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, learn_languages(docs))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_embedding_near_dedup, op2_token_files, op3_exact_dedup, op4_sentencepiece, op5_mixing, op6_line_dedup,
    op7_ngram_join, op8_secrets, op9_quality, op10_url_filter,
    op11_vector_codes, op12_language_id, op13_centroids,
)}

SQL: dict[str, str] = {
    "op3_exact_dedup": exact_dedup.SQL, "op5_mixing": mixing.SQL, "op10_url_filter": url_filter.SQL,
    "op11_vector_codes": vector_codes.SQL, "op13_centroids": centroids.SQL,
}
