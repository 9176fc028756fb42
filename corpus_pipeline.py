"""From raw documents to packed training sequences, stage by stage; every stage works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import ship
from riskloom.llm import language_id, line_dedup, minhash, packing, secret_scan
from riskloom.llm.base import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with another text and its length."""
    return docs.withColumns({"text": F.col(text), "n_chars": F.char_length(text).cast("long")}).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a missing ``lang`` is filled in. Null texts, texts without letters and narrow margins go."""
    ship(spark)
    got = language_id.identify(docs, language_id.fit(docs))
    return got.where("not rejected").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a document with a smaller id has; one that loses all its lines stays, with an empty text."""
    return _with_text(line_dedup.dedup_lines(docs), "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), that with the smallest id.

    Rows that share an id and differ in text are documents of their own; of rows equal in id and text one stays.
    """
    ship(spark)
    found = stored(minhash.near_duplicates(docs).select("doc_id", "text_hash", (F.col("kept") & F.col("head")).alias("stays")), "near")
    text_hash = F.xxhash64("text")
    gone = stored(found.where("not stays").select("doc_id", "text_hash").distinct(), "gone")
    kept = docs.join(gone, (docs["doc_id"] == gone["doc_id"]) & (text_hash == gone["text_hash"]), "left_anti").select(*COLUMNS)
    again = stored(found.where("stays").groupBy("doc_id", "text_hash").count().where("count > 1"), "again")
    if again.isEmpty():
        return kept
    is_again = kept["doc_id"].eqNullSafe(again["doc_id"]) & (text_hash == again["text_hash"])
    once = kept.join(again, is_again, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, is_again, "left_anti").union(once)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``[SECRET]`` in place of each secret."""
    ship(spark)
    return _with_text(secret_scan.scan_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")), "redacted")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: No SQL: compression, signatures and tokenizers have none. ``tests/llm/test_pipeline.py`` checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
