"""A training corpus from raw documents, in five stages of the corpus operators.

Each stage takes the rows that the one before kept, as Parquet, and its decisions take effect: documents in no learned language
go, one document of each group of near copies stays, documents that hold test items go, personal data is masked, and
what is left is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import bpe_bitmap, decontaminate_gst, language_ppm, pii_semicrf, simhash_bytes
from attestra.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Near copies: four fingerprints of word pairs for each text. One of four-word shingles, as op4's contract has it, finds few texts that share
#: four fifths of their five-word shingles (README).
SHINGLE, DRAWS = 2, 4


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is learned from all labelled ones, relabelled with it. Null and letterless texts go, as do
    those that no language predicts; repeated rows and rows without a doc_id stay; no rows give none."""
    docs = docs.select(*COLUMNS)
    return language_ppm.recognised(docs, language_ppm.learn(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id, unchanged. Empty and null texts are one group; of
    repeated rows one stays; rows without a doc_id stay; no rows give none."""
    return simhash_bytes.representatives(docs.select(*COLUMNS), words=SHINGLE, draws=DRAWS)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole, in part or reordered, unchanged. Null and empty texts hold none; an empty
    benchmark drops nothing."""
    return decontaminate_gst.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars counted anew; null texts stay as they are."""
    return pii_semicrf.mask(docs.select(*COLUMNS), length="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, with the digest of what they decode to."""
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    found = bpe_bitmap.round_trip(docs, path, pattern)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_languages),
    ("near_copies", drop_near_copies),
    ("test_items", drop_test_items),
    ("personal_data", mask_personal_data),
    ("encode", encode),
]

#: No stage but the first filter's null test can be said in SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
