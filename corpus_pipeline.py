"""The corpus pipeline: quality classifier, line dedup, SimHash near-dedup, mixing to target weights, BPE encoding."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import bpe, lines, mixing, near, quality
from terrane.llm.common import ensure_checkpoint_dir

VOCABULARY = "byte_bpe_50k.tiktoken"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. A null text counts as empty; repeated rows stay or go together."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and similar lines the first one stays. Documents stay, with fewer lines; n_chars follows the text.
    A null text stays null, and has no lines."""
    out = lines.dedup_lines(docs)
    return out.select([F.char_length("text").cast(f.dataType).alias("n_chars") if f.name == "n_chars" else F.col(f.name) for f in docs.schema.fields])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id: those with a similarity of 0.8 over runs of five words, found by the
    tables of SimHash fingerprints and, where these can't, by MinHash bands. Null and blank texts are one group."""
    return near.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken to the target weights of their sources, some more than once. Those without words are not taken."""
    return mixing.take_mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the hash of the decoded bytes, for each document of the mix. A null text has no tokens."""
    out = bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: SQL can't express the trained classifier of the first stage; tests hold the pipeline against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again. Empty tables go through all stages."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs
