"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents, whatever their names. The last gives each document of the mix as pieces: doc_id, n_tokens, n_bytes, round_trip, ids.

Defined cases, in every stage: a null or empty text has no words and is rejected by the quality rules; rows with a null or shared doc_id are told apart by their text, and rows that repeat both are one
document to the near-dedup; nulls in other columns pass through; of ties the smaller (doc_id, hash of the text) stays; a text of any length is worked on whole; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import mixing, pieces, quality, seedextend, simhash
from sparkloom.session import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie far from their language and source go."""
    return quality.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near fingerprints and of texts with a five-word likeness of 0.8 the document with the smallest doc_id stays."""
    return simhash.first_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that start earlier elsewhere are cut out; n_chars follows the text."""
    cut = seedextend.cut_repeats(docs)
    return cut.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the balanced mix takes it."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every text; decoding them gives the text back."""
    return pieces.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

#: Robust estimates, components and Viterbi paths are iterative: no SQL states them. The tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.split()[0].lower())
    return docs
