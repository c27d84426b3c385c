"""A training-data pipeline over `documents`: toxicity, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet
into the shared folder and reads it again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import line_dedup, minhash, mixing, queries, sentencepiece_bpe, toxicity
from quarry.llm.common import table, write_stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.5 or more go. Null and empty texts have a score like any
    other; repeated rows share theirs. Columns beyond those of documents go."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.judge(docs, labels).where("score < 0.5").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated three-line windows go; n_chars follows the text. Every document stays, null texts
    as they are; of repeated rows the first keeps its lines."""
    done = line_dedup.dedupe_lines(docs)
    return done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one row stays, that of smallest doc_id. Rows without words, null
    texts among them, are near nothing and stay."""
    return minhash.keep_one(docs).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out as the mix of sources takes them. Rows without words are left out;
    null sources are one source."""
    return mixing.repeat_rows(mixing.mix(docs)).select(COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every whole text. Rows of one doc_id and text are copies that the mix made: they are
    numbered, and each has dropout draws of its own."""
    tokens = sentencepiece_bpe.encode(docs.select("doc_id", "text", "source"), queries.tokenizer_path(), dropout=0.1, seed=17, copies=True)
    return tokens.select("doc_id", "source", "copy", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", keep_one_of_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode_pieces),
]

#: Classifier, MinHash and encoder are not SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_stage(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
