"""From raw documents to token ids: five stages, each over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. What earlier stages have staged is then of no more use
and goes before the next one begins.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from twinspan.llm import minhash_dedup, mixing, quality_rules, sentencepiece_codec, substring_dedup
from twinspan.llm.queries import tokenizer_path
from twinspan.operators.store import release, stage, staged

#: Tables that the stage before has staged for itself.
_left: list[str] = []


def _stage(step):
    """Let the tables of the stage before go, then run the next one."""

    @wraps(step)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _left, keep=docs)
        before = staged()
        out = step(spark, docs, sf_dir)
        _left[:] = [t for t in staged() if t not in before]
        return out

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the robust distance keep."""
    return quality_rules.keep_documents(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return minhash_dedup.keep_one(docs)


@_stage
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words that an earlier document holds."""
    return substring_dedup.remove_passages(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents left out, taken once or repeated."""
    return mixing.repeat_documents(docs)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, and the bytes of the text at which each piece starts and ends."""
    return sentencepiece_codec.encode_documents(docs, sentencepiece_codec.model_bytes(tokenizer_path()))


STAGES = [
    ("quality_rules", quality), ("near_dedup", near_duplicates), ("substring_dedup", passages), ("mixing", mix),
    ("sentencepiece", encode)]

#: Sampling, clustering and tokenizing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
