"""The corpus pipeline: each stage is one operator over all that its
predecessor kept. Stages read and write Parquet; ``run`` puts the written tables
into the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sortwright.llm import decontam, near_dup, pieces, pii, toxicity
from sortwright.llm.common import materialize, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace_pii(docs, pii.PiiConfig(pii.session_key(spark)))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents and ``piece_ids``."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", pseudonymise),
    ("pieces", encode_pieces),
]

#: Training, tiling, keyed hashes and sampling have no SQL form. The tests hold
#: the stages against brute force or planted rows, each on what the one before kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
