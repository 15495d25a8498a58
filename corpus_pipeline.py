"""Pipeline over ``documents``: four stages of the operators in ``latent.llm``.

Each stage takes what its predecessor kept; the first three return rows of documents with
their columns, the last one the encoded documents. The first stage is fitted, so no SQL
states the result; the tests hold it against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latent.llm import bpe, decontaminate, simhash, toxicity
from latent.llm.common import table
from latent.llm.queries import byte_bpe_path
from latent.session import Workspace

ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=~toxicity.held_out())
    return toxicity.accepted(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return simhash.one_of_each(docs, width=5, threshold=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the kept documents."""
    return bpe.encode(docs, byte_bpe_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what each keeps is written as Parquet and read again."""
    ws, docs = Workspace(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.cut(stage(spark, docs, sf_dir), name)
    return ws.cut(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])


Q = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
