"""A training corpus from ``documents``: toxic texts go, repeated lines go, near copies go, the rest is packed."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trajlake.llm.common import staged, table
from trajlake.llm.line_dedup import line_dedup
from trajlake.llm.minhash_dedup import without_near_copies
from trajlake.llm.packing import pack
from trajlake.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines the first stays; documents stay, ``n_chars`` follows the text."""
    out = line_dedup(docs)
    return out.selectExpr(*("CAST(length(text) AS BIGINT) AS n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share 80 % of their five-word shingles the smallest id stays."""
    return without_near_copies(docs, size=5)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, placed in sequences."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("near_dedup", near_copies), ("packing", packing)]
#: Fitted models and similarity joins; the tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
