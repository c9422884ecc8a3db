"""The training-data pipeline: toxicity, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All
but the last return the columns of documents. Labels come from ``sf_dir``; rows that
the operators' queries hold out are held out here too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from anamnesis.llm import alike, packing, quality, toxicity
from anamnesis.llm.durable import materialise, ship, table
from anamnesis.llm.queries import QUANTUM, remainder, vocab


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.3."""
    model = toxicity.fit(docs, table(ship(spark), sf_dir, "labels"), lambda i: remainder(4)(i) != 2)
    return docs.where(toxicity.scorer(spark, model)("text") < 0.3)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a probability of good quality of 0.5 or more."""
    model = quality.fit(docs, table(ship(spark), sf_dir, "labels"), lambda i: remainder(3)(i) != 1)
    return docs.where(quality.scorer(spark, model)("text") >= 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles of Jaccard similarity 0.8 or more) the document with the least id."""
    ship(spark)
    return alike.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 ids."""
    ship(spark)
    return packing.pack(docs.select("doc_id", "text", "source"), vocab(), quantum=QUANTUM).drop("queue", "ids")


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near-duplicates", drop_copies), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
