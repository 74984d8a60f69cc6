"""A corpus from raw documents: toxic texts, exact copies and near copies go, sources are mixed, what is left is packed.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written and read again before the next. Stages handle
null texts, ids and sources, repeated rows and empty tables as their operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrift.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from tallyrift.llm.common import documents, tidy, written


#: A row's place in the mixture, as the mixing stage names it.
PLACE = ("slot", "seat")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose worst window scores as toxic go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts that with the largest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 on 5-word grams that with the smallest doc_id stays."""
    return ngram_join.drop_similar(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with slot and seat, their places in the mixture."""
    return mixing.placed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts and their places in sequences, which follow the mixture."""
    return packing.pack(written(packing.cut(docs, place=PLACE), "pieces"), place=PLACE)


STAGES = [("toxicity", toxicity_stage), ("exact dedup", exact_stage), ("n-gram jaccard join", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

ORACLE_SQL = None  # the network and the schedule aren't SQL


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what they write goes once the next ones have read it, but for what the result reads."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
