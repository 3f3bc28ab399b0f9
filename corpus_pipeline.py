"""From raw documents to training shards: the stages of STAGES, each a whole-table job over what the one before kept.

A document that is rejected as toxic goes; one row of each component of near copies stays, the one with the smallest
doc_id; contaminated documents go; the mix gives documents 0, 1 or 2 times; the last stage names each one's
shard and returns that instead of the documents' columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.llm.common import numbered, scratch_dir, table
from commitlens.llm.decontamination import contamination
from commitlens.llm.mixing import mixed_documents
from commitlens.llm.ngram_join import representatives
from commitlens.llm.sharding import shard_assignments
from commitlens.llm.toxicity import accepted, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents of the whole table; rejects what scores at the cut or above."""
    return accepted(docs, train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text holds an item's window go."""
    rows = numbered(docs)
    clean = contamination(rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")), table(spark, sf_dir, "benchmark")).filter("not contaminated")
    return rows.join(clean.select(F.col("doc_id").alias("row")), "row", "left_semi").select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def name_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_assignments(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("sharding", name_shards),
]
#: Learned scores are in it, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one leaves is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
