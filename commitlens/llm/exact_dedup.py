"""Exact dedup: a tree merge of digest runs.

Texts are equal when they are identical after white space is deleted. Every row becomes a digest (SHA-256, with the
byte length and a second hash as verification). Partitions form runs; binomial rounds merge 2**FAN_BITS runs into one
and keep, at every level, the best row of each verified digest and the size of its group. A group of any size shrinks
to one entry a run in the first round, so no task ever sees more of a hot group than the runs it merges.

Defined results: null text is the empty text, and all empty texts are one group; ties in length go to the smallest
doc_id (null first), repeated rows to one of them (they are alike, so which one does not show); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import WHITE_SPACE, materialize

RUN_BITS, FAN_BITS = 6, 3
KEY = ["text_sha256", "n_bytes", "second"]


def text_digests(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_chars of the original, and the verified digest of the normalised text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.translate(text, WHITE_SPACE, "").alias("norm")).select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("part"), F.char_length("text").alias("n_chars"),
        F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("n_bytes"), F.xxhash64("norm").alias("second"),
    )


def merge_runs(digests: DataFrame, run_bits: int = RUN_BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """One row for each verified digest: best (the row that stays) and group_size."""
    best = F.struct((-F.col("n_chars")).alias("less"), "doc_id", "row")
    runs = digests.select(F.expr(f"part & {(1 << run_bits) - 1}").alias("run"), *KEY, best.alias("best"), F.lit(1).cast("long").alias("group_size"))
    for bits in range(run_bits, -fan_bits, -fan_bits):
        runs = runs.groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
        if bits > 0:
            runs = runs.withColumn("run", F.shiftright("run", fan_bits))
    return runs.drop("run")


def exact_dedup(docs: DataFrame, run_bits: int = RUN_BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text)."""
    digests = materialize(text_digests(docs), "digests")
    best = merge_runs(digests, run_bits, fan_bits)
    return digests.join(best, KEY).select(
        digests.doc_id, F.col("best.doc_id").alias("keep_id"), "group_size", (digests["row"] == F.col("best.row")).alias("kept"), "text_sha256"
    )
