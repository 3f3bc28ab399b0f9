"""What the training-data operators share: text rules, numbered rows, size-checked broadcast, components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.plans.scratch import discard, materialize, scratch_dir

__all__ = ["discard", "materialize", "scratch_dir"]
#: The white space of the contracts, `[\x20\x09-\x0D]`.
WHITE_SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a run of anything but that white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: A word is a run of digits, ASCII lower-case letters and non-ASCII characters (after lower-casing).
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Most rows and bytes of a side that is broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
#: A key is hot if it holds more than one row in so many; so at most that many keys are.
HOT_SHARE = 10_000


def numbered(docs: DataFrame) -> DataFrame:
    """row (a number) and doc (the row's columns, as a struct, so that no name can clash), written once: what names a row
    where doc_id does not."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "rows")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint if counting proves that df, a materialised table, has at most so many rows and bytes; else df
    itself, whose joins shuffle. Bytes are those of the rows as JSON, which no plain encoding exceeds by much."""
    n = df.limit(rows + 1).count()
    if n > rows:
        return df
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b")).first()["b"] or 0
    return F.broadcast(df) if size + 16 * n <= most else df


def hot_join(rows: DataFrame, keyed: DataFrame, on: str, many: str) -> DataFrame:
    """rows left-joined with keyed (one row for each value of `on`, with the number of rows that have it in `many`).

    Keys that hold more than 1 in HOT_SHARE of all rows are at most HOT_SHARE, so they are broadcast and their rows stay
    where they are; all others shuffle, and none of them is a task of its own. Both tables are materialised ones.
    """
    bar = max(1000, (keyed.agg(F.sum(many)).first()[0] or 0) // HOT_SHARE)
    hot = F.broadcast(keyed.filter(F.col(many) > bar))
    flag = F.broadcast(keyed.filter(F.col(many) > bar).select(on))
    return rows.join(hot, on).unionByName(rows.join(flag, on, "left_anti").join(keyed.filter(F.col(many) <= bar), on, "left"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over the undirected edges (a, b), for each node with an edge.

    Every round takes the least label among the neighbours and then follows labels of labels, so chains shrink
    geometrically; rounds end when no label changes. The minimum is combined before each shuffle, so a hub costs no
    task more than its partial minima. Labels are written each round; nothing is collected but the count of changes.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = materialize(step.join(far, "label").select("node", "old", F.least("label", "up").alias("label")), "labels")
        discard(labels)
        labels = step.select("node", "label")
        if step.filter("label <> old").isEmpty():
            discard(both)
            return labels


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
