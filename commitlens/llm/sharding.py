"""Sharding by extendible hashing.

A row's key hash is a string of bits. The directory starts with one bucket; only a bucket over the byte limit splits,
on one more bit, until every shard fits. Bucket sizes come from a histogram over hash prefixes (combined before the
shuffle), never from rows gathered in one place. A round counts prefixes of `bits` more bits for the rows whose bucket
is still too large, and settles for each the shallowest prefix that fits; rounds go on until none is left.

Defined results: null text has 0 bytes; null doc_id hashes as the empty key; one row larger than the limit is a shard
of its own; rows that share all 60 bits (repeated ids) and are too large together are cut along their running size, a
row that crosses a cut being alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitlens.llm.common import materialize, union_all

HASH_BITS = 60
SHARD_BYTES = 16 << 20
MORE_BITS = 8


def key_hash(key: Column) -> Column:
    """The first 60 bits of the key's MD5, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _settle(rows: DataFrame, known: int, bits: int, limit: int) -> DataFrame:
    """For rows whose bucket of `known` bits is too large: prefix of known+bits bits, and the least depth that fits
    (null if none does) with that shard's bytes and rows."""
    deep = known + bits
    hist = rows.groupBy(F.shiftright("h", HASH_BITS - deep).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    hist = materialize(hist, "histogram")
    levels = hist.withColumn("depth", F.explode(F.sequence(F.lit(known), F.lit(deep)))).withColumn("bucket", F.expr(f"shiftright(prefix, {deep} - depth)"))
    sums = levels.groupBy("depth", "bucket").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    fits = sums.filter((F.col("shard_bytes") <= limit) | (F.col("shard_rows") <= 1))
    leaf = levels.select("prefix", "depth", "bucket").join(fits, ["depth", "bucket"]).groupBy("prefix").agg(F.min(F.struct("depth", "shard_bytes", "shard_rows")).alias("leaf"))
    return hist.select("prefix").join(leaf, "prefix", "left").select("prefix", "leaf.*")


def shard_assignments(docs: DataFrame, limit: int = SHARD_BYTES, more_bits: int = MORE_BITS) -> DataFrame:
    """doc_id, shard (the bits of its bucket; a cut of equal keys adds -k), depth, n_bytes, shard_bytes."""
    rows = docs.select("doc_id", key_hash(F.col("doc_id")).alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    left = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    total = left.agg(F.sum("bytes")).first()[0] or 0
    known, bits, done = 0, min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 3), []
    name = F.expr(f"substring(lpad(bin(h), {HASH_BITS}, '0'), 1, depth)")
    while bits:
        deep = known + bits
        leaf = materialize(_settle(left, known, bits, limit), "directory")
        dealt = materialize(left.join(leaf, F.shiftright(left.h, HASH_BITS - deep) == leaf.prefix).drop("prefix"), "dealt")
        done.append(dealt.filter("depth is not null").select("doc_id", name.alias("shard"), "depth", F.col("bytes").alias("n_bytes"), "shard_bytes"))
        left, known = dealt.filter("depth is null").select("doc_id", "h", "bytes", "row"), deep
        if left.isEmpty():
            return union_all(done)
        bits = min(more_bits, HASH_BITS - known)
    return union_all([*done, _cut_equal_keys(left, limit)])


def _cut_equal_keys(rows: DataFrame, limit: int) -> DataFrame:
    """Rows with one and the same hash: cut where the running size passes a multiple of the limit."""
    order = Window.partitionBy("h").orderBy("row")
    cut = rows.withColumn("end", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("bytes"))
    crosses = F.expr(f"bytes > 0 and start div {limit} <> (end - 1) div {limit}")
    cut = cut.withColumn("part", F.expr(f"2 * (start div {limit})") + F.when(crosses, 1).otherwise(0))
    sizes = cut.groupBy("h", "part").agg(F.sum("bytes").alias("shard_bytes"))
    shard = F.concat(F.expr(f"lpad(bin(h), {HASH_BITS}, '0')"), F.lit("-"), F.col("part").cast("string"))
    return cut.join(sizes, ["h", "part"]).select("doc_id", shard.alias("shard"), F.lit(HASH_BITS).alias("depth"), F.col("bytes").alias("n_bytes"), "shard_bytes")
