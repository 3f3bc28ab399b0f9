"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the mix has the golden-ratio point i*phi mod 1, kept as an exact integer; the point falls into one source's
stretch of the cumulated targets. A source's slots are ranked, and rank r takes the source's block r mod n_blocks: its
documents, shuffled by hash and laid end to end, are cut into blocks of equal numbers of words. What a document gives
is the words it has in the blocks taken. The points' even spread keeps every stretch of the mix near its weights. At the
end a source's slots beyond its target are left out, missing ones follow, and the last gives a part of its block, so that
each source gives its target to the word.

Ranks and running sums go in two levels (within hash or slot chunks, then over chunk totals), so that a source with a
third of all rows is no single task's work.

Defined results: null text has size 0 and gives 0; a null source is a source of its own, the last; ties in the shuffle
order go by doc_id; repeated rows each count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitlens.llm.common import SPACE_WORD, materialize, numbered, small

#: Fixed values of the contract: weights in turn, the share of all words to mix, most passes over a source.
WEIGHTS, SHARE, MOST_PASSES = (5, 2, 1), 1.5, 2
#: The golden ratio's fraction as a multiple of 2**-60, odd, so that the points run through all 2**60 values: the spread
#: is that of the ratio itself for any number of slots that can be counted out.
POINT_BITS, GOLDEN = 60, 712544676207699905
#: Words of a block: the unit of the mix at every size.
BLOCK_WORDS = 256
CHUNK_SLOTS, CELL_BITS = 1 << 14, 10


def word_sizes(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id, source, size, key (the place in the shuffled order) and row (a number, given or new)."""
    size = F.coalesce(F.regexp_count("text", F.lit(SPACE_WORD)), F.lit(0)).cast("long")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))  # rows without doc_id are dealt out by their text
    row = F.monotonically_increasing_id() if row is None else row
    return docs.select("doc_id", "source", size.alias("size"), F.md5(F.concat(F.lit("mix:"), name)).alias("key"), row.alias("row"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """sid, source, source_size, target, lo and hi (its stretch of the points); one row a source, of which there are few.

    Caps of MOST_PASSES times the size with the excess dealt again by weight: every target is the lesser of its cap and
    level times its weight. Sources in order of cap/weight leave one after the other; the level is the greatest seen.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(every) - 1)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights) + 1)).withColumn("cap", F.lit(float(MOST_PASSES)) * F.col("source_size"))
    whole = Window.partitionBy()
    up = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("total", F.lit(share) * F.sum("source_size").over(whole))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("target", F.least("cap", F.max("level").over(whole) * F.col("w")))
    by = Window.orderBy("sid")
    point = lambda c: F.when(F.col("total") > 0, F.floor(c * float(1 << POINT_BITS) / F.col("total"))).otherwise(0).cast("long")
    s = s.withColumn("lo", point(F.coalesce(F.sum("target").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))))
    return s.withColumn("hi", F.lead("lo").over(by)).withColumn("hi", F.coalesce("hi", F.when(F.col("total") > 0, F.lit(1 << POINT_BITS)).otherwise(0))).select("sid", "source", "source_size", "target", "total", "lo", "hi")


def schedule(sources: DataFrame, block: int, total: float) -> DataFrame:
    """slot, sid, rank: the source of each slot and the slot's rank in that source."""
    spark = sources.sparkSession
    n, width = math.ceil(total / block), POINT_BITS - CELL_BITS
    limb = [GOLDEN >> k & 0xFFFFF for k in (0, 20, 40)]  # in parts, as a long cannot hold the product
    point = f"(id * {limb[0]}L + shiftleft(id * {limb[1]}L & {(1 << 40) - 1}L, 20) + shiftleft(id * {limb[2]}L & {(1 << 20) - 1}L, 40)) & {(1 << POINT_BITS) - 1}L"
    cells = sources.filter("hi > lo").withColumn("cell", F.explode(F.expr(f"sequence(shiftright(lo, {width}), shiftright(hi - 1, {width}))"))).select("sid", "lo", "hi", "cell")
    slots = spark.range(n).select(F.col("id").alias("slot"), F.expr(point).alias("point"))
    slots = slots.withColumn("cell", F.shiftright("point", width)).join(cells, "cell").filter("point >= lo and point < hi")
    slots = slots.select("slot", "sid", F.expr(f"slot div {CHUNK_SLOTS}").alias("chunk"))
    counts = slots.groupBy("sid", "chunk").count()
    starts = counts.select("sid", "chunk", F.coalesce(F.sum("count").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inner = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    return slots.withColumn("inner", inner).join(starts, ["sid", "chunk"]).select("slot", "sid", (F.col("start") + F.col("inner")).alias("rank"))


def source_slots(sources: DataFrame, block: int) -> DataFrame:
    """sid, n_blocks, needed (slots that give exactly the target, rounded), part (words of the last one; 0 if whole)."""
    s = sources.filter("source_size > 0").withColumn("goal", F.round("target").cast("long")).withColumn("rest", F.expr("goal % source_size"))
    s = s.withColumn("n_blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    return s.select("sid", "n_blocks", F.expr(f"(goal div source_size) * n_blocks + (rest + {block - 1}) div {block}").alias("needed"), F.expr(f"rest % {block}").alias("part"))


def laid_out(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Each row's place (start, in words) in its source's shuffled order."""
    rows = sizes.join(small(sources.select("sid", F.col("source").alias("s"), "source_size", "target")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("chunk", F.substring("key", 1, 3))
    sums = rows.groupBy("sid", "chunk").agg(F.sum("size").alias("words"))
    starts = sums.select("sid", "chunk", F.coalesce(F.sum("words").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = Window.partitionBy("sid", "chunk").orderBy("key", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.sum("size").over(inner)).join(starts, ["sid", "chunk"]).withColumn("start", F.col("base") + F.col("upto") - F.col("size"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, block: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted) for every row."""
    return _taken(word_sizes(docs), weights, share, block).drop("row")


def _taken(sizes: DataFrame, weights, share: float, block: int) -> DataFrame:
    """The same with the rows' numbers."""
    sizes = materialize(sizes, "sizes")
    sources = materialize(source_targets(sizes, weights, share).coalesce(1), "sources")
    total = sources.agg(F.max("total")).first()[0] or 0.0
    rows = laid_out(sizes, sources)
    if total <= 0:
        return rows.select("row", "doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    blocks = small(materialize(source_slots(sources, block), "source_slots"))
    slots = materialize(schedule(sources, block, total).select("sid", "rank"), "slots")
    given = slots.groupBy("sid").agg(F.count("*").alias("given"))
    late = blocks.join(given, "sid", "left").fillna(0, ["given"]).filter("given < needed").select("sid", F.explode(F.expr("sequence(given, needed - 1)")).alias("rank"))
    slots = slots.unionByName(late).join(blocks, "sid").filter("rank < needed")
    cut = F.expr("part > 0 and rank = needed - 1")
    used = slots.groupBy("sid", F.expr("rank % n_blocks").alias("block")).agg(F.count_if(~cut).alias("times"), F.max(F.when(cut, F.col("part")).otherwise(0)).alias("part"))
    pieces = rows.withColumn("block", F.explode_outer(F.expr(f"case when size > 0 then sequence(start div {block}, (start + size - 1) div {block}) end")))
    words = F.expr(f"least(start + size, (block + 1) * {block}) - greatest(start, block * {block})")
    begun = F.expr(f"greatest(0, least(start + size, block * {block} + part) - greatest(start, block * {block}))")
    pieces = pieces.join(used, ["sid", "block"], "left").withColumn("words", words * F.col("times") + begun)
    return pieces.groupBy("row", "doc_id", "source", "size", "source_size", "target").agg(F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents, whole: each row is given round(taken / size) times (half up), so 0, 1 or 2 times; a document
    without words cannot weigh in and is left out. Columns of docs.

    Defined results: every row counts for itself, also rows that share a doc_id or have none; null text has no words; a
    null source is one source; an empty table gives an empty result.
    """
    rows = numbered(docs)
    texts = rows.select("row", *[F.col(f"doc.{c}").alias(c) for c in ("doc_id", "source", "text")])
    plan = _taken(word_sizes(texts, F.col("row")), weights, share, block).filter("size > 0 and 2 * taken >= size")
    given = rows.join(plan.select("row", F.expr("int((2 * taken + size) div (2 * size))").alias("times")), "row")
    return given.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")
