"""Sampling windows over commit time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.plans.scratch import materialize


def sample_windows(spark: SparkSession, since: str, until: str, minutes: int, seed: int) -> DataFrame:
    """One window of so many minutes for each day of [since, until): its bucket is the day's MD5 with the seed, modulo the
    buckets of a day; where the minutes do not divide it, the last bucket ends with the day."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{since}', DATE'{until}' - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day")
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("day").cast("string"))), 1, 8), 16, 10).cast("long") % -(-1440 // minutes)
    d = days.withColumn("bucket", bucket)
    start = F.expr(f"CAST(day AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, CAST(bucket * {minutes} AS INT))")
    end = F.least(start + F.expr(f"INTERVAL {minutes} MINUTES"), F.expr("CAST(day AS TIMESTAMP_NTZ) + INTERVAL 1 DAY"))
    return d.select("day", start.alias("window_start"), end.alias("window_end"))


def in_windows(commits: DataFrame, windows: DataFrame) -> DataFrame:
    """Commits whose time lies in [start, end) of a window: an equi-join on the days that the window touches, then the range."""
    touched = F.expr("explode(sequence(to_date(window_start), to_date(window_end - interval 1 microsecond)))")
    w = windows.filter("window_end > window_start").select("day", "window_start", "window_end", touched.alias("_on"))
    return commits.withColumn("_on", F.to_date("author_date")).join(w, "_on").filter("author_date >= window_start and author_date < window_end").drop("_on")


def audit_schedule(windows: DataFrame) -> DataFrame:
    """Each window with whether it is the first of its ISO week (weekly audit) or of its month (monthly audit)."""
    week = windows.groupBy(F.date_trunc("week", "day").alias("w")).agg(F.min("day").alias("day")).select("day", F.lit(True).alias("weekly"))
    month = windows.groupBy(F.date_trunc("month", "day").alias("m")).agg(F.min("day").alias("day")).select("day", F.lit(True).alias("monthly"))
    return windows.join(week, "day", "left").join(month, "day", "left").fillna(False, ["weekly", "monthly"])


def search_tasks(windows: DataFrame, channels: DataFrame, completed: DataFrame) -> DataFrame:
    """tier, agent, channel, window_start, window_end still to be searched. windows: those of audit_schedule; a channel
    (tier, agent, channel) of tier audit is due in the first window day of a week, of tier monthly_audit in that of a month,
    any other in every window; completed (the five columns) is done."""
    key, tier = ["tier", "agent", "channel", "window_start", "window_end"], F.col("tier")
    gates = F.array_compact(F.array(F.lit("main"), F.when(F.col("weekly"), "audit"), F.when(F.col("monthly"), "monthly_audit")))
    due = windows.select("window_start", "window_end", F.explode(gates).alias("gate"))
    gated = channels.select("tier", "agent", "channel", F.when(tier.isin("audit", "monthly_audit"), tier).otherwise("main").alias("gate")).distinct()
    return due.join(gated, "gate").select(key).join(completed.select(key), key, "left_anti")


def bisect_windows(commits: DataFrame, windows: DataFrame, cap: int, least_seconds: int) -> DataFrame:
    """Splits windows at their middle (whole seconds) while they hold more than cap commits and are longer than
    least_seconds. segment_start, segment_end, n, depth, status of every segment tried.

    Commits are read once: each time of a window names the segments that it falls into, one of each depth, and one
    aggregate counts them all. A segment that is to be split has more than cap commits, so its ancestors have too and are
    split as well: what is tried are the windows and the two halves of every such segment.
    """
    if least_seconds < 1:
        raise ValueError("least_seconds is a second or more")
    whole = windows.select(F.col("window_start").alias("s"), F.col("window_end").alias("e")).distinct().filter("e > s").withColumn("length", F.expr("timestampdiff(SECOND, s, e)"))
    touched = whole.withColumn("day", F.explode(F.expr("sequence(to_date(s), to_date(e - interval 1 microsecond))")))
    times = commits.groupBy("author_date").agg(F.count("*").alias("n")).withColumn("day", F.to_date("author_date"))
    hit = times.join(touched, "day").filter("author_date >= s and author_date < e").withColumn("at", F.expr("timestampdiff(SECOND, s, author_date)")).groupBy("s", "e", "length", "at").agg(F.sum("n").alias("n"))
    root = "named_struct('lo', 0L, 'long', length)"
    half = "named_struct('lo', if(at < x.lo + x.long div 2, x.lo, x.lo + x.long div 2), 'long', if(at < x.lo + x.long div 2, x.long div 2, x.long - x.long div 2))"
    # lengths halve, so 63 depths are more than a long can hold
    path = F.expr(f"aggregate(sequence(1, 63), array({root}), (p, i) -> transform(array(element_at(p, -1)), x -> if(x.long > {least_seconds}, array_append(p, {half}), p))[0])")
    counts = hit.select("s", "e", "length", "n", F.posexplode(path).alias("depth", "g")).groupBy("s", "e", "length", "depth", "g").agg(F.sum("n").alias("n"))
    counts = materialize(counts.select("s", "e", "length", "depth", F.col("g.lo").alias("lo"), F.col("g.long").alias("long"), "n"), "segments")
    halves = F.explode(F.expr("array(named_struct('lo', lo, 'long', long div 2), named_struct('lo', lo + long div 2, 'long', long - long div 2))"))
    split = counts.filter(f"n > {cap} and long > {least_seconds}").select("s", "e", (F.col("depth") + 1).alias("depth"), halves.alias("g")).select("s", "e", "depth", "g.*")
    tried = whole.select("s", "e", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("lo"), F.col("length").alias("long")).unionByName(split)
    tried = tried.join(counts.drop("length"), ["s", "e", "depth", "lo", "long"], "left").fillna({"n": 0})
    status = F.when(F.col("n") <= cap, "ok").when(F.col("long") > least_seconds, "split_probe").otherwise("cap_bound_terminal")
    end = F.when(F.col("lo") + F.col("long") == F.expr("timestampdiff(SECOND, s, e)"), F.col("e")).otherwise(F.expr("timestampadd(SECOND, lo + long, s)"))
    return tried.select(F.expr("timestampadd(SECOND, lo, s)").alias("segment_start"), end.alias("segment_end"), "n", "depth", status.alias("status"))
