"""Corpus construction over multi-channel commit observations: cleaning, merging, overlap, work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tiers of valid observations.
TIERS = ("main", "audit", "monthly_audit")


def tokens(c: Column) -> Column:
    """A sorted set as one text, joined by ';'."""
    return F.array_join(F.array_sort(F.collect_set(c)), ";")


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b by banker's rounding; 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.bround(a / b, digits))


def validity(obs: DataFrame, agents: list[str]) -> DataFrame:
    """Adds `invalid`: why a row cannot be used, null if it can."""
    reason = F.when(~F.col("tier").isin(*TIERS) | F.col("tier").isNull(), "tier").when(~F.col("agent").isin(*agents) | F.col("agent").isNull(), "agent")
    return obs.withColumn("invalid", reason.when(F.coalesce("repo_sha", F.lit("")) == "", "repo_sha"))


def split_valid(obs: DataFrame, agents: list[str]) -> tuple[DataFrame, DataFrame]:
    """Valid rows; invalid rows with their reason."""
    v = validity(obs, agents)
    return v.filter("invalid is null").drop("invalid"), v.filter("invalid is not null")


def build_population(obs: DataFrame) -> DataFrame:
    """One row for each (agent, repo_sha): values of the first observation by seq, sorted sets of channels, tiers, modes."""
    first = F.min_by(F.struct("repo", "sha", "author_date"), "seq")
    p = obs.groupBy("agent", "repo_sha").agg(first.alias("f"), tokens(F.col("channel")).alias("channels"), tokens(F.col("tier")).alias("tiers"), tokens(F.col("mode")).alias("modes"), F.count("*").alias("n_rows"))
    return p.select("agent", "repo_sha", "f.*", "channels", "tiers", "modes", "n_rows")


def unique_commits(obs: DataFrame, grain: list[str]) -> DataFrame:
    """The first observation of each key of the grain (repo_sha, or agent and repo_sha)."""
    rest = [c for c in obs.columns if c not in grain]
    return obs.groupBy(*grain).agg(F.min_by(F.struct(*rest), "seq").alias("f")).select(*grain, "f.*")


def merge_populations(baseline: DataFrame, supplement: DataFrame) -> DataFrame:
    """Full merge on (agent, repo_sha); the baseline's values go first, the supplement fills a missing author_date."""
    b, s = baseline.alias("b"), supplement.alias("s")
    both = b.join(s, (F.col("b.agent") == F.col("s.agent")) & (F.col("b.repo_sha") == F.col("s.repo_sha")), "full")
    pick = lambda c: F.coalesce(f"b.{c}", f"s.{c}").alias(c)
    union = lambda c: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.split(F.coalesce(f"{x}.{c}", F.lit("")), ";") for x in "bs"]))), ";")
    in_b, in_s = F.col("b.agent").isNotNull(), F.col("s.agent").isNotNull()
    source = F.when(in_b & in_s, "both").when(in_b, "baseline_only").otherwise("supplementary_only")
    return both.select(pick("agent"), pick("repo_sha"), pick("repo"), pick("author_date"), F.ltrim(union("channels"), F.lit(";")).alias("channels"), in_b.alias("in_baseline"), in_s.alias("in_supplement"), source.alias("source"))


def merge_summary(merged: DataFrame) -> DataFrame:
    """For each agent: rows, unique repo_sha, in either source and in both."""
    return merged.groupBy("agent").agg(
        F.count("*").alias("n_rows"), F.count_distinct("repo_sha").alias("n_unique"), F.count_if("in_baseline").alias("n_baseline"), F.count_if("in_supplement").alias("n_supplement"),
        F.count_if(F.col("in_baseline") & F.col("in_supplement")).alias("n_both"),
    )


def channel_counts(obs: DataFrame, segments: DataFrame, skip_probes: bool = True) -> DataFrame:
    """For each (agent, channel) of the observations: rows and unique commits, and what its query segments add up to.
    skip_probes: leave split probes out of the sum of total_count."""
    o = obs.groupBy("agent", "channel").agg(F.count("*").alias("raw_rows"), F.count_distinct("repo_sha").alias("unique_repo_sha"))
    counted = F.when(F.lit(skip_probes) & (F.col("status") == "split_probe"), 0).otherwise(F.col("total_count"))
    s = segments.groupBy("agent", "channel").agg(F.sum(counted).alias("total_count"), F.count_if(F.col("status") == "split_probe").alias("split_probes"), F.count_if("incomplete_results").alias("incomplete"), F.count_if("cap_bound").alias("cap_bound"))
    zero = {c: 0 for c in ("total_count", "split_probes", "incomplete", "cap_bound")}
    return o.join(s, ["agent", "channel"], "left").fillna(zero)


def agent_counts(obs: DataFrame) -> DataFrame:
    """Unique commits of each agent, the sum over its channels, and the cross-channel ratio of the two."""
    per = obs.groupBy("agent", "channel").agg(F.count("*").alias("n"), F.count_distinct("repo_sha").alias("u")).groupBy("agent").agg(F.sum("n").alias("n_rows"), F.sum("u").alias("channel_unique"))
    whole = obs.groupBy("agent").agg(F.count_distinct("repo_sha").alias("n_unique"))
    return per.join(whole, "agent").withColumn("dedup_ratio", ratio(F.col("n_unique"), F.col("channel_unique")))


def filter_counts(obs: DataFrame, agents: list[str], grain: tuple[str, ...] = ("repo_sha",)) -> DataFrame:
    """scope, n_rows, n_unique (of the grain: repo_sha, or agent and repo_sha) for all, invalid, each agent and each tier."""
    unique = F.count_distinct(F.concat_ws("\x1f", *grain)).alias("n_unique")
    v = validity(obs, agents)
    good = v.filter("invalid is null")
    sets = good.withColumn("_grain", F.concat_ws("\x1f", *grain)).groupingSets([[], ["agent"], ["tier"]], "agent", "tier").agg(F.grouping_id().alias("g"), F.count("*").alias("n_rows"), F.count_distinct("_grain").alias("n_unique"))
    scope = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, F.concat(F.lit("agent:"), "agent")).otherwise(F.concat(F.lit("tier:"), "tier"))
    bad = v.filter("invalid is not null").agg(F.count("*").alias("n_rows"), unique).select(F.lit("invalid").alias("scope"), "n_rows", "n_unique")
    return sets.select(scope.alias("scope"), "n_rows", "n_unique").unionByName(bad)


def overlaps(obs: DataFrame, within_agent: bool = True) -> DataFrame:
    """Pairs of channels (left < right): commits of each, in both, in either, Jaccard and coverage; pairs without
    overlap too. A commit's channels are few, so its pairs come from its own sorted set: no self-join of all rows."""
    name = F.col("channel") if within_agent else F.concat_ws("/", "agent", "channel")
    key = ["agent"] if within_agent else []
    o = obs.select(*key, name.alias("channel"), "repo_sha").distinct()
    size = o.groupBy(*key, "channel").agg(F.count("*").alias("n"))
    sets = o.groupBy(*key, "repo_sha").agg(F.array_sort(F.collect_set("channel")).alias("c"))
    pairs = sets.select(*key, F.posexplode("c").alias("i", "left_channel"), "c").select(*key, "left_channel", F.explode(F.expr("slice(c, i + 2, size(c))")).alias("right_channel"))
    met = pairs.groupBy(*key, "left_channel", "right_channel").agg(F.count("*").alias("intersection"))
    a = size.select(*key, F.col("channel").alias("left_channel"), F.col("n").alias("left_n"))
    b = size.select(*[F.col(k).alias(f"{k}_r") for k in key], F.col("channel").alias("right_channel"), F.col("n").alias("right_n"))
    on = F.col("left_channel") < F.col("right_channel")
    grid = a.join(b, on & (F.col("agent") == F.col("agent_r")) if key else on).drop("agent_r")
    out = grid.join(met, [*key, "left_channel", "right_channel"], "left").fillna({"intersection": 0}).withColumn("union", F.col("left_n") + F.col("right_n") - F.col("intersection"))
    out = out.withColumn("jaccard", ratio(F.col("intersection"), F.col("union")))
    if within_agent:
        return out
    same = F.substring_index("left_channel", "/", 1) == F.substring_index("right_channel", "/", 1)
    return out.withColumn("left_coverage", ratio(F.col("intersection"), F.col("left_n"))).withColumn("right_coverage", ratio(F.col("intersection"), F.col("right_n"))).withColumn("same_agent", same)


def set_overlap(a: DataFrame, b: DataFrame, key: str = "repo_sha") -> DataFrame:
    """One row: sizes of two key sets, of what they share, of what only one has."""
    both = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    return both.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))


def diagnose_channels(recent: DataFrame, whole: DataFrame, cap: int = 1000) -> DataFrame:
    """channel, verdict from its counts in a recent and in the whole window (null: not measured, an error)."""
    j = recent.select("channel", F.col("n").alias("n_recent")).join(whole.select("channel", F.col("n").alias("n_all")), "channel", "full")
    verdict = F.when(F.col("n_all").isNull(), "error").when(F.col("n_all") == 0, "wrong").when(F.coalesce("n_recent", F.lit(0)) == 0, "outdated").otherwise("alive")
    return j.withColumn("verdict", F.concat(verdict, F.when(F.greatest(F.coalesce("n_recent", F.lit(0)), F.coalesce("n_all", F.lit(0))) > cap, "+cap_bound").otherwise("")))


def apply_retries(base: DataFrame, segments: DataFrame, retry: DataFrame, key: list[str]) -> DataFrame:
    """base without the rows of incomplete segments, and the retried rows in their place."""
    gone = segments.filter(F.col("status") == "incomplete_terminal").select(*key).distinct()
    return base.join(gone, key, "left_anti").unionByName(retry)


def retry_targets(segments: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Incomplete segments that no retry has completed."""
    return segments.filter(F.col("status") == "incomplete_terminal").join(done.filter(F.col("status") == "ok").select(*key).distinct(), key, "left_anti")


def segment_status(segments: DataFrame) -> DataFrame:
    return segments.groupBy("agent", "status").agg(F.count("*").alias("n"), F.count_if("cap_bound").alias("n_cap_bound"))


def repo_queue(population: DataFrame) -> DataFrame:
    """Repositories by number of rows: agents in the order first seen, first and last date."""
    seen = population.groupBy("repo", "agent").agg(F.min("pos").alias("first"), F.count("*").alias("n"), F.min("author_date").alias("lo"), F.max("author_date").alias("hi"))
    q = seen.groupBy("repo").agg(F.sum("n").alias("n_rows"), F.array_sort(F.collect_list(F.struct("first", "agent"))).alias("a"), F.min("lo").alias("first_date"), F.max("hi").alias("last_date"))
    return q.select("repo", "n_rows", F.array_join("a.agent", ";").alias("agents"), "first_date", "last_date")


def join_language(population: DataFrame, repos: DataFrame) -> DataFrame:
    """The population with its repository's language, and whether the language is there, blank or unknown."""
    last = F.max_by("language", "seq") if "seq" in repos.columns else F.max("language")  # of several rows the last, or the greatest
    out = population.join(repos.groupBy("repo").agg(last.alias("language")), "repo", "left")
    return out.withColumn("language_state", F.when(F.col("language").isNull(), "missing_metadata").when(F.trim("language") == "", "blank").otherwise("known"))


def language_gaps(joined: DataFrame, n: int = 30) -> DataFrame:
    """The n repositories with most rows whose language is missing or blank (joined: what join_language gives), by name where
    equal."""
    gaps = joined.filter("language_state <> 'known'").groupBy("repo", "language_state").agg(F.count("*").alias("n_rows"))
    return gaps.orderBy(F.desc("n_rows"), "repo", "language_state").limit(n)


def pending_fetches(population: DataFrame, index: DataFrame, now, hours: int = 168) -> DataFrame:
    """First row of each (repo, sha) that is neither fetched, nor failed for good, nor failed within the last hours."""
    first = population.withColumn("rn", F.row_number().over(Window.partitionBy("repo", "sha").orderBy("pos"))).filter("rn = 1").drop("rn")
    recent = F.col("fetched_at") >= F.lit(now) - F.expr(f"interval {hours} hours")
    closed = index.filter(F.col("status").isin("ok", "permanent_error") | ((F.col("status") == "error") & recent))
    return first.join(closed.select("repo", "sha").distinct(), ["repo", "sha"], "left_anti")


def run_summary(channels: DataFrame, cap: int = 1000) -> DataFrame:
    """status of each channel's run; a total of -1 means not measured."""
    status = F.when(F.col("total") < 0, "ERROR").when(F.col("total") == 0, "0-hits").otherwise("OK")
    return channels.withColumn("status", status).withColumn("over_cap", F.col("total") > cap)


def file_reconciliation(expected: DataFrame, present: DataFrame, key: str = "sha") -> DataFrame:
    """Expected and present file rows of each commit: missing, complete or partial."""
    e, p = expected.groupBy(key).agg(F.count("*").alias("n_expected")), present.groupBy(key).agg(F.count("*").alias("n_present"))
    j = e.join(p, key, "left").fillna({"n_present": 0})
    return j.withColumn("state", F.when(F.col("n_present") == 0, "missing").when(F.col("n_present") >= F.col("n_expected"), "complete").otherwise("partial"))


def missing_files(expected: DataFrame, present: DataFrame, key: str = "sha", file: str = "filename") -> DataFrame:
    """key, file of expected rows that are not present, repeats counted: n_missing."""
    n = lambda df, name: df.groupBy(key, file).agg(F.count("*").alias(name))
    j = n(expected, "n_expected").join(n(present, "n_present"), [key, file], "left").fillna({"n_present": 0})
    return j.filter("n_present < n_expected").select(key, file, (F.col("n_expected") - F.col("n_present")).alias("n_missing"))
