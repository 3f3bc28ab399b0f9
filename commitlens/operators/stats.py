"""Statistics and reports as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitlens.plans.scratch import materialize, small

from commitlens.operators.corpus import ratio

#: The normal quantile of 95 %; upper bounds of the star buckets.
Z95 = 1.959963984540054
STAR_BUCKETS = ((0, "0"), (4, "1-4"), (9, "5-9"), (99, "10-99"))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of k out of n."""
    k, n = k.cast("double"), n.cast("double")
    p, d = k / n, 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return mid - half, mid + half


def prevalence(df: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """k hits of n rows for each group, the rate in percent and its Wilson interval."""
    c = df.groupBy(*by).agg(F.count_if(hit).alias("k"), F.count("*").alias("n"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return c.withColumn("rate", 100.0 * F.col("k") / F.col("n")).withColumn("low", 100 * lo).withColumn("high", 100 * hi)


def crosstab(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Counts of col's given values for each value of row."""
    return df.groupBy(row).agg(*[F.count_if(F.col(col) == v).alias(v) for v in values])


def monthly(population: DataFrame) -> DataFrame:
    """Unique commits of each agent by month."""
    return population.groupBy("agent", F.date_format("author_date", "yyyy-MM").alias("month")).agg(F.count_distinct("repo_sha").alias("n_unique"), F.count("*").alias("n_rows"))


def star_bucket(stars: Column) -> Column:
    out = None
    for top, name in STAR_BUCKETS:
        out = F.when(stars <= top, name) if out is None else out.when(stars <= top, name)
    return out.otherwise("100+")


def clean_repos(repos: DataFrame) -> DataFrame:
    """Numbers from text, blank languages named, stars in buckets."""
    stars = F.coalesce(F.col("stars").try_cast("long"), F.lit(0))
    return repos.withColumn("stars", stars).withColumn("language", F.coalesce(F.nullif(F.trim("language"), F.lit("")), F.lit("(blank)"))).withColumn("star_bucket", star_bucket(stars))


def repo_tables(repos: DataFrame) -> DataFrame:
    """Repositories of each language: number, stars, median stars."""
    return repos.groupBy("language").agg(F.count("*").alias("n_repos"), F.sum("stars").alias("stars"), F.median("stars").alias("median_stars"))


def agent_combinations(queue: DataFrame) -> DataFrame:
    """Repositories and rows of each combination of agents, as a queue of repositories names it (agents, n_rows)."""
    return queue.groupBy("agents").agg(F.count("*").alias("n_repos"), F.sum("n_rows").alias("n_rows"))


def repo_funnel(repos: DataFrame) -> DataFrame:
    """How many repositories each filter leaves, each on top of those before."""
    steps, so_far = [("all", F.lit(True)), ("not_fork", ~F.col("fork")), ("not_archived", ~F.col("archived")), ("has_language", F.col("language") != "(blank)"), ("stars_1", F.col("stars") >= 1), ("stars_5", F.col("stars") >= 5), ("stars_10", F.col("stars") >= 10)], F.lit(True)
    counts = []
    for name, c in steps:
        so_far = so_far & c
        counts.append(F.count_if(so_far).alias(name))
    one = repos.agg(*counts)
    return one.select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("step"), F.col(n).alias("n")) for n, _ in steps])).alias("i", "s")).select("i", "s.step", "s.n")


def top_repos(population: DataFrame, n: int = 20) -> DataFrame:
    """The n repositories with most rows of each agent; ties by name."""
    c = population.groupBy("agent", "repo").agg(F.count("*").alias("n_rows"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("agent").orderBy(F.desc("n_rows"), "repo"))).filter(F.col("place") <= n)


def agent_by(population: DataFrame, dimension: DataFrame, key: str, value: str) -> DataFrame:
    """Unique commits of each agent by a dimension's value, '(unknown)' where it has none."""
    last = F.max_by(value, "seq") if "seq" in dimension.columns else F.max(value)  # of several rows of a key the last, or the greatest
    j = population.join(dimension.groupBy(key).agg(last.alias(value)), key, "left")
    return j.groupBy("agent", F.coalesce(value, F.lit("(unknown)")).alias(value)).agg(F.count_distinct("repo_sha").alias("n_unique"))


def top_pivot(counts: DataFrame, value: str, agents: list[str], most: int) -> DataFrame:
    """The values with the most unique commits over the given agents (ties: by value), one column for each agent."""
    each = [F.sum(F.when(F.col("agent") == a, F.col("n_unique")).otherwise(0)).alias(a) for a in agents]
    wide = counts.filter(F.col("agent").isin(agents)).groupBy(value).agg(*each, F.sum("n_unique").alias("total"))
    return wide.orderBy(F.desc("total"), value).limit(most)


def channel_share(counts: DataFrame) -> DataFrame:
    """Each channel's share of its agent's rows; channels without rows are left out."""
    return counts.filter("raw_rows > 0").withColumn("share", ratio(F.col("raw_rows"), F.sum("raw_rows").over(Window.partitionBy("agent"))))


def trailer_state(messages: DataFrame) -> DataFrame:
    """State of the co-author trailers in a message's last block, which is one of trailers if every line of it is
    `Key: value` or goes on from the line before: valid_coauthor, valid_and_malformed_coauthor, malformed_coauthor_only,
    terminal_trailer_no_coauthor, no_terminal_trailer (a subject alone is no block of trailers)."""
    text = F.regexp_replace(F.regexp_replace("message", r"\r\n?", "\n"), r"\s+$", "")
    blocks = F.split(text, r"\n[ \t]*\n")
    all_lines = F.split(F.element_at(blocks, -1), "\n")
    lines = F.filter(all_lines, lambda x: F.lower(F.trim(x)).startswith("co-authored-by:"))
    good = F.filter(lines, lambda x: x.rlike(r"(?i)^\s*co-authored-by:\s*\S.*<[^<>@\s]+@[^<>@\s]+>\s*$"))
    trailers = (F.size(blocks) > 1) & F.forall(all_lines, lambda x: x.rlike(r"^[A-Za-z][A-Za-z0-9-]*:(\s|$)|^\s+\S"))
    m = messages.withColumn("n_trailers", F.size(lines)).withColumn("n_valid", F.size(good))
    state = (
        F.when(~F.coalesce(trailers, F.lit(False)), "no_terminal_trailer").when(F.col("n_trailers") == 0, "terminal_trailer_no_coauthor").when(F.col("n_valid") == F.col("n_trailers"), "valid_coauthor")
        .when(F.col("n_valid") == 0, "malformed_coauthor_only").otherwise("valid_and_malformed_coauthor")
    )
    return m.withColumn("state", state)


def concentration(population: DataFrame) -> DataFrame:
    """For each agent: share of its largest and three largest repositories, of its busiest day and month; median rows of a day."""
    repo = population.groupBy("agent", "repo").agg(F.count("*").alias("n")).withColumn("p", F.row_number().over(Window.partitionBy("agent").orderBy(F.desc("n"), "repo")))
    r = repo.groupBy("agent").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("p") == 1, F.col("n"))).alias("t1"), F.sum(F.when(F.col("p") <= 3, F.col("n"))).alias("t3"))
    day = population.groupBy("agent", F.to_date("author_date").alias("d")).agg(F.count("*").alias("n")).groupBy("agent").agg(F.max("n").alias("max_day"), F.median("n").alias("median_day"), F.count("*").alias("active_days"))
    month = population.groupBy("agent", F.date_format("author_date", "yyyy-MM").alias("m")).agg(F.count("*").alias("n")).groupBy("agent").agg(F.max("n").alias("max_month"))
    j = r.join(day, "agent").join(month, "agent").withColumn("peak_month_share", ratio(F.col("max_month"), F.col("n_rows")))
    return j.select("peak_month_share", "agent", "n_rows", ratio(F.col("t1"), F.col("n_rows")).alias("top1_share"), ratio(F.col("t3"), F.col("n_rows")).alias("top3_share"), ratio(F.col("max_day"), F.col("n_rows")).alias("peak_day_share"), "max_day", "median_day", "active_days")


def topn_overlap(a: DataFrame, b: DataFrame, key: str, n: int) -> DataFrame:
    """How many of the n first keys of two rankings (key, score) are the same."""
    top = lambda d: d.orderBy(F.desc("score"), key).limit(n).select(key)
    return top(a).join(top(b), key, "left_semi").agg(F.count("*").alias("n_shared")).withColumn("share", ratio(F.col("n_shared"), F.lit(n)))


def ranked(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """df with each row's place in an order of all rows, from 1. Rows are dealt out by ranges of the order and numbered in each;
    what meets in one task is a row for each range, its size."""
    rows = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    out = rows.withColumn("_part", part).join(small(materialize(starts, "starts")), "_part")
    return out.withColumn(name, (F.col("_before") + at + 1).cast("int")).drop("_id", "_part", "_before")


def rank_authors(population: DataFrame) -> DataFrame:
    """Agents ranked by unique commits, with repositories, active days and months; ties by name."""
    g = population.groupBy("agent").agg(
        F.count_distinct("sha").alias("n_sha"), F.count_distinct("repo_sha").alias("n_repo_sha"), F.count_distinct("repo").alias("n_repos"),
        F.count_distinct(F.to_date("author_date")).alias("active_days"), F.count_distinct(F.date_format("author_date", "yyyy-MM")).alias("active_months"),
    )
    return ranked(g.withColumn("duplication", ratio(F.col("n_repo_sha"), F.col("n_sha"))), F.desc("n_sha"), F.col("agent"))
