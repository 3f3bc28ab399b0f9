"""From raw commits to observations of agents: attribution by channel, observation rows, windows, profiles of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.plans.scratch import BROADCAST_ROWS, is_small, materialize, small


#: Characters of the pieces of a text by which rules meet messages.
GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """The distinct pieces of n characters, found in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def text_hits(commits: DataFrame, rules: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """commits with agent, channel, mode of each rule (agent, channel, mode, value) whose value is part of the message.

    A rule goes by the rarest of its pieces of three characters (a shorter one by itself): messages give up their distinct
    pieces, the pieces meet the rules in an equi-join, and only then is the rule's whole value sought. So any number of
    rules costs a message its pieces, not its rules. Rules that are too many to be sent to all tasks meet pieces in a
    shuffle, which carries the message's number and not its text. An empty value is part of every message.
    """
    rules = materialize(rules.filter("value is not null").withColumn("rule", F.monotonically_increasing_id()), "rules")
    sizes = [r["n"] for r in rules.select(F.least(F.length("value"), F.lit(GRAM)).alias("n")).distinct().orderBy("n").collect()]  # four at most
    found = None
    for n in sizes:
        mine = rules.filter(F.least(F.length("value"), F.lit(GRAM)) == n)
        if n == 0:
            hit = commits.join(small(materialize(mine.select("agent", "channel", "mode", F.lit(1).alias("_one")), "rules_0"), most), F.col("_one") == F.lit(1)).drop("_one")
        else:
            said = commits.withColumn("_low", F.lower("message"))
            each = materialize(mine.select("rule", F.explode(_grams(F.col("value"), n)).alias("_gram")), "grams")
            asked = materialize(each.select("_gram").distinct(), "asked")
            often = said.select(F.explode(_grams(F.col("_low"), n)).alias("_gram")).join(small(asked, most), "_gram").groupBy("_gram").agg(F.count("*").alias("often"))
            # a piece that no message has is the rarest of all
            best = each.join(often, "_gram", "left").groupBy("rule").agg(F.min_by("_gram", F.struct(F.coalesce("often", F.lit(0)), F.col("_gram"))).alias("_gram"))
            keyed = materialize(mine.join(best, "rule"), "keyed")
            if is_small(keyed, most):
                hit = said.withColumn("_gram", F.explode(_grams(F.col("_low"), n))).join(F.broadcast(keyed), "_gram").filter(F.contains("_low", "value"))
            else:
                rows = materialize(said.withColumn("_row", F.monotonically_increasing_id()), "said")
                pairs = rows.select("_row", F.explode(_grams(F.col("_low"), n)).alias("_gram")).join(keyed.select("_gram", "rule"), "_gram").select("_row", "rule")
                hit = rows.join(pairs, "_row").join(keyed, "rule").filter(F.contains("_low", "value"))
            hit = hit.select(*commits.columns, "agent", "channel", "mode")
        found = hit if found is None else found.unionByName(hit)
    return commits.limit(0).select("*", *[F.lit(None).cast("string").alias(c) for c in ("agent", "channel", "mode")]) if found is None else found


def attribute_channels(commits: DataFrame, rules: DataFrame) -> DataFrame:
    """commits with agent, channel and mode of every rule that fits.

    rules: agent, channel, mode, query_type (author-email, author, fulltext), value. E-mails and logins meet their rules
    in equi-joins, in lower case; texts are sought in the message (text_hits).
    """
    rules = materialize(rules.select("agent", "channel", "mode", "query_type", F.lower("value").alias("value")), "rules")
    found = text_hits(commits, rules.filter("query_type = 'fulltext'").drop("query_type"))
    for kind, column in (("author-email", "author_email"), ("author", "author_login")):
        r = small(materialize(rules.filter(F.col("query_type") == kind).select("agent", "channel", "mode", F.col("value").alias("_value")), "rules"))
        found = found.unionByName(commits.join(r, F.lower(column) == F.col("_value")).drop("_value"))
    return found


def to_observations(items: DataFrame, order: str = "seq") -> DataFrame:
    """The first item of each (agent, channel, window_start, repo|sha), with repo_sha and the message's first line; items
    without a sha go."""
    items = items.filter("sha <> ''").withColumn("repo_sha", F.concat(F.coalesce("repo", F.lit("")), F.lit("|"), "sha"))
    items = items.withColumn("message_first_line", F.split(F.coalesce("message", F.lit("")), r"\r?\n")[0]).drop("message")
    key = ["agent", "channel", "window_start", "repo_sha"]
    rest = [c for c in items.columns if c not in key]
    return items.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("x")).select(*key, "x.*")


def clean_windows(windows: DataFrame) -> DataFrame:
    """sample_date taken from window_start (text) where it is blank and the start is long enough to hold one."""
    blank = F.coalesce(F.col("sample_date"), F.lit("")) == ""
    return windows.withColumn("sample_date", F.when(blank & (F.length("window_start") >= 10), F.substring("window_start", 1, 10)).otherwise(F.coalesce("sample_date", F.lit(""))))


def commit_languages(files: DataFrame, key: str = "sha") -> DataFrame:
    """languages (sorted, joined by ;) and primary_language (most changes, the first seen of equals) of each commit, from
    its files (key, pos, file_language, changes)."""
    each = files.filter("file_language <> ''").groupBy(key, "file_language").agg(F.sum(F.coalesce("changes", F.lit(0))).alias("changes"), F.min("pos").alias("pos"))
    return each.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("file_language")), ";").alias("languages"), F.max_by("file_language", F.struct("changes", -F.col("pos"))).alias("primary_language"))


def commit_supply_chain(files: DataFrame, key: str = "sha") -> DataFrame:
    """touches, file_count and the sorted match types, ecosystems and managers of each commit, from its files with a
    struct column supply_chain (null: no such file)."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(f"supply_chain.{c}"), F.lit("")))), ";")
    n = F.count("supply_chain")
    return files.groupBy(key).agg((n > 0).alias("touches"), n.alias("file_count"), names("match_type").alias("match_types"), names("ecosystem").alias("ecosystems"), names("manager").alias("managers"))
