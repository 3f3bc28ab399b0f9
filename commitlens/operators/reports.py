"""Summaries, audits and reports as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitlens.operators.quality import fingerprint
from commitlens.operators.stats import ranked, ratio, wilson


def _counts(df: DataFrame, what: dict[str, Column]) -> DataFrame:
    """dimension, value, n: rows by each of the columns, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.coalesce(c.cast("string"), F.lit("")).alias("value")) for k, c in what.items()]))
    return df.select(each.alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def stage1_summary(commits: DataFrame, events: DataFrame) -> DataFrame:
    """dimension, value, n: commits by quadrant, repository language and changed language; events by type; all of both."""
    c = _counts(commits, {"commits": F.lit("all"), "quadrant": F.col("dependency_quadrant"), "repo_language": F.col("repo_language")})
    changed = commits.select(F.explode("changed_languages").alias("l")).filter("l <> ''")
    return c.unionByName(_counts(changed, {"changed_language": F.col("l")})).unionByName(_counts(events, {"events": F.lit("all"), "event_type": F.col("event_type")}))


def stage1_counters(index: DataFrame, extracted: DataFrame, languages: list[str] | None = None, per_language: int = 0, key: str = "sha", language: str = "language", order: str = "pos") -> DataFrame:
    """counter, n: rows of the index, those of languages that are not looked at, those beyond a language's quota, those that
    gave nothing, and those that gave a commit. Only commits that gave something use up a quota; in the order of the
    index a row is beyond it once so many of its language have been found before it."""
    found = index.join(extracted.select(key).distinct().withColumn("_found", F.lit(True)), key, "left").withColumn("_found", F.coalesce("_found", F.lit(False)))
    looked = F.col(language).isin(*languages) if languages else F.lit(True)
    so_far = Window.partitionBy(language).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    beyond = F.coalesce(F.count_if("_found").over(so_far), F.lit(0)) >= per_language if per_language else F.lit(False)
    state = F.when(~F.coalesce(looked, F.lit(False)), "filtered_repo_language").when(F.col("_beyond"), "sample_limit_skips").when(F.col("_found"), "commits").otherwise("non_candidate_or_missing_patch")
    rows = found.withColumn("_beyond", beyond).withColumn("counter", F.explode(F.array(F.lit("processed_index_rows"), state)))
    return rows.groupBy("counter").agg(F.count("*").alias("n"))


def stage2_summary(episodes: DataFrame) -> DataFrame:
    """dimension, value, n: episodes by quadrant, alignment and query kind."""
    return _counts(episodes, {"episodes": F.lit("all"), "quadrant": F.col("dependency_quadrant"), "alignment": F.col("alignment_status"), "query_kind": F.col("query_kind")})


def stage3_summary(episodes: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """dimension, value, n: episodes and commits, episodes by registry and by advisory status (not_queried if they have none),
    and of evidence the records and distinct payloads."""
    status = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("not_queried"))
    out = _counts(episodes, {"episodes": F.lit("all"), "registry_status": status("registry_status"), "advisory_status": status("advisory_status")})
    more = episodes.agg(F.count_distinct("commit_id").alias("n")).select(F.lit("commits").alias("dimension"), F.lit("all").alias("value"), "n")
    out = out.unionByName(more)
    if evidence is not None:
        n = evidence.agg(F.count("*").alias("records"), F.count_distinct("payload_sha256").alias("payloads"))
        out = out.unionByName(n.select(F.explode(F.array(*[F.struct(F.lit(f"evidence_{c}").alias("dimension"), F.lit("all").alias("value"), F.col(c).alias("n")) for c in ("records", "payloads")])).alias("x")).select("x.*"))
    return out


def summarize_adjudication(rows: DataFrame) -> DataFrame:
    """dimension, value, n: rows, unique commits, rows by label, agent, ecosystem and language (languages: array), and
    rows whose patch path is not a portable one."""
    c = _counts(rows, {"rows": F.lit("all"), "label": F.col("final_label"), "agent": F.col("agent"), "ecosystem": F.col("ecosystem")})
    c = c.unionByName(_counts(rows.select(F.explode("languages").alias("l")), {"language": F.col("l")}))
    commits = rows.agg(F.count_distinct(F.struct("repo", "sha")).alias("n"), F.count_if(~F.coalesce(F.col("patch_path").startswith("diff_corpus/"), F.lit(False))).alias("m"))
    commits = commits.select(F.explode(F.array(F.struct(F.lit("commits").alias("dimension"), F.lit("unique").alias("value"), "n"), F.struct(F.lit("patch_path").alias("dimension"), F.lit("not_portable").alias("value"), F.col("m").alias("n")))).alias("x"))
    return c.unionByName(commits.select("x.*"))


def rates_by_language(episodes: DataFrame, labels: DataFrame) -> DataFrame:
    """For each language its queryable episodes, their labels, and the strict (confirmed) and sensitivity (confirmed or
    probable) rates in percent with Wilson bounds. episodes: episode_id, language, query_kind; labels: episode_id, final_label."""
    e = episodes.filter(F.col("query_kind").isin("exact", "range", "name_only")).select("episode_id", "language").distinct()
    n = lambda label: F.count_if(F.col("final_label") == label)
    names = ("confirmed_hallucination", "probable_hallucination", "not_hallucination", "indeterminate")
    g = e.join(labels.select("episode_id", "final_label"), "episode_id", "left").groupBy("language").agg(F.count("*").alias("n_episodes"), *[n(x).alias(x) for x in names])
    for rate, k in (("strict", F.col(names[0])), ("sensitivity", F.col(names[0]) + F.col(names[1]))):
        low, high = wilson(k, F.col("n_episodes"))
        g = g.withColumns({f"{rate}_percent": 100.0 * k / F.col("n_episodes"), f"{rate}_low": 100 * low, f"{rate}_high": 100 * high})
    return g


def resolve_identities(people: DataFrame) -> DataFrame:
    """people (event_id, account_id, email) with identity and how it was found: the account's number; the number in a
    noreply address; the one account that the address goes with, if that account goes with no other address and the
    address with no other account; else the address's digest; without an address a key of the event's own."""
    email = F.lower(F.trim(F.coalesce("email", F.lit(""))))
    p = people.withColumn("address", email).withColumn("noreply", F.nullif(F.regexp_extract(email, r"^(\d+)\+[^@]+@users\.noreply\.github\.com$", 1), F.lit("")).cast("long"))
    known = p.filter("account_id is not null and address <> '' and noreply is null").select("address", "account_id").distinct()
    addresses = known.groupBy("address").agg(F.min("account_id").alias("account"), F.count("*").alias("n")).filter("n = 1")
    accounts = known.groupBy(F.col("account_id").alias("account")).agg(F.count("*").alias("m")).filter("m = 1")
    mapped = addresses.join(accounts, "account").select("address", F.col("account").alias("mapped"))
    j = p.join(mapped, "address", "left")
    how = F.when(F.col("account_id").isNotNull(), "account").when(F.col("noreply").isNotNull(), "noreply").when(F.col("mapped").isNotNull(), "mapped").when(F.col("address") != "", "unresolved").otherwise("missing")
    number = F.coalesce("account_id", "noreply", "mapped")
    who = F.when(number.isNotNull(), F.concat(F.lit("account:"), number.cast("string"))).when(F.col("address") != "", F.concat(F.lit("email:"), F.sha2("address", 256))).otherwise(F.concat(F.lit("event:"), F.col("event_id").cast("string")))
    return j.select("event_id", who.alias("identity"), how.alias("resolution"))


def message_profile(messages: DataFrame, by: str) -> DataFrame:
    """For each `by`: messages, how many are conventional commits and refer to an issue, their shares, and the commonest
    type (ties by name)."""
    first = F.split("message", r"\r?\n")[0]
    kind = F.lower(F.regexp_extract(first, r"^([A-Za-z]+)(?:\([^()]*\))?!?: \S", 1))
    m = messages.select(by, kind.alias("type"), F.col("message").rlike(r"(^|[^\w&])#\d+\b").alias("issue"))
    g = m.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("type") != "").alias("n_conventional"), F.count_if("issue").alias("n_issue"))
    top = m.filter("type <> ''").groupBy(by, "type").agg(F.count("*").alias("k")).groupBy(by).agg(F.min_by("type", F.struct(-F.col("k"), "type")).alias("top_type"))
    return g.join(top, by, "left").select(by, "n", "n_conventional", "n_issue", ratio(F.col("n_conventional"), F.col("n")).alias("conventional_share"), ratio(F.col("n_issue"), F.col("n")).alias("issue_share"), F.coalesce("top_type", F.lit("")).alias("top_type"))


def cohort_profile(accounts: DataFrame, commits: DataFrame, places: list[str], top: int = 100) -> DataFrame:
    """measure, agent, n of the accounts whose location names one of the places as a word: for all and each agent its
    accounts, shas and repos; accounts with several agents; shas of the `top` accounts (most shas, then least id); the
    median shas of an account."""
    words = "|".join(p.lower() for p in places)
    cohort = accounts.filter(F.lower("location").rlike(rf"(^|[^\pL])({words})($|[^\pL])")).select("account_id").distinct()
    c = commits.join(cohort, "account_id")
    measures = [F.count_distinct("account_id").alias("accounts"), F.count_distinct("sha").alias("shas"), F.count_distinct("repo").alias("repos")]
    each = c.agg(*measures).select(F.lit("all").alias("agent"), "*").unionByName(c.groupBy("agent").agg(*measures))
    out = each.select("agent", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("n")) for m in ("accounts", "shas", "repos")])).alias("x")).select("x.measure", "agent", "x.n")
    per = c.groupBy("account_id").agg(F.count_distinct("sha").alias("n"), F.count_distinct("agent").alias("agents"))
    first = per.orderBy(F.desc("n"), "account_id").limit(top).select("account_id")
    several = per.agg(F.count_if(F.col("agents") > 1).cast("double").alias("several_agents"), F.median("n").alias("median_shas"))
    several = several.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.lit("all").alias("agent"), F.col(m).alias("n")) for m in ("several_agents", "median_shas")])).alias("x")).select("x.*")
    covered = c.join(first, "account_id", "left_semi").agg(F.count_distinct("sha").cast("double").alias("n")).select(F.lit("top_shas").alias("measure"), F.lit("all").alias("agent"), "n")
    return out.unionByName(several).unionByName(covered)


def repo_filters(repos: DataFrame) -> DataFrame:
    """repos with a column for each target filter, all on top of not being a fork or archived and having a language."""
    base = ~F.col("fork") & ~F.col("archived") & (F.col("language") != "(blank)")
    return repos.withColumns({"is_target": base} | {f"is_target_{n}": base & (F.col("stars") >= n) for n in (1, 5, 10)})


def audit_episodes(episodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """rule, n: queryable episodes without a registry result or with fewer than two pieces of evidence, and the distinct
    pieces named that do not exist. episodes: episode_id, query_kind, registry_status, evidence_ids (array)."""
    asks = ~F.col("query_kind").isin("excluded", "unresolved")
    row = episodes.agg(F.count_if(asks & (F.col("registry_status") == "not_queried")).alias("a"), F.count_if(asks & (F.size(F.filter("evidence_ids", lambda x: x != "")) < 2)).alias("b"))
    names = (("lacks_registry_result", "a"), ("lacks_evidence_ids", "b"))
    one = row.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(c).alias("n")) for r, c in names])).alias("x")).select("x.*")
    used = episodes.select(F.explode("evidence_ids").alias("evidence_id")).filter("evidence_id <> ''").distinct()
    return one.unionByName(used.join(evidence.select("evidence_id"), "evidence_id", "left_anti").agg(F.lit("unknown_evidence_id").alias("rule"), F.count("*").alias("n")).select("rule", "n"))


def verify_publication(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """name, actual, expected, passed: what a published table holds (rows, rows of each label, paths that are not portable)
    against what is expected of it (name, expected); a check missing on either side fails."""
    label = rows.groupBy(F.concat(F.lit("label:"), "final_label").alias("name")).agg(F.count("*").alias("actual"))
    whole = rows.agg(F.count("*").alias("rows"), F.count_if(~F.coalesce(F.col("patch_path").startswith("diff_corpus/"), F.lit(False))).alias("not_portable"))
    whole = whole.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("actual")) for c in ("rows", "not_portable")])).alias("x")).select("x.*")
    j = label.unionByName(whole).join(expected.select("name", "expected"), "name", "full")
    return j.select("name", "actual", "expected", F.coalesce(F.col("actual") == F.col("expected"), F.lit(False)).alias("passed"))


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: whether two readings of a table hold the same rows, in whatever order."""
    a, b = fingerprint(before), fingerprint(after)
    return a.crossJoin(b.toDF("n_after", "digest_after")).select(((F.col("n_rows") == F.col("n_after")) & (F.col("digest") == F.col("digest_after"))).alias("unchanged"), "n_rows", "n_after")


def rank_identities(roles: DataFrame) -> DataFrame:
    """Identities ranked by the commits they wrote or co-wrote. roles: identity, role (author, coauthor), sha, repo,
    author_date. Ties go by author commits, repositories, active days and the identity."""
    sha = lambda role: F.count_distinct(F.when(F.col("role") == role, F.col("sha")))
    day = F.to_date("author_date")
    g = roles.groupBy("identity").agg(
        sha("author").alias("author_sha"), sha("coauthor").alias("coauthor_sha"), F.count_distinct("sha").alias("union_sha"), F.count_distinct("repo", "sha").alias("repo_sha"), F.count_distinct("repo").alias("n_repos"),
        F.count_distinct(day).alias("active_days"), F.count_distinct(F.date_format("author_date", "yyyy-MM")).alias("active_months"), F.min(day).cast("string").alias("first_day"), F.max(day).cast("string").alias("last_day"),
    )
    order = (F.desc("union_sha"), F.desc("author_sha"), F.desc("n_repos"), F.desc("active_days"), F.col("identity"))
    return ranked(g.withColumn("duplication", ratio(F.col("repo_sha"), F.col("union_sha"))), *order)
