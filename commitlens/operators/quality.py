"""Contracts: violations, closure, reconciliation, identifiers, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the version of identifiers.
ID_SCHEMA = 1


def violations(df: DataFrame, key: list[str], domains: dict[str, list[str]]) -> DataFrame:
    """rule, n: rows with an empty key part, rows whose key repeats, rows with a value outside its domain."""
    empty = F.exists(F.array(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]), lambda x: x == "")
    row = df.agg(F.count_if(empty).alias("empty_key"), *[F.count_if(F.col(c).isNull() | ~F.col(c).isin(v)).alias(f"domain:{c}") for c, v in domains.items()])
    names = ["empty_key", *[f"domain:{c}" for c in domains]]
    one = row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("n")) for n in names])).alias("x")).select("x.*")
    twice = df.groupBy(*key).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("n")).select(F.lit("duplicate_key").alias("rule"), "n")
    return one.unionByName(twice)


def contract_violations(df: DataFrame, columns: list[str], key: list[str], domains: dict[str, list[str]], schema_version: int) -> DataFrame:
    """violations, and whether the columns are exactly the given ones in order, and rows of another schema version."""
    own = violations(df, key, domains)
    wrong = own.sparkSession.range(1).select(F.lit("columns").alias("rule"), F.lit(int(df.columns != columns)).cast("long").alias("n"))
    if "schema_version" in df.columns:
        other = df.agg(F.count_if(~F.col("schema_version").cast("string").eqNullSafe(F.lit(str(schema_version)))).alias("n")).select(F.lit("schema_version").alias("rule"), "n")
        own = own.unionByName(other)
    return own.unionByName(wrong)


def normal_repo(repo: Column) -> Column:
    """owner/name in lower case; null for anything else."""
    plain = F.array_join(F.filter(F.split(F.translate(F.trim(repo), "\\", "/"), "/"), lambda x: x != ""), "/")
    return F.when(plain.rlike("^[^/]+/[^/]+$"), F.lower(plain))


def normal_sha(sha: Column) -> Column:
    """7 to 64 hexadecimal digits in lower case; null for anything else."""
    low = F.lower(F.trim(sha))
    return F.when(low.rlike(r"^[0-9a-f]{7,64}\z"), low)


def normal_path(path: Column) -> Column:
    """A path below the repository's root, without empty and . segments; null if it is none or leaves it."""
    parts = F.filter(F.split(F.translate(F.trim(path), "\\", "/"), "/"), lambda x: (x != "") & (x != "."))
    return F.when((F.size(parts) > 0) & ~F.array_contains(parts, ".."), F.array_join(parts, "/"))


def commit_id(repo: Column, sha: Column) -> Column:
    """Identifier of a commit; null if the repository or the sha is none."""
    r, h = normal_repo(repo), normal_sha(sha)
    return F.when(r.isNotNull() & h.isNotNull(), content_id("cmt", repo=r, sha=h))


def split_identified(df: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (repo, sha and perhaps a path) in normal form with commit_id, and the others as they came with reject_reason."""
    checks = [("repo", normal_repo(F.col("repo"))), ("sha", normal_sha(F.col("sha"))), *([(path, normal_path(F.col(path)))] if path else [])]
    why = F.coalesce(*[F.when(c.isNull(), f"bad_{n}") for n, c in checks])
    marked = df.withColumn("reject_reason", why)
    good = marked.filter("reject_reason is null").drop("reject_reason").withColumns(dict(checks))
    return good.withColumn("commit_id", content_id("cmt", repo=F.col("repo"), sha=F.col("sha"))), marked.filter("reject_reason is not null")


def orphans(child: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
    """Rows of child without a parent."""
    return child.join(parent.select(*key).distinct(), key, "left_anti")


def check_counts(owners: DataFrame, rows: DataFrame, key: str, stated: str) -> DataFrame:
    """Owners whose stated number of rows differs from the rows there are."""
    n = rows.groupBy(key).agg(F.count("*").alias("n_found"))
    return owners.join(n, key, "left").fillna({"n_found": 0}).filter(F.col(stated) != F.col("n_found"))


def scope_equal(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """One row: keys only in a, keys only in b, keys in both."""
    both = a.select(*key).distinct().withColumn("a", F.lit(1)).join(b.select(*key).distinct().withColumn("b", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("in_both"))


def content_id(prefix: str, **fields: Column) -> Column:
    """prefix_ and the first 32 hex digits of the SHA-256 of the fields as compact JSON with sorted keys."""
    parts = {"id_schema_version": F.lit(ID_SCHEMA), "kind": F.lit(prefix)} | fields
    body = F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(body, 256), 1, 32))


def event_id(commit: Column, kind: Column, path: Column, line: Column, ordinal: Column, target: Column) -> Column:
    return content_id("evt", commit_id=commit, event_type=kind, path=path, new_line_number=line, event_ordinal=ordinal, raw_target=target)


def episode_id(commit: Column, ecosystem: Column, identity: Column, kind: Column, value: Column) -> Column:
    return content_id("dep", commit_id=commit, ecosystem=ecosystem, dependency_identity_key=identity, query_kind=kind, query_value=value)


def _row_hash(columns: list[str]) -> Column:
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(columns)]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *cols)), 1, 12), 16, 10).cast("decimal(20,0)")


def fingerprint(df: DataFrame) -> DataFrame:
    """n_rows, and a digest that does not depend on the order of rows: a sum of row hashes in exact decimals. So the
    fingerprints of parts add up to that of the whole."""
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(_row_hash(df.columns)).cast("string"), F.lit("0")).alias("digest"))


def file_fingerprints(df: DataFrame) -> DataFrame:
    """path, n_rows, digest of each file that df, a table read from files, has rows in."""
    h = _row_hash(df.columns)
    return df.select(F.col("_metadata.file_path").alias("path"), h.alias("h")).groupBy("path").agg(F.count("*").alias("n_rows"), F.sum("h").cast("string").alias("digest"))


def merged(parts: DataFrame) -> DataFrame:
    """The fingerprint of a whole out of those of its parts."""
    return parts.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("digest").cast("decimal(38,0)")).cast("string"), F.lit("0")).alias("digest"))


def manifest(df: DataFrame, name: str, key: list[str]) -> DataFrame:
    """table_name, columns (name:type, in order), key, n_rows, digest: what a publication states of a table."""
    columns = [f"{c}:{t}" for c, t in df.dtypes]
    return fingerprint(df).select(F.lit(name).alias("table_name"), F.lit("|".join(columns)).alias("columns"), F.lit("|".join(key)).alias("key"), "n_rows", "digest")
