"""Derived tables: the driver's star schema read as observations, commits, releases and declarations.

The texts run in Spark and in DuckDB alike, so an oracle can state the same input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from commitlens.plans.scratch import dealt, parts

OBS = """SELECT event_id AS seq, 'agent_' || CAST(user_id % 4 AS STRING) AS agent, event_type AS channel,
  CASE WHEN event_id % 97 = 0 THEN 'bad' WHEN event_type = 'error' THEN 'audit' WHEN event_type = 'signup' THEN 'monthly_audit' ELSE 'main' END AS tier,
  CASE WHEN event_type IN ('click','view') THEN 'author' ELSE 'coauthor' END AS mode,
  'org' || CAST(user_id % 7 AS STRING) || '/repo' || CAST(user_id AS STRING) AS repo,
  md5(CAST(user_id AS STRING) || '-' || CAST(CAST(floor(value / 5) AS BIGINT) AS STRING)) AS sha,
  'org' || CAST(user_id % 7 AS STRING) || '/repo' || CAST(user_id AS STRING) || '@' || md5(CAST(user_id AS STRING) || '-' || CAST(CAST(floor(value / 5) AS BIGINT) AS STRING)) AS repo_sha,
  ts AS author_date FROM events"""
COMMIT = """SELECT o_orderkey AS pos, 'cust' || CAST(o_custkey AS STRING) || '/proj' || CAST(o_orderkey % 5 AS STRING) AS repo,
  md5('o' || CAST(o_orderkey AS STRING)) AS sha, 'agent_' || CAST(o_orderkey % 4 AS STRING) AS agent, o_orderdate AS author_date, o_orderpriority AS priority FROM orders"""
RELEASE = """SELECT 'pkg-' || CAST(l_partkey AS STRING) AS package_name, CAST(l_suppkey AS STRING) || '.' || CAST(l_linenumber AS STRING) || '.0' AS version,
  min(l_shipdate) AS published_at FROM lineitem GROUP BY l_partkey, l_suppkey, l_linenumber"""
DECL = """SELECT DISTINCT l.l_orderkey AS pos, l.l_linenumber AS line_no, 'pkg-' || CAST(l.l_partkey AS STRING) AS package_name,
  CASE WHEN (l.l_orderkey + l.l_linenumber) % 11 = 0 THEN 'workspace:*' WHEN (l.l_orderkey + l.l_linenumber) % 7 = 0 THEN ''
       WHEN l.l_returnflag = 'N' THEN '^' || CAST(l.l_suppkey AS STRING) || '.' || CAST(l.l_linenumber AS STRING) || '.0'
       WHEN l.l_orderkey % 5 = 0 THEN CAST(l.l_suppkey AS STRING) || '.' || CAST(l.l_linenumber AS STRING) || '.9'
       ELSE CAST(l.l_suppkey AS STRING) || '.' || CAST(l.l_linenumber AS STRING) || '.0' END AS version_spec,
  CASE l.l_linenumber % 3 WHEN 0 THEN 'package.json' WHEN 1 THEN 'packages/a/package.json' ELSE 'packages/b/package.json' END AS path,
  o.o_orderdate AS author_date FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""
REPO = """SELECT 'org' || CAST(c_custkey % 7 AS STRING) || '/repo' || CAST(c_custkey AS STRING) AS repo, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE n_name END AS language,
  CAST(floor(abs(c_acctbal) / 50) AS BIGINT) AS stars, c_custkey % 11 = 0 AS fork, c_custkey % 17 = 0 AS archived FROM customer JOIN nation ON c_nationkey = n_nationkey"""
SEGMENT = """SELECT 'agent_' || CAST(o_custkey % 4 AS STRING) AS agent, o_orderpriority AS channel, o_orderkey AS segment,
  CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'split_probe' ELSE 'incomplete_terminal' END AS status, CAST(floor(o_totalprice) AS BIGINT) % 1500 AS total_count,
  CAST(floor(o_totalprice) AS BIGINT) % 1500 > 1000 AS cap_bound, o_orderkey % 29 = 0 AS incomplete_results FROM orders"""
MESSAGE = """SELECT conv_id, turn, role, text || CASE WHEN turn % 3 = 0 THEN chr(10) || chr(10) || 'Co-authored-by: Bot <bot@example.com>' WHEN turn % 3 = 1 THEN chr(10) || chr(10) || 'Co-authored-by: ' || role ELSE '' END AS message FROM conversations"""
REQ = """SELECT DISTINCT l.l_orderkey AS pos, l.l_linenumber AS line_no, 'pkg-' || CAST(l.l_partkey AS STRING) AS package_name, CAST(l.l_suppkey AS STRING) || '.' || CAST(l.l_linenumber AS STRING) || '.0' AS version,
  l.l_suppkey AS major, l.l_linenumber AS minor FROM lineitem l"""
ALL = {"v_req": REQ, "v_obs": OBS, "v_commit": COMMIT, "v_release": RELEASE, "v_decl": DECL, "v_repo": REPO, "v_segment": SEGMENT, "v_message": MESSAGE}
#: By which column these views are dealt out by commit, and what else they read.
BY_COMMIT = {
    "v_req": {"lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")}, "v_commit": {"orders": ("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")},
    "v_decl": {"lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"), "orders": ("o_orderkey", "o_orderdate")},
}
TABLES = ("customer", "nation", "orders", "lineitem", "events", "conversations", "part", "supplier", "documents")


def relation(spark: SparkSession, sf_dir: str, text: str, by: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The rows of a SQL text over the driver's tables, without registering anything in the session. by: for tables that are
    dealt out first, the key and the columns that the text uses; all into as many partitions as the largest needs."""
    used, by = {}, by or {}
    n = max((parts(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in by), default=None)
    for t in TABLES:
        for word in ("FROM ", "JOIN "):
            if f"{word}{t}" in text:
                text = text.replace(f"{word}{t}", f"{word}{{{t}}}")
                used[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
                if t in by:
                    used[t] = dealt(used[t].select(*by[t]), by[t][0], n=n)
    return spark.sql(text, **used)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table."""
    return relation(spark, sf_dir, ALL[name])


def dealt_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """v_req, v_decl or v_commit dealt out by commit (pos)."""
    return relation(spark, sf_dir, ALL[name], BY_COMMIT[name])


def ctes(*names: str) -> str:
    """The views as the WITH clause of an oracle."""
    return "WITH " + ",\n".join(f"{n} AS ({ALL[n]})" for n in names)
