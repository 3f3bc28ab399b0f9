"""Every query with SQL against DuckDB at the smallest scale, and small cases that the driver's tables do not hold."""

import math

import pytest
from pyspark.sql import functions as F

from commitlens.functions import paths, versions
from commitlens.operators import diff, imports, manifests, quality, stats, windows
from commitlens.plans import diff_queries, more_queries, table_queries  # noqa: F401
from commitlens.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "customer nation orders lineitem events conversations part supplier documents".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = core.queries()[name](spark, SF)
    want = duck.sql(core.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = ", ".join(f'"{c}"' for c in got.columns)
    assert plain(map(tuple, got.collect())) == plain(duck.sql(f"select {cols} from want").fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


PATCH = """diff --git a/package.json b/package.json
index 0..1 100644
--- a/package.json
+++ b/package.json
@@ -1,4 +1,5 @@
 {
   "dependencies": {
-    "old": "1.0.0",
+    "left-pad": "1.3.0",
     "kept": "2.0.0"
   },
@@ -10,2 +11,4 @@
   "devDependencies": {
+    "axios": "^1.6.0"
   },
+  "name": "x"
diff --git a/src/a.ts b/src/a.ts
--- a/src/a.ts
+++ b/src/a.ts
@@ -0,0 +1,3 @@
+import a from 'left-pad'; const b = require("@scope/pkg/sub");
+--from 'nope'
+export * from './local';
\\ No newline at end of file"""


def test_patch_lines_manifest_and_imports(spark):
    p = spark.createDataFrame([("s1", PATCH), ("s2", PATCH.replace("\n", "\r\n")), ("s3", None), ("s4", "")], "sha string, patch string")
    lines = diff.patch_lines(p)
    got = {(r.sha, r.package_name, r.version_spec, r.line_no) for r in manifests.npm_manifest(lines).collect()}
    assert got == {(s, n, v, i) for s in ("s1", "s2") for n, v, i in (("left-pad", "1.3.0", 3), ("axios", "^1.6.0", 12))}
    found = [(r.line_no, r.ordinal, r.raw_target) for r in imports.js_imports(lines).filter("sha = 's1'").orderBy("line_no", "ordinal").collect()]
    assert found == [(1, 0, "left-pad"), (1, 1, "@scope/pkg/sub"), (3, 0, "./local")]
    t = spark.createDataFrame([("@scope/pkg/sub",), ("a/b",), ("./x",), ("node:fs",), ("@/x",)], "t string")
    assert [r[0] for r in t.select(diff.npm_package(F.col("t"))).collect()] == ["@scope/pkg", "a", None, None, None]


def test_version_kinds(spark):
    cases = [
        ("npm", "1.2.3", "exact"), ("npm", "^1.2", "range"), ("npm", "", "name_only"), ("npm", None, "name_only"), ("npm", "file:../x", "excluded"), ("npm", "v1.2.3-beta.1", "exact"),
        ("PyPI", "==1.2", "exact"), ("PyPI", ">=1,<2", "range"), ("Cargo", "1.2.3", "range"), ("Cargo", "=1.2.3", "exact"), ("Maven", "${v}", "name_only"), ("Maven", "[1,2)", "range"),
    ]
    df = spark.createDataFrame(cases, "eco string, spec string, want string")
    for r in df.withColumn("got", versions.query_kind(F.col("eco"), F.col("spec"))).collect():
        assert r.got == r.want, r


def test_release_keys(spark):
    from packaging.version import Version

    texts = ["1.0", "1", "1.2.3", "1.10", "0.9.9", "2.0.0", "1.2", "0.0.3"]
    df = spark.createDataFrame([(t,) for t in texts], "v string").withColumn("k", versions.release_key(F.col("v")))
    order = [r.v for r in df.orderBy("k", "v").collect()]
    assert order == sorted(texts, key=lambda t: (Version(t), t))
    assert spark.createDataFrame([("1.0-rc1",)], "v string").select(versions.release_key(F.col("v"))).first()[0] is None


def test_wilson(spark):
    df = spark.createDataFrame([(322, 1364856), (704, 1364856)], "k long, n long")
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    got = df.select((100 * lo).alias("lo"), (100 * hi).alias("hi")).collect()
    assert [round(x, 5) for r in got for x in r] == [0.02115, 0.02631, 0.04791, 0.05553]
    assert all(math.isfinite(x) for r in got for x in r)


def test_content_ids(spark):
    cmt = quality.content_id("cmt", repo=F.lower(F.lit("Octo/Demo")), sha=F.lit("abcdef1234567"))
    row = spark.range(1).select(cmt.alias("c")).withColumn("e", quality.event_id(F.col("c"), F.lit("import"), F.lit("src/index.ts"), F.lit(3), F.lit(0), F.lit("left-pad")))
    row = row.withColumn("d", quality.episode_id(F.col("c"), F.lit("npm"), F.lit("left-pad"), F.lit("exact"), F.lit("1.3.0")))
    assert tuple(row.first()) == ("cmt_9bb485f0ba539ba64b38546c2b901237", "evt_fbda30e30b1597ae633595887f523518", "dep_21785cc4f74b01c19800b4835151f029")


def test_paths(spark):
    df = spark.createDataFrame([("a/b.tsx",), ("x/NODE_MODULES/a.js",), ("go.mod",), ("libs.versions.toml",), (None,)], "p string")
    p = F.col("p")
    got = [tuple(r) for r in df.select(paths.source_language(p), paths.is_research_path(p), paths.manifest_kind(p)).collect()]
    assert got == [("TypeScript", True, None), ("JavaScript", False, None), (None, True, "gomod"), (None, True, "catalog"), (None, None, None)]


def test_search_tasks_follow_tiers(spark):
    days = spark.sql("SELECT day, 's' || day AS window_start, 'e' || day AS window_end FROM (SELECT explode(array(date'2025-05-30', date'2025-05-31', date'2025-06-01', date'2025-06-02')) AS day)")
    channels = spark.createDataFrame([("main", "a", "x"), ("audit", "a", "y"), ("monthly_audit", "a", "z"), ("main", "a", "x"), (None, "a", "n")], "tier string, agent string, channel string")
    done = spark.createDataFrame([("main", "a", "x", "s2025-05-31", "e2025-05-31"), ("audit", "a", "y", "s2025-06-02", "other end")], "tier string, agent string, channel string, window_start string, window_end string")
    got = sorted((r.channel, r.window_start[1:]) for r in windows.search_tasks(windows.audit_schedule(days), channels, done).collect())
    every = ["2025-05-30", "2025-05-31", "2025-06-01", "2025-06-02"]
    assert got == [("n", x) for x in every] + [("x", x) for x in every if x != "2025-05-31"] + [("y", "2025-05-30"), ("y", "2025-06-02"), ("z", "2025-05-30"), ("z", "2025-06-01")]
    assert windows.search_tasks(windows.audit_schedule(days), channels, done.limit(0)).count() == 12
    assert windows.search_tasks(windows.audit_schedule(days.limit(0)), channels, done).count() == 0


def test_combinations_and_top_pivot(spark):
    queue = spark.createDataFrame([("r1", "a;b", 3), ("r2", "a;b", 4), ("r3", "b;a", 5), ("r4", None, 1)], "repo string, agents string, n_rows long")
    assert plain(stats.agent_combinations(queue).collect()) == plain([("a;b", 2, 7), ("b;a", 1, 5), (None, 1, 1)])
    counts = spark.createDataFrame([("a", "Go", 3), ("b", "Go", 1), ("a", "Rust", 4), ("b", "C", 9), ("zz", "Zig", 99), ("a", "Nim", 1)], "agent string, language string, n_unique long")
    assert [tuple(r) for r in stats.top_pivot(counts, "language", ["a", "b"], 3).collect()] == [("C", 0, 9, 9), ("Go", 3, 1, 4), ("Rust", 4, 0, 4)]  # Go and Rust tie
    assert stats.top_pivot(counts.limit(0), "language", ["a"], 3).count() == 0
