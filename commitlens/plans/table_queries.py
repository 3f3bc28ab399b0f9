"""Queries of the operators that read, land, sample, plan and publish, over the driver's tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from commitlens.functions import ranges
from commitlens.operators import adjudication, corpus, diff, evidence, imports, linking, quality, reports, stats
from commitlens.plans.diff_queries import CASES, _star, declared
from commitlens.plans.queries import AGENTS, GOOD, query
from commitlens.plans.scratch import materialize, parts, scratch_dir
from commitlens.plans.views import ctes, dealt_view, relation, view
from commitlens.sources import tables
from commitlens.streaming import jobs


@query("a1_read_table", "SELECT o_orderkey AS pos, 'a \"b\", c' || chr(10) || o_orderpriority AS note, CAST(o_custkey AS INT) AS n FROM orders")
def a1(spark, d):
    """A table written as CSV with quoted commas, quotes and line ends, read back under its contract."""
    out = f"{scratch_dir(spark)}/a1-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey as pos", "concat('a \"b\", c', chr(10), o_orderpriority, chr(0)) as note", "int(o_custkey) as n")
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(out)
    return tables.read_table(spark, out, "pos long, note string, n int")


@query("a3_split_evidence", "SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT CASE o_orderkey % 4 WHEN 1 THEN 'unknown_type' WHEN 2 THEN 'missing_ecosystem' WHEN 3 THEN 'not_an_object' END AS reason FROM orders) GROUP BY 1")
def a3(spark, d):
    out = f"{scratch_dir(spark)}/a3-{uuid.uuid4().hex}"
    line = """case o_orderkey % 4 when 3 then 'no json' else to_json(named_struct('evidence_type', if(o_orderkey % 4 = 1, 'other', 'registry'), 'source', 'npm', 'ecosystem', if(o_orderkey % 4 = 2, '', 'npm'), 'package_name', concat('p', o_orderkey), 'lookup_status', 'ok', 'queried_at', '2020-01-01T00:00:00Z')) end"""
    spark.read.parquet(f"{d}/orders.parquet").selectExpr(f"{line} as value").write.text(out)
    good, bad = tables.read_evidence(spark, out)
    return good.select(F.lit("kept").alias("reason")).unionByName(bad.select(F.col("reject_reason").alias("reason"))).groupBy("reason").agg(F.count("*").alias("n"))


@query("a4_scan_index", "SELECT o_orderkey AS pos FROM orders WHERE o_orderstatus = 'F' ORDER BY 1 LIMIT 500")
def a4(spark, d):
    return tables.scan_index(spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey as pos", "if(o_orderstatus = 'F', 'ok', 'no') as status"), 500).select("pos")


FILES = "SELECT l_orderkey AS pos, l_linenumber AS n, 'f' || CAST(l_partkey % 5 AS STRING) || '.py' AS filename, CASE WHEN l_partkey % 7 = 0 THEN '' ELSE CAST(l_suppkey AS STRING) END AS patch FROM lineitem"


@query("a6_explode_commit_files", f"SELECT pos, filename, arg_min(patch, (n, patch)) <> '' AS has_patch FROM ({FILES}) GROUP BY 1, 2")
def a6(spark, d):
    """Files of a commit over pages; of a file that is named twice the first counts."""
    f = relation(spark, d, FILES)
    pages = f.groupBy("pos", F.col("n").alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("patch", "filename"))), lambda x: F.struct(x["filename"].alias("filename"), F.lit(None).cast("string").alias("previous_filename"), F.lit("modified").alias("status"), x["patch"].alias("patch"))).alias("files"))
    return tables.explode_commit_files(pages, "pos").select("pos", "filename", "has_patch")


@query("a7_land_raw_items", ctes("v_obs") + " SELECT repo_sha, min(seq) AS seq, arg_min(strftime(author_date, '%Y-%m'), seq) AS month FROM v_obs GROUP BY 1")
def a7(spark, d):
    return tables.land_raw_items(view(spark, d, "v_obs").select("repo_sha", "seq", F.col("author_date").alias("window_start"))).select("repo_sha", "seq", "month")


@query("a9_used_evidence", "SELECT DISTINCT l_suppkey AS evidence_id FROM lineitem WHERE l_linenumber <= 2 AND l_suppkey % 3 <> 0")
def a9(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    evidence = li.filter("l_suppkey % 3 <> 0").select(F.col("l_suppkey").alias("evidence_id")).distinct()
    return tables.used_evidence(evidence, li.filter("l_linenumber <= 2").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("evidence_ids")))


@query("a10_write_table", "SELECT o_orderkey AS pos, o_orderpriority AS priority, 1 AS refused FROM orders")
def a10(spark, d):
    """A table that is written once, and not over again."""
    out = f"{scratch_dir(spark)}/a10-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey as pos", "o_orderpriority as priority")
    tables.write_table(rows, out, ["pos"])
    refused = 0
    try:
        tables.write_table(rows, out, ["pos"])
    except ValueError:
        refused = 1
    return spark.read.parquet(out).select("pos", "priority", F.lit(refused).alias("refused"))


STATUSES = """SELECT l_orderkey AS pos, 'd' || CAST(l_linenumber AS STRING) || '/p.py' AS path, l_linenumber AS ordinal, CASE l_linenumber % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'removed' ELSE 'renamed' END AS status, CASE WHEN l_linenumber % 4 = 3 THEN 'old.py' END AS previous_path, l_partkey % 3 AS lines FROM lineitem"""


@query("c21_patch_statuses", f"WITH s AS ({STATUSES}) SELECT pos, path, CAST(max(lines) AS BIGINT) AS n_lines, CAST(max(lines) AS INT) AS last_line FROM (SELECT DISTINCT ON (pos, path) * FROM s ORDER BY pos, path, lines DESC) WHERE status <> 'removed' AND lines > 0 GROUP BY 1, 2")
def c21(spark, d):
    """Added, modified, removed and renamed files, some without lines, rendered as a diff and read again."""
    f = relation(spark, d, STATUSES).groupBy("pos", "path", "ordinal", "status", "previous_path").agg(F.max("lines").alias("n"))
    lines = F.expr("transform(if(n = 0, array(), sequence(1, int(n))), i -> concat('import m', i))")
    patches = diff.render_patches(f.withColumn("lines", lines), "pos")
    return diff.patch_lines(patches, "pos").groupBy("pos", "path").agg(F.count("*").alias("n_lines"), F.max("line_no").alias("last_line"))


ALIASES = "CASE pos % 5 WHEN 0 THEN 'npm:' || package_name || '@^' || version WHEN 1 THEN 'npm:@scope/' || package_name || '@' || version WHEN 2 THEN 'npm:' || package_name WHEN 3 THEN 'npm:' || package_name || '@' ELSE version END"


@query("d2_npm_alias", ctes("v_req") + " SELECT pos, line_no, package_name, version, CASE pos % 5 WHEN 1 THEN '@scope/' || package_name WHEN 2 THEN NULL WHEN 4 THEN NULL ELSE package_name END AS target, CASE pos % 5 WHEN 0 THEN '^' || version WHEN 1 THEN version WHEN 3 THEN '' END AS asked FROM v_req")
def d2(spark, d):
    alias = linking.npm_alias(F.expr(ALIASES))
    return view(spark, d, "v_req").withColumn("a", alias).select("pos", "line_no", "package_name", "version", "a.target", F.col("a.version").alias("asked"))


@query("e4_prereleases", ctes("v_release") + " SELECT package_name, version, CAST(str_split(version, '.')[2] AS INT) % 2 = 0 AS takes, CAST(str_split(version, '.')[2] AS INT) % 2 = 0 AS pre_inside, true AS plain_inside FROM v_release")
def e4(spark, d):
    """Ranges with and without a prerelease of their own against a prerelease and a release of the same numbers plus one."""
    r = view(spark, d, "v_release").select("package_name", "version")
    # a version's ranges are taken apart and tested once, not for each package that has it
    v = r.select("version").distinct().withColumn("minor", F.split("version", r"\.")[1].cast("int"))
    v = v.withColumn("spec", F.concat(F.lit(">="), "version", F.when(F.col("minor") % 2 == 0, "-beta.0").otherwise("")))
    v = v.withColumn("bounds", ranges.range_bounds("npm", F.col("spec"))).withColumn("takes", ranges.takes_prereleases("npm", F.col("spec"), F.col("bounds")))
    up = F.concat(F.substring_index("version", ".", 2), F.lit(".1"))
    tried = {"pre": F.concat(up, F.lit("-beta.1")), "plain": up}
    v = v.withColumns({f"{k}_key": ranges.version_key(c) for k, c in tried.items()})
    hits = [ranges.range_match("npm", c, F.col(f"{k}_key"), F.col("bounds"), F.col("takes")).alias(f"{k}_inside") for k, c in tried.items()]
    tested = materialize(v.select("version", F.col("bounds").isNotNull().alias("known"), "takes", *hits), "tested")
    return r.join(tested.filter("known").drop("known"), "version").select("package_name", "version", "takes", "pre_inside", "plain_inside")


@query("f11_stage3_summary", ctes("v_commit") + """ SELECT 'episodes' AS dimension, 'all' AS value, count(*) AS n FROM v_commit UNION ALL SELECT 'commits', 'all', count(DISTINCT repo) FROM v_commit UNION ALL SELECT 'registry_status', CASE WHEN pos % 3 = 0 THEN 'not_queried' ELSE priority END, count(*) FROM v_commit GROUP BY 2
UNION ALL SELECT 'advisory_status', agent, count(*) FROM v_commit GROUP BY 2 UNION ALL SELECT 'evidence_records', 'all', count(*) FROM lineitem UNION ALL SELECT 'evidence_payloads', 'all', count(DISTINCT l_partkey) FROM lineitem""")
def f11(spark, d):
    e = view(spark, d, "v_commit").selectExpr("repo as commit_id", "case when pos % 6 = 0 then '' when pos % 3 = 0 then null else priority end as registry_status", "agent as advisory_status")
    return reports.stage3_summary(e, spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("payload_sha256")))


@query("g1_build_candidates", ctes("v_commit") + ", l AS (SELECT l_orderkey AS pos, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1) SELECT c.pos AS episode_id, repo, coalesce(n, 0) AS n_events FROM v_commit c LEFT JOIN l ON c.pos = l.pos WHERE c.pos % 4 < 3")
def g1(spark, d):
    c = view(spark, d, "v_commit")
    e = c.selectExpr("pos as episode_id", "sha", "case pos % 4 when 0 then 'published_after_author_date' when 1 then 'no_matching_version_before_author_date' when 2 then 'current_absent_unknown' else 'exists_before_author_date' end as registry_status")
    links = relation(spark, d, "SELECT l_orderkey AS episode_id, 'import' AS event_type, 'a' AS path, l_linenumber AS line_no FROM lineitem")
    return adjudication.build_candidates(e, c.select("sha", "repo"), links).select("episode_id", "repo", F.coalesce(F.size("events"), F.lit(0)).cast("long").alias("n_events")).withColumn("n_events", F.greatest("n_events", F.lit(0).cast("long")))


@query("g8_comment_guard", "SELECT o_orderkey AS episode_id, CASE WHEN o_orderkey % 6 = 0 THEN 'not_hallucination' ELSE 'probable_hallucination' END AS final_label, CASE WHEN o_orderkey % 6 = 0 THEN 'high' ELSE 'medium' END AS confidence, o_orderkey % 6 = 0 AS corrected FROM orders")
def g8(spark, d):
    return adjudication.comment_guard(*_commented(spark, d))


def _commented(spark, d):
    """Cases whose one manifest line is a comment (every second) in a pyproject.toml (every third)."""
    o = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey as episode_id", "md5(string(o_orderkey)) as sha", "if(o_orderkey % 3 = 0, 'svc/pyproject.toml', 'setup.cfg') as path")
    labels = o.selectExpr("episode_id", "'probable_hallucination' as final_label", "'medium' as confidence")
    lines = o.selectExpr("sha", "path", "1 as line_no", "true as added", "if(episode_id % 2 = 0, '  # \"x\"', '\"x\"') as text")
    return labels, o.selectExpr("episode_id", "sha", "'manifest_addition' as event_type", "path", "1 as line_no"), lines


@query("g8_comment_audit", """SELECT l_orderkey AS episode_id, 'probable_hallucination' AS old_label, 'not_hallucination' AS new_label, string_agg('# part ' || CAST(l_partkey AS VARCHAR), chr(10) ORDER BY l_linenumber) AS commented_lines
FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) GROUP BY 1 HAVING bool_and(l_returnflag <> 'R') AND bool_or(l_linenumber = 2)""")
def g8_audit(spark, d):
    """A case for each order, a manifest line for each of its items: returned ones are no comments; the second is in a
    pyproject.toml."""
    items = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_returnflag").alias("l_returnflag")).selectExpr(
        "l_orderkey as episode_id", "string(l_orderkey) as sha", "'manifest_addition' as event_type", "case l_linenumber when 1 then 'a/Pip.txt' when 2 then 'a/PyProject.toml' else 'b/setup.cfg' end as path", "l_linenumber as line_no", "true as added",
        "concat(if(l_returnflag = 'R', 'part ', '# part '), l_partkey) as text",
    )
    labels = items.select("episode_id").distinct().withColumns({"final_label": F.lit("probable_hallucination"), "confidence": F.lit("medium")})
    audit = adjudication.comment_audit(labels, items.drop("added", "text"), items)
    return audit.withColumn("commented_lines", F.array_join("commented_lines", "\n"))


@query("i6_manifest", "SELECT 'orders' AS table_name, 'o_orderkey:bigint|o_custkey:bigint' AS columns, 'o_orderkey' AS key, count(*) AS n_rows, true AS adds_up FROM orders")
def i6(spark, d):
    """What a publication states of a table; the digest is the sum of those of its files."""
    t = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey").selectExpr("bigint(o_orderkey) as o_orderkey", "bigint(o_custkey) as o_custkey")
    out = f"{scratch_dir(spark)}/i6-{uuid.uuid4().hex}"
    t.repartition(5).write.parquet(out)
    whole = quality.merged(quality.file_fingerprints(spark.read.parquet(out))).withColumnRenamed("digest", "of_files")
    return quality.manifest(t, "orders", ["o_orderkey"]).join(whole, "n_rows").select("table_name", "columns", "key", "n_rows", (F.col("digest") == F.col("of_files")).alias("adds_up"))


@query("l5_checkpoint_guard", "SELECT 'first' AS start, 3 AS files_read, count(*) AS n_rows FROM orders UNION ALL SELECT 'again', 0, count(*) FROM orders UNION ALL SELECT 'grown', 2, 2 * count(*) FROM orders UNION ALL SELECT 'other settings', -1, NULL")
def l5(spark, d):
    """Starts of a job: the first reads all files, the next none, after growth only the new ones; other settings are refused."""
    out = f"{scratch_dir(spark)}/l5-{uuid.uuid4().hex}"
    rows, schema = spark.read.parquet(f"{d}/orders.parquet").selectExpr("bigint(o_orderkey) as pos", "o_orderpriority as priority"), "pos long, priority string"
    rows.repartition(3).write.parquet(f"{out}/in")
    found = []
    for start in ("first", "again", "grown", "other settings"):
        if start == "grown":
            rows.repartition(2).write.mode("append").parquet(f"{out}/in")
        try:
            n = jobs.checkpoint_guard(spark, f"{out}/in", schema, {"v": "2" if start == "other settings" else "1"}, f"{out}/record")
        except ValueError:
            n = -1
        total = None if n < 0 else spark.read.parquet(f"{out}/record").agg(F.sum("n_rows")).first()[0]
        found.append((start, n, total))
    return spark.createDataFrame(found, "start string, files_read int, n_rows long")


@query("c16_chosen_languages", ctes("v_req") + ", n AS (SELECT count(*) AS rows_, count(DISTINCT pos) AS commits FROM v_req) SELECT 'import' AS event_type, 'PyPI' AS ecosystem, rows_ AS n FROM n UNION ALL SELECT 'manifest_addition', 'PyPI', rows_ FROM n")
def c16_languages(spark, d):
    """Python's imports and its ecosystem's manifests out of commits that also hold Go and npm."""
    each = {"a.py": "concat('import ', replace(x.package_name, '-', '_'))", "requirements.txt": "concat(x.package_name, '==', x.version)", "a.ts": "concat('import \"', x.package_name, '\"')", "go.mod": "concat('require github.com/a/', x.package_name, ' v', x.version)"}
    files = [(path, F.expr(f"transform(r, x -> {line})")) for path, line in each.items()]
    patches = declared(spark, d).select("pos", diff.added_files(*sorted(files, key=lambda f: f[0])).alias("patch"))
    events = imports.extract_events(diff.patch_scopes(patches, "pos"), "pos", ("Python",))
    return events.groupBy("event_type", "ecosystem").agg(F.count("*").alias("n"))


#: What the rules of the cases of g7 say, in SQL, by the order in which they are tried.
BASIS = """CASE WHEN registry_status <> 'current_absent_unknown' THEN
 CASE WHEN episode_id % 11 = 0 THEN 'same package and query preexisted in first parent' WHEN episode_id % 13 = 0 THEN 'systematic local, resolved, timing, or official-registry explanation'
  WHEN episode_id % 4 = 0 OR episode_id % 17 = 0 THEN 'weak or import-only temporal signal after conservative exclusions' WHEN episode_id % 3 = 2 THEN 'fresh official registry match predates committer time'
  WHEN episode_id % 3 = 0 THEN 'versioned manifest change has no satisfying version in fresh public registry history' WHEN episode_id % 200000 > 86400 THEN 'first satisfying public version was published more than 24h after committer time'
  ELSE 'first satisfying public version was published within 24h after committer time' END
 WHEN episode_id % 23 = 0 THEN 'same-commit local/workspace/non-registry or resolved-lock evidence' WHEN ecosystem = 'Go' AND package_name NOT LIKE 'example.com%' THEN 'Go subpackage/internal/local module was queried as a registry module'
 WHEN ecosystem = 'npm' AND package_name = 'fs/promises' THEN 'Node built-in module' WHEN ecosystem = 'Cargo' AND query_kind = 'name_only' AND owned THEN 'Rust crate matches repository package'
 WHEN episode_id % 6 = 0 THEN 'present-day absence, import mapping, private registry, deletion, or coverage remains unresolved' WHEN episode_id % 19 = 0 THEN 'patch contains path/workspace/custom-registry/lock/package-definition evidence'
 WHEN query_value LIKE '%+%' THEN 'version may come from an alternate package index' WHEN owned THEN 'present-day absence, import mapping, private registry, deletion, or coverage remains unresolved'
 ELSE 'package exists but fresh official registry has no requested version/range' END"""


@query("g7_published_rows", CASES + f", l AS (SELECT *, repo LIKE '%/' || package_name AS owned FROM c) SELECT 'c' || CAST(episode_id AS STRING) AS case_id, CAST(episode_id AS STRING) AS episode_id, '[\"Go\",\"é\"]' AS languages_json, repo, package_name, registry_status AS original_registry_status, {BASIS} AS adjudication_basis, '' AS patch_path FROM l")
def g7_rows(spark, d):
    """Published rows with the reason of the rule that decided."""
    cases = _star(spark, d).withColumns({"case_id": F.concat(F.lit("c"), "episode_id"), "languages": F.array(F.lit("Go"), F.lit("é")), "sha": F.lit("s"), "agent": F.lit(None).cast("string"), "patch_path": F.lit(None).cast("string")})
    rows = adjudication.published_rows(adjudication.adjudicate(cases))
    return rows.select("case_id", "episode_id", "languages_json", "repo", "package_name", "original_registry_status", "adjudication_basis", "patch_path")


@query("c18_commit_rows", ctes("v_commit") + """ SELECT pos, CAST(count(*) FILTER (l_linenumber % 2 = 0) AS BIGINT) AS import_event_count, CAST(count(*) FILTER (l_linenumber % 2 = 1) AS BIGINT) AS manifest_event_count,
 CASE WHEN pos % 3 = 0 THEN '' ELSE any_value(agent) END AS agent, CASE WHEN pos % 5 = 0 THEN any_value(priority) WHEN pos % 5 = 1 THEN '' ELSE 'Go' END AS repo_primary_language, CASE WHEN pos % 2 = 0 THEN 'Go;Java' ELSE '' END AS actual_changed_languages FROM v_commit LEFT JOIN lineitem ON l_orderkey = pos GROUP BY pos""")
def c18_rows(spark, d):
    """Commits with the first row of the population, the repository's language and the languages changed."""
    c = view(spark, d, "v_commit")
    events = relation(spark, d, "SELECT l_orderkey AS pos, CASE WHEN l_linenumber % 2 = 0 THEN 'import' ELSE 'manifest_addition' END AS event_type FROM lineitem")
    index = c.selectExpr("pos", "case when pos % 5 < 2 then '' else 'Go' end as repo_language", "if(pos % 5 = 0, priority, null) as commit_primary_language")
    people = c.filter("pos % 3 <> 0").selectExpr("pos", "agent", "author_date", "1 as seq")
    rows = imports.build_commits(events, index, "pos", people.unionByName(people.withColumns({"agent": F.lit("second"), "seq": F.lit(2)})), c.filter("pos % 2 = 0").selectExpr("pos", "'Go;Java' as languages"))
    return rows.select("pos", "import_event_count", "manifest_event_count", "agent", "repo_primary_language", "actual_changed_languages")


@query("c19_sample_extracted", ctes("v_commit") + " SELECT pos, agent, CAST(row_number() OVER (PARTITION BY agent ORDER BY pos) AS INT) AS place FROM v_commit WHERE pos % 3 = 0 QUALIFY place <= 20 ORDER BY pos LIMIT 70")
def c19_extracted(spark, d):
    c = view(spark, d, "v_commit").select("pos", "agent")
    return imports.sample_commits(c, 20, 70, "agent", extracted=c.filter("pos % 3 = 0"), key="pos").select("pos", "agent", "place")


@query("c20_stage1_counters", ctes("v_commit") + """, x AS (SELECT *, agent IN ('agent_0', 'agent_1') AS looked, count(*) FILTER (pos % 3 = 0) OVER (PARTITION BY agent ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v_commit),
 y AS (SELECT CASE WHEN NOT looked THEN 'filtered_repo_language' WHEN coalesce(before, 0) >= 50 THEN 'sample_limit_skips' WHEN pos % 3 = 0 THEN 'commits' ELSE 'non_candidate_or_missing_patch' END AS counter FROM x) SELECT counter, count(*) AS n FROM y GROUP BY 1 UNION ALL SELECT 'processed_index_rows', count(*) FROM y""")
def c20_counters(spark, d):
    c = view(spark, d, "v_commit").select("pos", "agent")
    return reports.stage1_counters(c, c.filter("pos % 3 = 0"), ["agent_0", "agent_1"], 50, "pos", "agent")


@query("f1_lookup_keys", ctes("v_decl") + """, k AS (SELECT DISTINCT package_name, CASE WHEN version_spec = '' THEN 'name_only' WHEN version_spec LIKE '^%' THEN 'range' ELSE 'exact' END AS query_kind, version_spec AS query_value FROM v_decl WHERE version_spec <> 'workspace:*')
 SELECT 'registry' AS source, 'npm' AS ecosystem, * FROM k UNION ALL SELECT 'advisory', 'npm', * FROM k WHERE query_kind = 'exact'""")
def f1_keys(spark, d):
    n = parts(spark.read.parquet(f"{d}/lineitem.parquet"))
    return evidence.lookup_keys(evidence.plan_queries(dealt_view(spark, d, "v_decl")), parts=n)


@query("h22_language_gaps", ctes("v_obs") + """, m AS (SELECT repo, CASE WHEN CAST(substr(split_part(repo, '/', 2), 5) AS BIGINT) % 3 = 0 THEN 'missing_metadata' ELSE 'blank' END AS language_state, count(*) AS n_rows FROM v_obs WHERE CAST(substr(split_part(repo, '/', 2), 5) AS BIGINT) % 3 < 2 GROUP BY 1, 2)
 SELECT repo, language_state, n_rows FROM m ORDER BY n_rows DESC, repo, language_state LIMIT 30""")
def h22_gaps(spark, d):
    o = view(spark, d, "v_obs")
    repos = o.select("repo").distinct().withColumn("k", F.substring(F.split("repo", "/")[1], 5, 20).cast("long") % 3).filter("k > 0").selectExpr("repo", "if(k = 1, ' ', 'Go') as language")
    return corpus.language_gaps(corpus.join_language(o.select("repo"), repos))


@query("h26_missing_files", "SELECT l_orderkey AS sha, l_partkey % 4 AS filename, count(*) - count(*) FILTER (l_linenumber <> 2) AS n_missing FROM lineitem GROUP BY 1, 2 HAVING count(*) > count(*) FILTER (l_linenumber <> 2)")
def h26_missing(spark, d):
    li = relation(spark, d, "SELECT l_orderkey AS sha, l_partkey % 4 AS filename, l_linenumber FROM lineitem")
    return corpus.missing_files(li, li.filter("l_linenumber <> 2"))


CONTRACT = "SELECT o_orderkey AS row_id, o_orderstatus AS status, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 9 = 1 THEN '2' ELSE '3' END AS schema_version FROM orders"


@query("i1_contract", f"WITH c AS ({CONTRACT}) SELECT 'empty_key' AS rule, 0 AS n UNION ALL SELECT 'domain:status', count(*) FILTER (status NOT IN ('F', 'O')) FROM c UNION ALL SELECT 'duplicate_key', 0 UNION ALL SELECT 'schema_version', count(*) FILTER (schema_version IS DISTINCT FROM '3') FROM c UNION ALL SELECT 'columns', 1")
def i1_contract(spark, d):
    return quality.contract_violations(relation(spark, d, CONTRACT), ["row_id", "schema_version", "status"], ["row_id"], {"status": ["F", "O"]}, 3)


IDS = "SELECT o_orderkey AS pos, CASE o_orderkey % 7 WHEN 0 THEN 'owner' WHEN 1 THEN ' Org/Name/ ' WHEN 2 THEN 'a/b/c' ELSE 'Org/Name' END AS repo, CASE o_orderkey % 5 WHEN 0 THEN 'xyz1234' WHEN 1 THEN 'ABC12' ELSE ' ABCDEF' || CAST(1000000 + o_orderkey AS STRING) END AS sha, CASE o_orderkey % 3 WHEN 0 THEN '../x' WHEN 1 THEN './src//a.py' ELSE 'src/a.py' END AS path FROM orders"


@query("i5_split_identified", f"""WITH i AS ({IDS}) SELECT pos, CASE WHEN pos % 7 IN (0, 2) THEN 'bad_repo' WHEN pos % 5 < 2 THEN 'bad_sha' WHEN pos % 3 = 0 THEN 'bad_path' END AS reason, CASE WHEN pos % 7 NOT IN (0, 2) AND pos % 5 > 1 AND pos % 3 > 0 THEN 'src/a.py' END AS path,
 CASE WHEN pos % 7 NOT IN (0, 2) AND pos % 5 > 1 AND pos % 3 > 0 THEN 'cmt_' || substr(sha256('{{"id_schema_version":1,"kind":"cmt","repo":"org/name","sha":"abcdef' || CAST(1000000 + pos AS STRING) || '"}}'), 1, 32) END AS commit_id FROM i""")
def i5_split(spark, d):
    good, bad = quality.split_identified(relation(spark, d, IDS), "path")
    none = F.lit(None).cast("string")
    return good.select("pos", none.alias("reason"), "path", "commit_id").unionByName(bad.select("pos", F.col("reject_reason").alias("reason"), none.alias("path"), none.alias("commit_id")))


@query("j14_ranked_rows", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS INT) AS place FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_extendedprice FROM lineitem)")
def j14_ranked(spark, d):
    """All rows of a table in one order, numbered without one task for all."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice").distinct()
    return stats.ranked(li, F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")).select("l_orderkey", "l_linenumber", "place")


@query("h10_filter_counts_by_agent", ctes("v_obs") + f""" SELECT 'all' AS scope, count(*) AS n_rows, count(DISTINCT (agent, repo_sha)) AS n_unique FROM v_obs WHERE {GOOD} UNION ALL SELECT 'invalid', count(*), count(DISTINCT (agent, repo_sha)) FROM v_obs WHERE NOT ({GOOD})
UNION ALL SELECT 'agent:' || agent, count(*), count(DISTINCT repo_sha) FROM v_obs WHERE {GOOD} GROUP BY 1 UNION ALL SELECT 'tier:' || tier, count(*), count(DISTINCT (agent, repo_sha)) FROM v_obs WHERE {GOOD} GROUP BY 1""")
def h10_by_agent(spark, d):
    return corpus.filter_counts(view(spark, d, "v_obs"), AGENTS, ("agent", "repo_sha"))
