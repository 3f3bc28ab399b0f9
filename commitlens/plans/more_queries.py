"""Queries of attribution, file classes, contexts, evidence, legacy labels and reports. Each input is one SQL text over the
driver's tables, which Spark and the statement in SQL share."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from commitlens.functions import files
from commitlens.operators import attribution, contexts, evidence, legacy, reports
from commitlens.plans.diff_queries import _events
from commitlens.plans.queries import query
from commitlens.plans.scratch import materialize, parts, scratch_dir
from commitlens.plans.views import ctes, relation, view
from commitlens.streaming import jobs

# --- files ---------------------------------------------------------------------------------------------------------
PATHS = """SELECT p_partkey AS pos, 'c' || CAST(p_partkey % 40 AS STRING) AS sha, p_size AS changes, CASE p_partkey % 13 WHEN 0 THEN 'a/Dockerfile' WHEN 1 THEN 'src/x.D.TS' WHEN 2 THEN 'x/.github/workflows/ci.yml' WHEN 3 THEN '.github/workflows/ci.yaml'
 WHEN 4 THEN 'lib/Package.swift' WHEN 5 THEN 'PACKAGE.JSON' WHEN 6 THEN 'svc/App.csproj' WHEN 7 THEN 'infra/main.tf' WHEN 8 THEN 'noend' WHEN 9 THEN '.github/dependabot.yml' WHEN 10 THEN 'gemfile.lock' WHEN 11 THEN 'chart/Chart.yaml' ELSE 'src/b.tar.py' END AS path FROM part"""
LANGUAGE = "CASE pos % 13 WHEN 0 THEN 'Dockerfile' WHEN 1 THEN 'TypeScript' WHEN 4 THEN 'Swift' WHEN 5 THEN 'JSON' WHEN 7 THEN 'HCL' WHEN 12 THEN 'Python' WHEN 6 THEN '' WHEN 8 THEN '' WHEN 10 THEN '' ELSE 'YAML' END"
CHAIN = """CASE pos % 13 WHEN 0 THEN 'container_build|Container|docker' WHEN 3 THEN 'ci_workflow|CI/CD|github-actions' WHEN 4 THEN 'dependency_manifest|Swift|swift-package-manager' WHEN 5 THEN 'dependency_manifest|JavaScript/TypeScript|npm' WHEN 6 THEN 'dependency_manifest|.NET|nuget'
 WHEN 7 THEN 'infrastructure_as_code|Infrastructure|terraform' WHEN 9 THEN 'dependency_update_config|Multi-ecosystem|dependabot' WHEN 10 THEN 'lockfile|Ruby|bundler' WHEN 11 THEN 'deployment_manifest|Kubernetes|helm' END"""


def _files(spark, d):
    f = relation(spark, d, PATHS)
    return f.withColumn("l", files.file_language(F.col("path"))).withColumns({"file_language": F.col("l.language"), "source": F.col("l.source"), "supply_chain": files.supply_chain(F.col("path"))}).drop("l")


@query("b6_file_language", f"WITH f AS ({PATHS}) SELECT pos, {LANGUAGE} AS language, CASE WHEN pos % 13 = 0 THEN 'filename' WHEN pos % 13 IN (6, 8, 10) THEN 'unknown' ELSE 'extension' END AS source FROM f")
def b6(spark, d):
    return _files(spark, d).select("pos", F.col("file_language").alias("language"), "source")


@query("b7_supply_chain", f"WITH f AS ({PATHS}) SELECT pos, split_part({CHAIN}, '|', 1) AS match_type, split_part({CHAIN}, '|', 2) AS ecosystem, split_part({CHAIN}, '|', 3) AS manager FROM f WHERE {CHAIN} IS NOT NULL")
def b7(spark, d):
    return _files(spark, d).filter("supply_chain is not null").select("pos", "supply_chain.match_type", "supply_chain.ecosystem", "supply_chain.manager")


@query("h24_commit_languages", f"WITH f AS ({PATHS}), x AS (SELECT sha, pos, changes, {LANGUAGE} AS l FROM f), l AS (SELECT sha, l, sum(changes) AS c, min(pos) AS p FROM x WHERE l <> '' GROUP BY sha, l) SELECT sha, string_agg(l, ';' ORDER BY l) AS languages, first(l ORDER BY c DESC, p) AS primary_language FROM l GROUP BY 1")
def h24(spark, d):
    return attribution.commit_languages(_files(spark, d))


@query("h25_commit_supply_chain", f"WITH f AS ({PATHS}), x AS (SELECT sha, {CHAIN} AS x FROM f) SELECT sha, count(x) > 0 AS touches, count(x) AS file_count, coalesce(string_agg(DISTINCT split_part(x, '|', 1), ';' ORDER BY split_part(x, '|', 1)), '') AS match_types, coalesce(string_agg(DISTINCT split_part(x, '|', 2), ';' ORDER BY split_part(x, '|', 2)), '') AS ecosystems, coalesce(string_agg(DISTINCT split_part(x, '|', 3), ';' ORDER BY split_part(x, '|', 3)), '') AS managers FROM x GROUP BY 1")
def h25(spark, d):
    return attribution.commit_supply_chain(_files(spark, d))


SIGNED = "SELECT o_orderkey AS pos, CASE o_orderkey % 6 WHEN 0 THEN '-----BEGIN SSH SIGNATURE-----x' WHEN 1 THEN '-----BEGIN PGP SIGNATURE-----x' WHEN 2 THEN '-----BEGIN PKCS7-----' WHEN 3 THEN 'BEGIN CMS' WHEN 4 THEN 'x' END AS signature FROM orders"


@query("b8_verification_type", f"WITH s AS ({SIGNED}) SELECT pos, CASE pos % 6 WHEN 0 THEN 'ssh' WHEN 1 THEN 'gpg' WHEN 2 THEN 'smime' WHEN 3 THEN 'smime' WHEN 4 THEN 'other' ELSE '' END AS verification_type FROM s")
def b8(spark, d):
    return relation(spark, d, SIGNED).select("pos", files.verification_type(F.col("signature")).alias("verification_type"))


@query("b12_repo_filters", ctes("v_repo") + ", r AS (SELECT *, NOT fork AND NOT archived AND trim(language) <> '' AS t FROM v_repo) SELECT repo, t AS is_target, t AND stars >= 1 AS is_target_1, t AND stars >= 5 AS is_target_5, t AND stars >= 10 AS is_target_10 FROM r")
def b12(spark, d):
    r = view(spark, d, "v_repo").withColumn("language", F.when(F.trim("language") == "", "(blank)").otherwise(F.trim("language")))
    return reports.repo_filters(r).select("repo", "is_target", "is_target_1", "is_target_5", "is_target_10")


# --- attribution ---------------------------------------------------------------------------------------------------
RAW = """SELECT event_id AS seq, 'org/repo' || CAST(user_id % 50 AS STRING) AS repo, CASE WHEN event_id % 41 = 0 THEN '' ELSE 's' || CAST(event_id % 3000 AS STRING) END AS sha, 'U' || CAST(user_id % 9 AS STRING) || '@Bots.example' AS author_email, CASE WHEN user_id % 5 = 0 THEN 'bot-x[bot]' ELSE 'u' END AS author_login,
 'fix: ' || event_type || chr(10) || 'by ' || CASE WHEN event_id % 4 = 0 THEN 'Agent-7 <a@x.example>' ELSE 'hand' END AS message, CAST(ts AS DATE) AS window_start FROM events"""
RULES = "VALUES ('a', 'mail', 'author', 'author-email', 'u3@bots.example'), ('b', 'slug', 'author', 'author', 'Bot-X[bot]'), ('b', 'text', 'coauthor', 'fulltext', 'AGENT-7'), ('c', 'none', 'coauthor', 'fulltext', 'nobody')"
HITS = f"""r AS (SELECT * FROM ({RULES}) v(agent, channel, mode, query_type, val)), raw AS ({RAW}),
hit AS (SELECT raw.*, r.agent, r.channel, r.mode FROM raw JOIN r ON CASE r.query_type WHEN 'author-email' THEN lower(author_email) = lower(val) WHEN 'author' THEN lower(author_login) = lower(val) ELSE contains(lower(message), lower(val)) END)"""


def _attributed(spark, d):
    rules = spark.sql(f"SELECT * FROM ({RULES}) AS v(agent, channel, mode, query_type, value)")
    return attribution.attribute_channels(relation(spark, d, RAW), rules)


@query("h1_attribute_channels", f"WITH {HITS} SELECT seq, agent, channel, mode FROM hit")
def h1(spark, d):
    return _attributed(spark, d).select("seq", "agent", "channel", "mode")


@query("h2_to_observations", f"WITH {HITS}, o AS (SELECT *, row_number() OVER (PARTITION BY agent, channel, window_start, repo, sha ORDER BY seq) AS k FROM hit WHERE sha <> '') SELECT agent, channel, CAST(window_start AS VARCHAR) AS window_start, repo || '|' || sha AS repo_sha, seq, 'fix: ' || split_part(split_part(message, chr(10), 1), ': ', 2) AS message_first_line FROM o WHERE k = 1")
def h2(spark, d):
    return attribution.to_observations(_attributed(spark, d)).select("agent", "channel", F.col("window_start").cast("string").alias("window_start"), "repo_sha", "seq", "message_first_line")


WINDOWS = "SELECT o_orderkey AS pos, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '1999-09-09' END AS sample_date, CASE WHEN o_orderkey % 7 = 0 THEN '1996' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T00:00:00Z' END AS window_start FROM orders"


@query("h28_clean_windows", f"WITH w AS ({WINDOWS}) SELECT pos, CASE WHEN pos % 3 = 1 THEN '1999-09-09' WHEN pos % 7 = 0 THEN '' ELSE window_start[1:10] END AS sample_date FROM w")
def h28(spark, d):
    return attribution.clean_windows(relation(spark, d, WINDOWS)).select("pos", "sample_date")


# --- evidence ------------------------------------------------------------------------------------------------------
EVIDENCE = """SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'registry' ELSE 'advisory' END AS evidence_type, 'src' AS source, 'npm' AS ecosystem, 'pkg-' || CAST(l_partkey % 300 AS STRING) AS package_name, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'exact' END AS query_kind,
 CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE CAST(l_linenumber AS STRING) END AS query_value, 'ok' AS lookup_status, l_shipdate AS queried_at, 'body ' || CAST(l_partkey % 300 AS STRING) || CASE WHEN l_partkey % 300 = 7 THEN CAST(l_orderkey % 3 AS STRING) ELSE '' END AS payload FROM lineitem"""
KEYED = "k AS (SELECT *, evidence_type || '|npm|' || package_name || CASE WHEN evidence_type = 'advisory' THEN '|exact|' || query_value ELSE '' END AS query_key FROM e), g AS (SELECT query_key, count(DISTINCT payload) AS n, min(payload) AS payload FROM k GROUP BY 1)"


def _bundle(spark, d):
    return evidence.bundle_evidence(relation(spark, d, EVIDENCE))


@query("f2_bundle_evidence", f"""WITH e AS ({EVIDENCE}), {KEYED} SELECT query_key, sha256(payload) AS payload_sha256, 'evd_' || substr(sha256('{{"id_schema_version":1,"kind":"evd","payload_sha256":"' || sha256(payload) || '","query_key":"' || query_key || '","source":"src"}}'), 1, 32) AS evidence_id FROM g WHERE n = 1""")
def f2(spark, d):
    return _bundle(spark, d)[0].select("query_key", "payload_sha256", "evidence_id")


@query("f2_conflicting_evidence", f"WITH e AS ({EVIDENCE}), {KEYED} SELECT query_key, n AS n_payloads FROM g WHERE n > 1")
def f2_conflicts(spark, d):
    return _bundle(spark, d)[1]


ENRICH = """SELECT o_orderkey AS episode_id, 'npm' AS ecosystem, 'pkg-' || CAST(o_custkey % 320 AS STRING) AS package_name, CASE WHEN o_orderkey % 10 = 0 THEN 'excluded' ELSE 'exact' END AS query_kind, CAST(o_orderkey % 9 AS STRING) AS query_value, CASE WHEN o_orderkey % 11 = 0 THEN 'ok' ELSE 'not_queried' END AS registry_status, 'not_queried' AS advisory_status,
 CASE WHEN o_orderkey % 2 = 0 THEN 'current_absent_unknown' ELSE 'exists_before_author_date' END AS decided_registry, CASE WHEN o_orderkey % 3 = 0 THEN 'active_before_or_at_author_date' ELSE 'none_observed' END AS decided_advisory FROM orders"""


@query("f5_enrich_episodes", f"""WITH e AS ({EVIDENCE}), {KEYED}, p AS ({ENRICH}), have AS (SELECT query_key FROM g WHERE n = 1), s AS (SELECT p.*, CASE WHEN query_kind = 'excluded' THEN 'not_queryable' WHEN registry_status <> 'not_queried' THEN 'not_in_first_state' WHEN r.query_key IS NULL THEN 'missing_registry_evidence' WHEN a.query_key IS NULL THEN 'missing_advisory_evidence' ELSE 'enriched' END AS state
 FROM p LEFT JOIN have r ON r.query_key = 'registry|npm|' || package_name LEFT JOIN have a ON a.query_key = 'advisory|npm|' || package_name || '|exact|' || query_value)
SELECT episode_id, state, CASE WHEN state = 'enriched' THEN decided_registry ELSE registry_status END AS registry_status, CASE WHEN state <> 'enriched' THEN 'mapped' WHEN episode_id % 6 = 0 THEN 'historical_advisory_precedes_current_absence|mapped' WHEN episode_id % 2 = 0 THEN 'mapped|unknown_deleted_or_unpublished_possible' ELSE 'mapped' END AS reasons, CASE WHEN state = 'enriched' THEN 2 ELSE 0 END AS n_evidence FROM s""")
def f5(spark, d):
    e = relation(spark, d, ENRICH).withColumns({"reason_codes": F.array(F.lit("mapped")), "registry_reasons": F.expr("if(episode_id % 2 = 0, array('unknown_deleted_or_unpublished_possible'), array())").cast("array<string>"), "advisory_reasons": F.array().cast("array<string>")})
    return evidence.enrich_episodes(e, _bundle(spark, d)[0]).select("episode_id", "state", "registry_status", F.array_join("reason_codes", "|").alias("reasons"), F.size("evidence_ids").alias("n_evidence"))


ASKED = "SELECT 'PyPI' AS ecosystem, 'Pkg_' || CAST(l_partkey % 100 AS STRING) AS package_name, CAST(l_linenumber AS STRING) AS version FROM lineitem WHERE l_linenumber < 4"
EARLIER = "SELECT 'PyPI' AS ecosystem, 'pkg-' || CAST(l_partkey % 100 AS STRING) AS package_name, CAST(l_linenumber AS STRING) AS version, l_partkey % 100 <> 5 AS package_exists, l_linenumber <> 2 AND l_partkey % 100 <> 5 AS version_exists, CAST('2020' AS STRING) AS published_at, l_orderkey AS seq FROM lineitem WHERE NOT (l_partkey % 7 = 0 AND l_linenumber = 3)"


@query("f6_reuse_registry", f"""WITH a AS ({ASKED}), e AS ({EARLIER}), q AS (SELECT DISTINCT package_name, lower(replace(package_name, '_', '-')) AS c, version FROM a), x AS (SELECT DISTINCT package_name AS c, version, package_exists, version_exists FROM e),
j AS (SELECT q.package_name, count(*) FILTER (x.c IS NULL) AS missing, bool_and(coalesce(NOT package_exists, false)) AS gone, count(*) FILTER (version_exists) AS n FROM q LEFT JOIN x ON q.c = x.c AND q.version = x.version GROUP BY 1) SELECT package_name, CASE WHEN gone THEN 'not_found' ELSE 'ok' END AS lookup_status, n AS n_versions FROM j WHERE missing = 0""")
def f6(spark, d):
    return evidence.reuse_registry(relation(spark, d, ASKED), relation(spark, d, EARLIER)).select("package_name", "lookup_status", F.size("versions").cast("long").alias("n_versions"))


@query("f6_reuse_advisories", ctes("v_commit") + " SELECT pos, CASE WHEN pos % 3 = 0 THEN 'to_hydrate' ELSE 'verified_zero_result' END AS reuse FROM v_commit WHERE pos % 5 <> 0")
def f6_advisories(spark, d):
    c = view(spark, d, "v_commit")
    q = c.selectExpr("pos", "'npm' as ecosystem", "'P' || pos as package_name", "' 1.0.0 ' as query_value")
    old = c.selectExpr("'npm' as ecosystem", "'p' || pos as package_name", "'1.0.0' as version", "if(pos % 5 = 0, '500', '200') as status", "if(pos % 3 = 0, array('A'), cast(array() as array<string>)) as ids", "pos as seq")
    return evidence.reuse_advisories(q, old).select(F.substring("package_name", 2, 20).cast("long").alias("pos"), "reuse")


HITS7 = "SELECT 'q' || CAST(l_orderkey AS STRING) AS query_key, CASE WHEN l_partkey % 9 = 0 THEN 'MAL-' ELSE 'A-' END || CAST(l_partkey AS STRING) AS id FROM lineitem WHERE l_orderkey % 3 <> 0"
RECORDS = "SELECT DISTINCT CASE WHEN l_partkey % 9 = 0 THEN 'MAL-' ELSE 'A-' END || CAST(l_partkey AS STRING) AS id, '2020' AS published, CAST(NULL AS STRING) AS withdrawn FROM lineitem WHERE l_partkey % 10 <> 0"
QUERIES7 = "SELECT 'q' || CAST(o_orderkey AS STRING) AS query_key, CASE WHEN o_orderkey % 8 = 0 THEN 'other' ELSE 'npm' END AS ecosystem, CASE WHEN o_orderkey % 5 = 0 THEN 'range' ELSE 'exact' END AS query_kind FROM orders"


@query("f7_hydrate_advisories", f"""WITH q AS ({QUERIES7}), h AS (SELECT DISTINCT * FROM ({HITS7})), r AS ({RECORDS}), g AS (SELECT h.query_key, count(*) AS n, count(r.id) AS k, count(*) FILTER (h.id LIKE 'MAL-%') AS m FROM h LEFT JOIN r ON h.id = r.id GROUP BY 1)
SELECT q.query_key, CASE WHEN query_kind <> 'exact' OR ecosystem = 'other' THEN 'unsupported' WHEN n > k THEN 'hydration_incomplete' ELSE 'ok' END AS lookup_status, CASE WHEN query_kind <> 'exact' OR ecosystem = 'other' THEN 0 ELSE coalesce(n, 0) END AS n_advisories, CASE WHEN query_kind <> 'exact' OR ecosystem = 'other' THEN 0 ELSE coalesce(m, 0) END AS n_malicious FROM q LEFT JOIN g ON q.query_key = g.query_key""")
def f7(spark, d):
    got = evidence.hydrate_advisories(relation(spark, d, QUERIES7), relation(spark, d, HITS7), relation(spark, d, RECORDS))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return got.select("query_key", "lookup_status", F.greatest(size("advisories"), F.lit(0)).alias("n_advisories"), F.greatest(size(F.filter("advisories", lambda a: a["malicious"])), F.lit(0)).alias("n_malicious"))


GO = "SELECT o_orderkey AS pos, CASE o_orderkey % 4 WHEN 0 THEN 'github.com/a/r' || CAST(o_orderkey AS STRING) || '/v2/sub' WHEN 1 THEN 'gitlab.com/a/r' || CAST(o_orderkey AS STRING) || '/sub' WHEN 2 THEN 'example.com/a/r' || CAST(o_orderkey AS STRING) || '/sub' ELSE 'github.com/x' END AS package_name FROM orders"


@query("f9_go_modules", f"WITH g AS ({GO}) SELECT pos, CASE WHEN pos % 3 = 0 AND pos % 4 < 2 THEN replace(package_name, '/sub', '') WHEN pos % 4 = 3 THEN package_name END AS resolved_module FROM g")
def f9(spark, d):
    g = relation(spark, d, GO)
    modules = g.filter("pos % 3 = 0").select(F.regexp_replace("package_name", "/sub$", "").alias("module")).filter("module not like 'example%'").unionByName(g.filter("pos % 4 = 3").select(F.col("package_name").alias("module")))
    found = evidence.resolve_go_modules(g.select("package_name").distinct(), modules)
    return g.join(found, "package_name").select("pos", "resolved_module")


ATTEMPTS = "SELECT 'k' || CAST(l_orderkey AS STRING) AS query_key, l_linenumber AS seq, CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN 'error' ELSE 'ok' END AS lookup_status, 'e' || CAST(l_linenumber AS STRING) AS error FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) x WHERE l_orderkey % 4 <> 0"


@query("f10_query_states", f"WITH a AS ({ATTEMPTS}), g AS (SELECT query_key, arg_max(lookup_status, seq) AS s, count(*) FILTER (lookup_status = 'error') AS n, arg_max(error, seq) FILTER (lookup_status = 'error') AS e FROM a GROUP BY 1) SELECT 'k' || CAST(o_orderkey AS STRING) AS query_key, CASE s WHEN 'error' THEN 'retry' WHEN 'ok' THEN 'done' ELSE 'pending' END AS state, coalesce(n, 0) AS attempts, coalesce(e, '') AS last_error FROM orders LEFT JOIN g ON query_key = 'k' || CAST(o_orderkey AS STRING)")
def f10(spark, d):
    return evidence.query_states(relation(spark, d, "SELECT 'k' || CAST(o_orderkey AS STRING) AS query_key FROM orders"), relation(spark, d, ATTEMPTS))


@query("f10_error_rate", f"WITH a AS ({ATTEMPTS}) SELECT count(*) AS observed, count(*) FILTER (lookup_status = 'error') AS errors, count(*) FILTER (lookup_status = 'error') / CAST(count(*) AS DOUBLE) AS error_rate, count(*) >= 500 AS pause FROM a")
def f10_gate(spark, d):
    return evidence.error_rate_gate(relation(spark, d, ATTEMPTS))


# --- legacy labels -------------------------------------------------------------------------------------------------
MATCH = """SELECT o_orderkey AS pos, 'org/r' AS repo, 's' || CAST(o_orderkey AS STRING) AS sha, CASE o_orderkey % 5 WHEN 0 THEN 'npm' WHEN 1 THEN 'Maven' WHEN 2 THEN 'Go' WHEN 3 THEN 'Packagist' ELSE 'Hex' END AS ecosystem, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'G:Pkg' || CAST(o_orderkey % 100 AS STRING) END AS declared_package,
 '' AS package_candidate, CASE WHEN o_orderkey % 17 = 0 THEN 'mapping_unknown' WHEN o_orderkey % 19 = 0 THEN 'first_party_module_import' WHEN o_orderkey % 23 = 0 THEN 'not_observed_in_parsed_dependency_files' ELSE 'observed_in_manifest' END AS declared_dependency_match, '' AS mapping_status,
 CASE o_orderkey % 7 WHEN 0 THEN '^1.0.0' WHEN 1 THEN 'workspace:*' WHEN 2 THEN '1.2-SNAPSHOT' WHEN 3 THEN 'v0.0.0' ELSE '=1.2.3' END AS version_spec, CASE WHEN o_orderkey % 7 = 0 THEN 'range' ELSE 'exact' END AS version_kind, '' AS resolved_version, '' AS resolution_source,
 CASE WHEN o_orderkey % 29 = 0 THEN 'gradle.version_catalog:x' WHEN o_orderkey % 31 = 0 THEN 'npm.custom_registry:y' WHEN o_orderkey % 37 = 0 THEN 'bom_managed_by:b:org.b:bom:1' ELSE '' END AS dependency_group, '' AS namespace_hint, CASE WHEN o_orderkey % 2 = 0 THEN 'false' ELSE 'true' END AS dependency_file_changed_in_diff, o_orderdate AS author_date FROM orders"""
FLAGS = """f AS (SELECT *, CASE pos % 7 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN '1.2-SNAPSHOT' WHEN 3 THEN 'v0.0.0' ELSE '1.2.3' END AS v, pos % 7 = 1 AS private, pos % 19 = 0 AND pos % 17 <> 0 AS first, pos % 29 = 0 AS cat, pos % 29 <> 0 AND pos % 31 <> 0 AND pos % 37 = 0 AS bom, ecosystem = 'Maven' AND pos % 7 = 2 AS snap,
  ecosystem = 'npm' AND pos % 29 <> 0 AND pos % 31 = 0 AS custom, CASE WHEN pos % 17 = 0 THEN true WHEN pos % 19 = 0 THEN false WHEN pos % 23 = 0 THEN declared_package = '' ELSE false END AS unsure, pos % 17 <> 0 AND pos % 19 <> 0 AND pos % 23 <> 0 AND pos % 2 = 0 AS old FROM m)"""


@query("b11_legacy_flags", f"WITH m AS ({MATCH}), {FLAGS} SELECT pos, declared_package AS query_package, v AS query_version, private AS is_private, first AS is_first_party, cat AS is_catalog_possible, bom AS is_bom_managed, snap AS is_snapshot, custom AS is_custom_registry, false AS is_alias, old AS not_introduced, unsure AS is_uncertain, false AS valid_go_module, false AS packagist_non_exact FROM f")
def b11(spark, d):
    f = legacy.legacy_flags(legacy.with_query(relation(spark, d, MATCH)))
    return f.select("pos", "query_package", "query_version", "is_private", "is_first_party", "is_catalog_possible", "is_bom_managed", "is_snapshot", "is_custom_registry", "is_alias", "not_introduced", "is_uncertain", "valid_go_module", "packagist_non_exact")


@query("g10_legacy_queries", f"WITH m AS ({MATCH}), {FLAGS} SELECT ecosystem, lower(declared_package) AS package_key, v AS query_version, min(pos) AS pos FROM f WHERE NOT (unsure OR private OR first OR cat OR snap OR custom) AND v <> '' GROUP BY ALL")
def g10(spark, d):
    return legacy.legacy_queries(relation(spark, d, MATCH)).select("ecosystem", "package_key", "query_version", "pos")


ANSWERS = """SELECT DISTINCT ecosystem, CASE WHEN n % 2 = 0 THEN 'g:pkg' ELSE 'G:Pkg' END || CAST(n AS STRING) AS package, version, CASE WHEN n % 11 = 0 THEN '429' ELSE '200' END AS status, CASE WHEN n % 11 = 0 THEN 'rate_limited' ELSE 'ok' END AS bucket, CASE WHEN n % 11 = 0 THEN 'timeout' ELSE 'ok' END AS detail, '' AS note, n % 5 <> 0 AS package_exists, n % 5 <> 0 AND n % 3 <> 0 AS version_exists,
 CASE WHEN n % 4 <> 0 THEN CASE WHEN n % 7 < 3 THEN TIMESTAMP '1990-01-01 00:00:00' ELSE TIMESTAMP '2030-01-01 00:00:00' END END AS publish_time FROM (SELECT o_orderkey % 100 AS n, CASE o_orderkey % 5 WHEN 0 THEN 'npm' WHEN 1 THEN 'Maven' WHEN 2 THEN 'Go' ELSE 'Packagist' END AS ecosystem, CASE o_orderkey % 7 WHEN 2 THEN '1.2-SNAPSHOT' WHEN 3 THEN 'v0.0.0' ELSE '1.2.3' END AS version FROM orders) x"""
WARNED = "SELECT DISTINCT 'npm' AS ecosystem, 'G:Pkg' || CAST(o_orderkey % 100 AS STRING) AS package, '1.2.3' AS version, CASE WHEN o_orderkey % 3 = 0 THEN 'MAL-1' ELSE 'A-1' END AS id, TIMESTAMP '1991-01-01 00:00:00' AS published, '' AS body FROM orders WHERE o_orderkey % 100 < 30"


@query("g9_legacy_labels", f"""WITH m AS ({MATCH}), {FLAGS}, r AS ({ANSWERS}), w AS (SELECT package, bool_or(id LIKE 'MAL%') AS mal FROM ({WARNED}) GROUP BY 1),
j AS (SELECT f.*, r.package IS NOT NULL AS have, r.bucket, r.package_exists AS pe, r.version_exists AS ve, r.publish_time AS pt, w.mal FROM f LEFT JOIN r ON r.ecosystem = f.ecosystem AND r.version = f.v AND lower(r.package) = lower(f.declared_package) LEFT JOIN w ON f.ecosystem = 'npm' AND f.v = '1.2.3' AND w.package = f.declared_package),
l AS (SELECT pos, CASE WHEN declared_package = '' OR unsure THEN 'mapping_uncertain' WHEN ecosystem = 'Hex' THEN 'unsupported_ecosystem' WHEN first THEN 'first_party_module_import' WHEN private THEN 'private_or_local_dependency' WHEN cat THEN 'catalog_possible_dependency_not_build_usage' WHEN ecosystem = 'Go' AND v = 'v0.0.0' THEN 'go_placeholder_version'
 WHEN snap THEN 'maven_snapshot_or_non_central_version' WHEN custom THEN 'npm_custom_registry_not_queried' WHEN bucket = 'rate_limited' THEN 'registry_rate_limited_timeout' WHEN pos % 23 = 0 AND pos % 19 <> 0 THEN 'manifest_does_not_explain_import' WHEN v = '' AND bom THEN 'bom_managed_version_not_resolved' WHEN v = '' THEN 'no_exact_version_range'
 WHEN ecosystem = 'Maven' AND have AND NOT (pe AND ve) THEN 'maven_default_registry_missing_custom_repository_possible' WHEN have AND NOT (pe AND ve) AND old THEN 'dependency_not_introduced_in_commit' WHEN NOT pe THEN 'current_registry_package_or_version_missing_no_history' WHEN NOT ve THEN 'current_registry_version_missing_no_history'
 WHEN pt > author_date THEN 'publish_time_after_author_date_requires_history_validation' WHEN mal THEN 'malicious_advisory_published_before_commit' WHEN mal IS NOT NULL THEN 'advisory_published_before_commit' WHEN pt <= author_date THEN 'publish_time_before_or_equal_commit_author_date' ELSE 'publish_time_unknown' END AS label_reason FROM j) SELECT label_reason, count(*) AS n FROM l GROUP BY 1""")
def g9(spark, d):
    summed = legacy.summarize_advisories(relation(spark, d, WARNED), ["ecosystem", "package", "version"])
    got = legacy.legacy_final(relation(spark, d, MATCH), relation(spark, d, ANSWERS), summed)
    return got.groupBy("label_reason").agg(F.count("*").alias("n"))


@query("g11_summarize_advisories", f"WITH w AS ({WARNED}) SELECT package, count(*) AS advisory_count, string_agg(id, ';' ORDER BY id) AS advisory_ids, coalesce(string_agg(id, ';' ORDER BY id) FILTER (id LIKE 'MAL%'), '') AS malicious_ids FROM w GROUP BY 1")
def g11(spark, d):
    return legacy.summarize_advisories(relation(spark, d, WARNED), ["package"]).select("package", "advisory_count", "advisory_ids", "malicious_ids")


TWO = "SELECT o_orderkey AS pos, '1' AS version, CASE WHEN o_orderkey % 2 = 0 THEN false ELSE true END AS package_exists, CASE WHEN o_orderkey % 3 = 0 THEN false ELSE true END AS version_exists, CASE WHEN o_orderkey % 5 = 0 THEN '2020' END AS publish_time, 'n' AS note, 'b' AS bucket, 'd' AS detail FROM orders"


@query("g13_second_source", f"""WITH t AS ({TWO}) SELECT pos, CASE WHEN pos % 4 = 0 THEN true ELSE package_exists END AS package_exists, CASE WHEN pos % 4 = 0 THEN true ELSE version_exists END AS version_exists, coalesce(publish_time, CASE WHEN pos % 4 = 0 THEN '2021' END) AS publish_time,
 'n' || CASE WHEN pos % 4 = 0 THEN ';depsdev_corrected_package_exists' || CASE WHEN pos % 3 = 0 THEN ';depsdev_corrected_version_exists' ELSE '' END || CASE WHEN pos % 5 <> 0 THEN ';depsdev_filled_publish_time' ELSE '' END ELSE '' END AS note, CASE WHEN pos % 4 = 0 THEN 'ok' ELSE 'b' END AS bucket FROM t""")
def g13(spark, d):
    t = relation(spark, d, TWO)
    two = t.filter("pos % 4 = 0").selectExpr("pos", "true as package_exists", "true as version_exists", "'2021' as publish_time")
    return legacy.merge_second_source(t, two, ["pos"]).select("pos", "package_exists", "version_exists", "publish_time", "note", "bucket")


FAILED = "SELECT o_orderkey AS pos, CASE o_orderkey % 9 WHEN 0 THEN '200' WHEN 1 THEN '404' WHEN 2 THEN '429' WHEN 3 THEN '503' WHEN 4 THEN '400' WHEN 5 THEN '403' WHEN 6 THEN '0' WHEN 7 THEN '425' ELSE '418' END AS status, CASE o_orderkey % 5 WHEN 0 THEN 'read Timed out' WHEN 1 THEN 'getaddrinfo' WHEN 2 THEN 'bad JSON' ELSE '' END AS error FROM orders"


@query("g14_failure_buckets", f"""WITH f AS ({FAILED}), b AS (SELECT *, CASE pos % 9 WHEN 0 THEN 'ok' WHEN 1 THEN 'not_found_current_registry' WHEN 2 THEN 'rate_limited' WHEN 3 THEN 'registry_server_error' WHEN 4 THEN 'bad_request_or_malformed_version' WHEN 5 THEN 'auth_or_forbidden' WHEN 6 THEN 'network_or_decode_error' WHEN 7 THEN 'temporary_registry_error' ELSE 'http_418' END AS bucket FROM f)
SELECT pos, bucket, CASE WHEN bucket = 'ok' THEN 'ok' WHEN pos % 5 = 0 THEN 'timeout' WHEN pos % 5 = 1 THEN 'dns_or_resolution_error' WHEN pos % 5 = 2 THEN 'decode_error' WHEN pos % 9 = 1 THEN 'http_404_not_found' ELSE bucket END AS detail FROM b""")
def g14(spark, d):
    return relation(spark, d, FAILED).select("pos", legacy.failure_bucket(F.col("status")).alias("bucket"), legacy.failure_detail(F.col("status"), F.col("error")).alias("detail"))


POMS = """SELECT 'org.b:bom' || CAST(p_partkey AS STRING) AS bom, '1' AS bom_version, '<project xmlns="http://m.example"><groupId>org.b</groupId><version>1</version><properties><v.x>' || CAST(p_size AS STRING) || '.0</v.x><v.y>${v.x}</v.y></properties><dependencyManagement><dependencies>'
 || '<dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v.y}</version></dependency><dependency><groupId>${project.groupId}</groupId><artifactId>b</artifactId><version>2.1</version></dependency><dependency><groupId>g</groupId><artifactId>c</artifactId><version>${none}</version></dependency></dependencies></dependencyManagement></project>' AS xml FROM part""".replace("{", "' || chr(123) || '").replace("}", "' || chr(125) || '")


#: The rows are dealt out before documents are made of them: the table is narrow, so its one file would be one task.
POM_ROWS = {"part": ("p_partkey", "p_size")}


@query("g16_bom_versions", "SELECT 'org.b:bom' || CAST(p_partkey AS STRING) AS bom, 'g:a' AS target, CAST(p_size AS STRING) || '.0' AS resolved FROM part UNION ALL SELECT 'org.b:bom' || CAST(p_partkey AS STRING), 'org.b:b', '2.1' FROM part")
def g16(spark, d):
    return legacy.bom_versions(relation(spark, d, POMS, POM_ROWS)).select("bom", "target", "resolved")


@query("g15_resolve_bom", ctes("v_commit") + ", p AS (SELECT p_partkey, p_size FROM part) SELECT pos, CASE WHEN pos % 3 = 0 THEN 'not_managed' WHEN pos % 3 = 1 AND pos % 5 = 0 THEN 'not_applicable' WHEN p_partkey IS NULL THEN 'target_not_listed' ELSE 'resolved' END AS bom_status, CASE WHEN pos % 3 > 0 AND NOT (pos % 3 = 1 AND pos % 5 = 0) AND p_partkey IS NOT NULL THEN CAST(p_size AS STRING) || '.0' ELSE '' END AS resolved_version FROM v_commit LEFT JOIN p ON p_partkey = pos % 1000")
def g15(spark, d):
    rows = view(spark, d, "v_commit").selectExpr("pos", "'g:a' as declared_package", "'' as package_candidate", "if(pos % 3 = 0, '', concat('x;bom_managed_by:al:org.b:bom', pos % 1000, if(pos % 3 = 1 and pos % 5 = 0, '', ':1'))) as dependency_group", "'' as version_spec", "'' as version_kind", "'' as resolved_version", "'' as resolution_source")
    return legacy.resolve_bom(rows, legacy.bom_versions(relation(spark, d, POMS, POM_ROWS), asked=legacy.bom_references(rows))).select("pos", "bom_status", "resolved_version")


@query("e9_partial_matches", ctes("v_release") + ", p AS (SELECT package_name, list_sort(list(version)) AS v, min(str_split(version, '.')[1]) AS a FROM v_release GROUP BY 1) SELECT package_name, array_to_string([x FOR x IN v IF x LIKE a || '.1.%'][1:8], ';') AS matches FROM p")
def e9(spark, d):
    p = view(spark, d, "v_release").groupBy("package_name").agg(F.collect_list("version").alias("v"), F.min(F.split("version", r"\.")[0]).alias("a"))
    return p.select("package_name", F.array_join(legacy.partial_matches(F.concat("a", F.lit(".1")), F.col("v")), ";").alias("matches"))


# --- contexts ------------------------------------------------------------------------------------------------------
OLD = """SELECT o_orderkey AS seq, 'Org/R' AS repo, 'S' || CAST(o_orderkey % 900 AS STRING) AS sha, CASE o_orderkey % 4 WHEN 0 THEN 'PyPI' WHEN 1 THEN 'Cargo' WHEN 2 THEN 'Go' ELSE 'npm' END AS ecosystem, CASE o_orderkey % 9 WHEN 0 THEN 'first_party_module_import' WHEN 1 THEN 'mapping_unknown' WHEN 2 THEN 'observed_in_manifest_and_lockfile' WHEN 3 THEN 'observed_in_lockfile_possible_transitive'
 WHEN 4 THEN 'observed_in_python_wheel_metadata' WHEN 5 THEN '' ELSE 'observed_in_manifest' END AS declared_dependency_match, 'src/a.py' AS source_file, 't' || CAST(o_orderkey AS STRING) AS import_raw, 'root' AS import_root, 'Pkg' AS declared_package, CASE WHEN o_orderkey % 11 = 0 THEN '{ workspace = true }' ELSE '1.0' END AS version_spec,
 '1.0' AS resolved_version, 'local_maven_property' AS resolution_source, '' AS dependency_group, '/x/dep.txt' AS dep_file_path, CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'false' END AS dependency_file_changed_in_diff FROM orders""".replace("{", "' || chr(123) || '").replace("}", "' || chr(125) || '")


@query("d10_contexts_from_matches", f"""WITH o AS ({OLD}), s AS (SELECT *, ecosystem = 'Cargo' AND seq % 11 = 0 AS ws FROM o WHERE seq % 9 <> 5) SELECT raw_target, alignment_status, reasons, version_spec, resolved_version FROM (SELECT import_raw AS raw_target, CASE WHEN ws THEN 'private_or_local_excluded' WHEN seq % 9 = 0 THEN 'first_party_excluded' WHEN seq % 9 = 1 THEN 'mapping_uncertain' WHEN seq % 9 = 2 THEN 'matched_manifest_and_lock' WHEN seq % 9 = 3 THEN 'lockfile_only_observed'
 WHEN seq % 2 = 0 THEN 'matched_manifest' ELSE 'matched_existing_manifest' END AS alignment_status, array_to_string(list_sort(list_concat(CASE WHEN ws THEN ['private_or_local', 'workspace_inherited'] ELSE [] END, CASE WHEN seq % 9 = 0 THEN ['first_party'] WHEN seq % 9 = 1 THEN CASE WHEN ecosystem = 'PyPI' THEN ['mapping_uncertain', 'python_alias_not_found'] ELSE ['mapping_uncertain'] END
 WHEN seq % 9 = 3 THEN ['possible_transitive_dependency'] WHEN seq % 9 = 4 THEN ['python_wheel_metadata', 'resolved_local_maven_property'] ELSE ['resolved_local_maven_property'] END)), '|') AS reasons, CASE WHEN ws THEN 'workspace:' ELSE version_spec END AS version_spec, CASE WHEN ws THEN '' ELSE '1.0' END AS resolved_version FROM s)""")
def d10(spark, d):
    return contexts.contexts_from_matches(relation(spark, d, OLD)).select("raw_target", "alignment_status", F.array_join("reason_codes", "|").alias("reasons"), "version_spec", "resolved_version")


DEPS = """SELECT l_orderkey AS seq, 'Org/R' || CAST(l_orderkey % 40 AS STRING) AS repo, 'S1' AS sha, CASE WHEN l_orderkey % 6 = 0 THEN 'Rust' ELSE 'Python' END AS repo_language, 'Pkg_' || CAST(l_partkey % 60 AS STRING) AS package_name, CASE WHEN l_linenumber % 2 = 0 THEN 'exact' ELSE 'range' END AS version_kind, CASE WHEN l_linenumber = 3 THEN '{ workspace = true }' ELSE '==1.' || CAST(l_linenumber AS STRING) || ' ; python_version > "3"' END AS version_spec,
 CASE WHEN l_linenumber = 5 THEN '1.2' ELSE '' END AS resolved_version, CASE WHEN l_linenumber = 2 THEN 'manifest+lockfile' WHEN l_linenumber = 7 THEN 'first_party_module' ELSE '' END AS resolution_source, '' AS dependency_group, CASE WHEN l_linenumber = 1 THEN '' ELSE 'req.txt' END AS dep_file_path, 'true' AS dependency_file_changed_in_diff FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem) x""".replace("{", "' || chr(123) || '").replace("}", "' || chr(125) || '")


@query("d10_contexts_from_dependencies", f"WITH x AS ({DEPS}) SELECT ecosystem, alignment_status, version_spec, count(*) AS n FROM (SELECT CASE repo_language WHEN 'Rust' THEN 'Cargo' ELSE 'PyPI' END AS ecosystem, CASE WHEN resolution_source = 'first_party_module' THEN 'first_party_excluded' WHEN repo_language = 'Rust' AND version_spec LIKE '%workspace%' THEN 'private_or_local_excluded' ELSE 'matched_manifest' END AS alignment_status, CASE WHEN repo_language = 'Rust' AND version_spec LIKE '%workspace%' THEN 'workspace:' ELSE version_spec END AS version_spec FROM x WHERE dep_file_path <> '') GROUP BY ALL")
def d10_dependencies(spark, d):
    return contexts.contexts_from_dependencies(relation(spark, d, DEPS)).groupBy("ecosystem", "alignment_status", "version_spec").agg(F.count("*").alias("n"))


@query("d11_dedupe_contexts", f"WITH o AS ({OLD}) SELECT lower(sha) AS sha, count(*) AS n FROM o WHERE declared_dependency_match <> '' GROUP BY 1")
def d11(spark, d):
    c = contexts.contexts_from_matches(relation(spark, d, OLD)).withColumn("seq", F.monotonically_increasing_id())
    return contexts.dedupe_contexts(c.unionByName(c.withColumn("repo", F.lower("repo")).withColumn("seq", F.col("seq") + 1))).groupBy("sha").agg(F.count("*").alias("n"))


@query("d12_derived_contexts", ctes("v_commit") + " SELECT sha, 'GitHub.com/' || repo || CASE WHEN pos % 2 = 0 THEN '/sub' ELSE '' END AS package_name, 'first_party_excluded' AS alignment_status FROM v_commit WHERE pos % 3 = 0")
def d12(spark, d):
    c = view(spark, d, "v_commit")
    e = c.selectExpr("sha", "'Go' as ecosystem", "'a/x.go' as path", "case pos % 3 when 0 then 'GitHub.com/' || repo || if(pos % 2 = 0, '/sub', '') when 1 then 'github.com/' || repo || 'x' else 'example.com/' || repo end as raw_target")
    return contexts.derived_contexts(c, e).select("sha", "package_name", "alignment_status")


WHEELS = "SELECT 'pkg-' || CAST(p_partkey % 60 AS STRING) AS package_name, '1.2' AS version, 'root' || CAST(p_partkey % 30 AS STRING) AS import_root, CASE WHEN p_partkey % 60 = 9 THEN 'error' ELSE 'ok' END AS status FROM part"


@query("d13_wheel_bridge", f"""WITH x AS ({DEPS}), w AS (SELECT DISTINCT package_name, import_root FROM ({WHEELS}) WHERE status = 'ok'), e AS (SELECT lower(repo) AS repo, lower(replace(package_name, '_', '-')) AS p, resolution_source FROM x WHERE repo_language = 'Python' AND dep_file_path <> '' AND (resolved_version = '1.2' OR (resolved_version = '' AND version_kind = 'exact' AND version_spec LIKE '==1.2 ;%'))),
j AS (SELECT repo, import_root, count(DISTINCT p) AS n FROM e JOIN w ON p = w.package_name GROUP BY 1, 2) SELECT repo, import_root, CASE WHEN n > 1 THEN 'mapping_uncertain|python_wheel_multiple_candidates' ELSE 'python_wheel_metadata' END AS reasons, CASE WHEN n > 1 THEN '' ELSE '1.2' END AS resolved_version FROM j""")
def d13(spark, d):
    return contexts.wheel_bridge(relation(spark, d, DEPS), relation(spark, d, WHEELS)).select(F.lower("repo").alias("repo"), "import_root", F.array_join("reason_codes", "|").alias("reasons"), "resolved_version")


IMPORTS = """SELECT o_orderkey AS event_id, 's' || CAST(o_orderkey % 500 AS STRING) AS sha, CASE o_orderkey % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'PyPI' ELSE 'Go' END AS ecosystem, 'svc/src/a.x' AS path, CASE o_orderkey % 3 WHEN 0 THEN 'lib/sub' WHEN 1 THEN 'lib.sub' ELSE 'example.com/m/v2/pkg' END AS raw_target, CASE o_orderkey % 3 WHEN 0 THEN 'lib' WHEN 1 THEN 'lib' ELSE 'example.com/m/v2/pkg' END AS package_name FROM orders"""
KNOWN = """SELECT DISTINCT 'r' AS repo, 's' || CAST(o_orderkey % 500 AS STRING) AS sha, v.* FROM orders, (VALUES (0, 'npm', 'svc/src/a.x', 'lib/sub', 'lib', 'lib', 'mapping_uncertain', ''), (1, 'npm', 'svc/src/a.x', 'other', 'lib', 'better', 'matched_manifest', '2.0.0'), (2, 'PyPI', '*', 'lib', 'lib', 'wheel', 'matched_manifest', '3.0'), (3, 'PyPI', 'svc/src/a.x', 'x', 'lib', 'Here', 'lockfile_only_observed', '4.0'),
 (4, 'Go', 'go.mod', 'm', 'm', 'example.com/m', 'matched_manifest', 'v1.0.0'), (5, 'Go', 'svc/go.mod', 'm', 'm', 'example.com/m/v2', 'matched_manifest', 'v2.0.0'), (6, 'Go', 'other/go.mod', 'm', 'm', 'example.com/m/v2/pkg', 'matched_manifest_and_lock', 'v9.0.0'), (7, 'npm', 'package.json', 'first', 'first', 'first', 'first_party_excluded', ''))
 v(k, ecosystem, source_path, raw_target, import_root, package_name, alignment_status, resolved_version) WHERE (o_orderkey % 500) % 8 <> v.k"""


def _known(spark, d):
    empty = {c: F.lit("") for c in ("version_spec", "resolution_source", "dependency_group", "dependency_path")}
    return relation(spark, d, KNOWN).drop("k").withColumns(empty | {"reason_codes": F.array(F.lit("known"))})


CHOSEN = """CASE ecosystem WHEN 'npm' THEN CASE WHEN g <> 0 THEN 'lib' ELSE 'better' END WHEN 'PyPI' THEN CASE WHEN g <> 2 THEN 'wheel' ELSE 'Here' END ELSE CASE WHEN g <> 5 THEN 'example.com/m/v2' ELSE 'example.com/m' END END"""


@query("d14_select_context", f"WITH i AS ({IMPORTS}), x AS (SELECT *, (event_id % 500) % 8 AS g FROM i) SELECT event_id, {CHOSEN} AS package_name FROM x")
def d14(spark, d):
    return contexts.select_context(relation(spark, d, IMPORTS), _known(spark, d)).select("event_id", "c.package_name")


@query("d15_select_manifest_context", f"WITH k AS ({KNOWN}) SELECT sha, raw_target FROM k WHERE source_path = 'svc/go.mod' UNION ALL SELECT sha, 'first' FROM k WHERE source_path = 'package.json'")
def d15(spark, d):
    m = relation(spark, d, "SELECT DISTINCT 's' || CAST(o_orderkey % 500 AS STRING) AS sha FROM orders")
    m = m.selectExpr("sha", "inline(array(named_struct('event_id', 1, 'ecosystem', 'Go', 'path', 'svc/go.mod', 'package_name', 'example.com/m/v2', 'status', 'direct_manifest'), named_struct('event_id', 2, 'ecosystem', 'npm', 'path', 'package.json', 'package_name', 'x', 'status', 'unresolved_gradle_alias'), named_struct('event_id', 3, 'ecosystem', 'npm', 'path', 'package.json', 'package_name', 'x', 'status', 'direct_manifest')))")
    return contexts.select_manifest_context(m, _known(spark, d)).select("sha", "c.raw_target")


@query("d16_context_plan", f"""WITH i AS ({IMPORTS}), x AS (SELECT *, (event_id % 500) % 8 AS g FROM i), p AS (SELECT *, {CHOSEN} AS pk FROM x) SELECT event_id, CASE WHEN pk = 'lib' THEN 'unresolved:lib/sub' ELSE lower(pk) END AS identity, CASE WHEN pk = 'lib' THEN 'unresolved' ELSE 'exact' END AS query_kind,
 CASE pk WHEN 'better' THEN '2.0.0' WHEN 'wheel' THEN '3.0' WHEN 'Here' THEN '4.0' WHEN 'example.com/m' THEN 'v1.0.0' WHEN 'example.com/m/v2' THEN 'v2.0.0' ELSE '' END AS query_value, CASE WHEN pk = 'lib' THEN 'context_mapping' ELSE 'existing_manifest_context' END AS source FROM p""")
def d16(spark, d):
    i = relation(spark, d, IMPORTS)
    j = i.join(contexts.select_context(i, _known(spark, d)), ["sha", "event_id"])
    return contexts.context_plan(j).select("event_id", "identity", "query_kind", "query_value", "source")


# --- reports -------------------------------------------------------------------------------------------------------
LABELS = """SELECT o_orderkey AS episode_id, 'r' || CAST(o_custkey AS STRING) AS repo, 's' || CAST(o_orderkey % 2000 AS STRING) AS sha, CASE o_orderkey % 4 WHEN 0 THEN 'confirmed_hallucination' WHEN 1 THEN 'probable_hallucination' WHEN 2 THEN 'not_hallucination' ELSE 'indeterminate' END AS final_label, 'agent_' || CAST(o_orderkey % 3 AS STRING) AS agent, CASE o_orderkey % 2 WHEN 0 THEN 'npm' ELSE 'Go' END AS ecosystem,
 CASE WHEN o_orderkey % 5 = 0 THEN 'TypeScript|JavaScript' ELSE 'Go' END AS language_text, CASE WHEN o_orderkey % 7 = 0 THEN 'C:/x' ELSE 'diff_corpus/x' END AS patch_path, CASE WHEN o_orderkey % 9 = 0 THEN 'excluded' ELSE 'exact' END AS query_kind FROM orders"""


def _labels(spark, d):
    return relation(spark, d, LABELS).withColumn("languages", F.split("language_text", r"\|"))


@query("j1_summarize_adjudication", f"""WITH l AS ({LABELS}) SELECT 'rows' AS dimension, 'all' AS value, count(*) AS n FROM l UNION ALL SELECT 'label', final_label, count(*) FROM l GROUP BY 2 UNION ALL SELECT 'agent', agent, count(*) FROM l GROUP BY 2 UNION ALL SELECT 'ecosystem', ecosystem, count(*) FROM l GROUP BY 2
UNION ALL SELECT 'language', x, count(*) FROM (SELECT unnest(str_split(language_text, '|')) AS x FROM l) GROUP BY 2 UNION ALL SELECT 'commits', 'unique', count(DISTINCT repo || '@' || sha) FROM l UNION ALL SELECT 'patch_path', 'not_portable', count(*) FILTER (episode_id % 7 = 0) FROM l""")
def j1(spark, d):
    return reports.summarize_adjudication(_labels(spark, d))


@query("j4_rates_by_language", f"""WITH l AS ({LABELS}), x AS (SELECT unnest(str_split(language_text, '|')) AS language, final_label FROM l WHERE query_kind <> 'excluded'), g AS (SELECT language, count(*) AS n_episodes, count(*) FILTER (final_label LIKE 'conf%') AS k, count(*) FILTER (final_label LIKE 'conf%' OR final_label LIKE 'prob%') AS m FROM x GROUP BY 1), p AS (SELECT *, k / CAST(n_episodes AS DOUBLE) AS q, 3.841458820694124 AS z2 FROM g)
SELECT language, n_episodes, k AS confirmed_hallucination, round(100.0 * k / n_episodes, 9) AS strict_percent, round(100.0 * m / n_episodes, 9) AS sensitivity_percent, round(100 * (q + z2 / (2 * n_episodes) - 1.959963984540054 * sqrt(q * (1 - q) / n_episodes + z2 / (4.0 * n_episodes * n_episodes))) / (1 + z2 / n_episodes), 9) AS strict_low FROM p""")
def j4(spark, d):
    e = _labels(spark, d)
    g = reports.rates_by_language(e.select("episode_id", "query_kind", F.explode("languages").alias("language")), e)
    r = lambda c: F.round(F.col(c).cast("double"), 9).alias(c)
    return g.select("language", "n_episodes", "confirmed_hallucination", r("strict_percent"), r("sensitivity_percent"), r("strict_low"))


PEOPLE = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id END AS account_id, CASE WHEN event_id % 5 = 0 THEN CAST(user_id + 100000 AS STRING) || '+n@users.noreply.github.com' WHEN event_id % 7 = 0 THEN '' WHEN user_id % 4 = 0 THEN 'shared@x.example' WHEN user_id % 4 = 1 THEN 'U' || CAST(user_id AS STRING) || '@x.example' ELSE 'v' || CAST(user_id AS STRING) || '@' || event_type || '.example' END AS email FROM events"""


@query("j13_resolve_identities", f"""WITH p AS (SELECT *, lower(trim(email)) AS a FROM ({PEOPLE})), k AS (SELECT DISTINCT a, account_id FROM p WHERE account_id IS NOT NULL AND a <> '' AND a NOT LIKE '%+n@users%'), o AS (SELECT a, min(account_id) AS acc FROM k GROUP BY 1 HAVING count(*) = 1), c AS (SELECT account_id FROM k GROUP BY 1 HAVING count(*) = 1), m AS (SELECT a, acc FROM o JOIN c ON acc = account_id)
SELECT resolution, count(*) AS n, count(DISTINCT identity) AS n_identities FROM (SELECT CASE WHEN account_id IS NOT NULL THEN 'account' WHEN p.a LIKE '%+n@users%' THEN 'noreply' WHEN acc IS NOT NULL THEN 'mapped' WHEN p.a <> '' THEN 'unresolved' ELSE 'missing' END AS resolution, coalesce(CAST(account_id AS VARCHAR), CASE WHEN p.a LIKE '%+n@users%' THEN split_part(p.a, '+', 1) END, CAST(acc AS VARCHAR), nullif('m:' || p.a, 'm:'), 'e:' || event_id) AS identity FROM p LEFT JOIN m ON p.a = m.a) GROUP BY 1""")
def j13(spark, d):
    return reports.resolve_identities(relation(spark, d, PEOPLE)).groupBy("resolution").agg(F.count("*").alias("n"), F.count_distinct("identity").alias("n_identities"))


ROLES = "SELECT 'u' || CAST(user_id % 50 AS STRING) AS identity, CASE WHEN event_id % 3 = 0 THEN 'coauthor' ELSE 'author' END AS role, 's' || CAST(event_id % 1500 AS STRING) AS sha, 'r' || CAST(event_id % 70 AS STRING) AS repo, ts AS author_date FROM events"


@query("j14_rank_identities", f"""WITH r AS ({ROLES}), g AS (SELECT identity, count(DISTINCT sha) FILTER (role = 'author') AS author_sha, count(DISTINCT sha) FILTER (role = 'coauthor') AS coauthor_sha, count(DISTINCT sha) AS union_sha, count(DISTINCT repo || '@' || sha) AS repo_sha, count(DISTINCT repo) AS n_repos, count(DISTINCT CAST(author_date AS DATE)) AS active_days, count(DISTINCT strftime(author_date, '%Y-%m')) AS active_months, CAST(CAST(min(author_date) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(author_date) AS DATE) AS VARCHAR) AS last_day FROM r GROUP BY 1)
SELECT *, round_even(repo_sha / CAST(union_sha AS DOUBLE), 6) AS duplication, CAST(row_number() OVER (ORDER BY union_sha DESC, author_sha DESC, n_repos DESC, active_days DESC, identity) AS INT) AS place FROM g""")
def j14_identities(spark, d):
    return reports.rank_identities(relation(spark, d, ROLES))


SAID = "SELECT conv_id, role, CASE turn % 4 WHEN 0 THEN 'feat(x)!: add' WHEN 1 THEN 'Fix: a #' || CAST(turn AS STRING) WHEN 2 THEN 'fix it &#39; no' ELSE 'docs: y' END || chr(10) || 'see' || CASE WHEN turn % 5 = 0 THEN ' (#12)' ELSE '' END AS message FROM conversations"


@query("j16_message_profile", f"""WITH s AS (SELECT role, turn FROM conversations), g AS (SELECT role, count(*) AS n, count(*) FILTER (turn % 4 <> 2) AS n_conventional, count(*) FILTER (turn % 4 = 1 OR turn % 5 = 0) AS n_issue FROM s GROUP BY 1), t AS (SELECT role, CASE turn % 4 WHEN 0 THEN 'feat' WHEN 1 THEN 'fix' ELSE 'docs' END AS t, count(*) AS k FROM s WHERE turn % 4 <> 2 GROUP BY ALL)
SELECT g.*, round_even(n_conventional / CAST(n AS DOUBLE), 6) AS conventional_share, round_even(n_issue / CAST(n AS DOUBLE), 6) AS issue_share, coalesce((SELECT t FROM t WHERE t.role = g.role ORDER BY k DESC, t LIMIT 1), '') AS top_type FROM g""")
def j16(spark, d):
    return reports.message_profile(relation(spark, d, SAID), "role")


@query("j18_cohort_profile", """WITH a AS (SELECT s_suppkey AS account_id FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 7 = 1), c AS (SELECT l_suppkey AS account_id, 'agent_' || CAST(l_linenumber % 3 AS STRING) AS agent, l_orderkey AS sha, l_partkey % 40 AS repo FROM lineitem JOIN a ON l_suppkey = account_id), p AS (SELECT account_id, count(DISTINCT sha) AS n, count(DISTINCT agent) AS k FROM c GROUP BY 1), f AS (SELECT account_id FROM p ORDER BY n DESC, account_id LIMIT 5),
m AS (SELECT 'all' AS agent, * FROM c UNION ALL SELECT agent, * FROM c) SELECT unnest(['accounts', 'shas', 'repos']) AS measure, agent, CAST(unnest([x, y, z]) AS DOUBLE) AS n FROM (SELECT agent, count(DISTINCT account_id) AS x, count(DISTINCT sha) AS y, count(DISTINCT repo) AS z FROM m GROUP BY 1)
UNION ALL SELECT 'several_agents', 'all', CAST(count(*) FILTER (k > 1) AS DOUBLE) FROM p UNION ALL SELECT 'median_shas', 'all', median(n) FROM p UNION ALL SELECT 'top_shas', 'all', CAST(count(DISTINCT sha) AS DOUBLE) FROM c SEMI JOIN f ON c.account_id = f.account_id""")
def j18(spark, d):
    a = relation(spark, d, "SELECT s_suppkey AS account_id, CASE WHEN s_suppkey % 3 = 0 THEN 'Uppsala, SWEDEN' WHEN s_suppkey % 7 = 1 THEN 'malmö' WHEN s_suppkey % 5 = 0 THEN 'Swedenborg' END AS location FROM supplier")
    c = relation(spark, d, "SELECT l_suppkey AS account_id, 'agent_' || CAST(l_linenumber % 3 AS STRING) AS agent, l_orderkey AS sha, l_partkey % 40 AS repo FROM lineitem")
    return reports.cohort_profile(a, c, ["Sweden", "Malmö"], top=5)


@query("c20_stage1_summary", ctes("v_commit") + """ SELECT 'commits' AS dimension, 'all' AS value, count(*) AS n FROM v_commit UNION ALL SELECT 'quadrant', CASE WHEN pos % 2 = 0 THEN 'I+M+' ELSE 'I-M-' END, count(*) FROM v_commit GROUP BY 2 UNION ALL SELECT 'repo_language', agent, count(*) FROM v_commit GROUP BY 2
UNION ALL SELECT 'changed_language', 'Go', count(*) FROM v_commit UNION ALL SELECT 'changed_language', 'Java', count(*) FILTER (pos % 3 = 0) FROM v_commit UNION ALL SELECT 'events', 'all', count(*) FROM lineitem UNION ALL SELECT 'event_type', l_returnflag, count(*) FROM lineitem GROUP BY 2""")
def c20(spark, d):
    c = view(spark, d, "v_commit").selectExpr("if(pos % 2 = 0, 'I+M+', 'I-M-') as dependency_quadrant", "agent as repo_language", "if(pos % 3 = 0, array('Go', 'Java', ''), array('Go')) as changed_languages")
    return reports.stage1_summary(c, relation(spark, d, "SELECT l_returnflag AS event_type FROM lineitem"))


@query("d22_stage2_summary", ctes("v_commit") + " SELECT 'episodes' AS dimension, 'all' AS value, count(*) AS n FROM v_commit UNION ALL SELECT 'quadrant', agent, count(*) FROM v_commit GROUP BY 2 UNION ALL SELECT 'alignment', priority, count(*) FROM v_commit GROUP BY 2 UNION ALL SELECT 'query_kind', CASE WHEN pos % 2 = 0 THEN 'exact' ELSE '' END, count(*) FROM v_commit GROUP BY 2")
def d22(spark, d):
    return reports.stage2_summary(view(spark, d, "v_commit").selectExpr("agent as dependency_quadrant", "priority as alignment_status", "if(pos % 2 = 0, 'exact', null) as query_kind"))


@query("i7_audit_episodes", ctes("v_commit") + " SELECT 'lacks_registry_result' AS rule, count(*) FILTER (pos % 4 <> 0 AND pos % 6 = 1) AS n FROM v_commit UNION ALL SELECT 'lacks_evidence_ids', count(*) FILTER (pos % 4 <> 0 AND pos % 5 = 0) FROM v_commit UNION ALL SELECT 'unknown_evidence_id', count(*) FILTER (pos % 3 = 0) FROM v_commit")
def i7(spark, d):
    c = view(spark, d, "v_commit")
    e = c.selectExpr("pos as episode_id", "if(pos % 4 = 0, 'excluded', 'exact') as query_kind", "if(pos % 6 = 1, 'not_queried', 'ok') as registry_status", "if(pos % 5 = 0, array('e' || pos, ''), array('e' || pos, 'x')) as evidence_ids")
    return reports.audit_episodes(e, c.filter("pos % 3 <> 0").selectExpr("'e' || pos as evidence_id").unionByName(c.limit(1).selectExpr("'x' as evidence_id")))


@query("i9_verify_publication", f"WITH l AS ({LABELS}) SELECT 'label:' || final_label AS name, count(*) AS actual, count(*) AS expected, true AS passed FROM l GROUP BY final_label UNION ALL SELECT 'rows', count(*), 1, false FROM l UNION ALL SELECT 'not_portable', count(*) FILTER (episode_id % 7 = 0), NULL, false FROM l UNION ALL SELECT 'label:none', NULL, 3, false")
def i9(spark, d):
    rows = _labels(spark, d)
    want = rows.groupBy(F.concat(F.lit("label:"), "final_label").alias("name")).agg(F.count("*").alias("expected")).unionByName(spark.createDataFrame([("rows", 1), ("label:none", 3)], "name string, expected long"))
    return reports.verify_publication(rows, want)


@query("i10_unchanged", "SELECT true AS unchanged, count(*) AS n_rows, count(*) AS n_after FROM lineitem")
def i10(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return reports.unchanged(li, li.repartition(7))


# --- streams -------------------------------------------------------------------------------------------------------
@query("l2_stream_episodes", ctes("v_req") + ", e AS (SELECT DISTINCT pos, 'github.com/acme/' || package_name AS identity, 'v' || version AS v FROM v_req UNION ALL SELECT DISTINCT pos, 'github.com/acme/single', 'v1.0.0' FROM v_req) SELECT pos, count(*) AS n_episodes FROM e GROUP BY 1")
def l2(spark, d):
    """A commit's events arrive in three pieces, each a batch; a commit becomes episodes when its announced number is there."""
    out = f"{scratch_dir(spark)}/l2-{uuid.uuid4().hex}"
    events = materialize(_events(spark, d, ["gomod"], "Go"), "events")
    n = parts(events)
    events = events.join(events.groupBy("pos").agg(F.count("*").alias("n_events")), "pos").withColumn("arrived_at", F.lit("2020-01-01 00:00:00").cast("timestamp"))
    for piece in range(3):
        events.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == piece).repartition(n).write.mode("append").parquet(out + "/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", n).parquet(out + "/in")
    jobs.stream_episodes(stream, out + "/t", out + "/c", "pos", "n_events")
    return spark.read.parquet(f"{out}/t/episodes/*").groupBy("pos").agg(F.count("*").alias("n_episodes"))



@query("l3_stream_enrich", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'not_queried' ELSE 'queried' END AS evidence_state, CASE event_id % 4 WHEN 0 THEN 'early' WHEN 1 THEN 'late' WHEN 2 THEN 'same' END AS answer FROM events")
def l3(spark, d):
    """Evidence that came three hours before its episode, with it, five hours after it, and none at all. Two last rows a
    year on, in a batch of their own, let the watermarks pass the table's end."""
    out = f"{scratch_dir(spark)}/l3-{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) as at")
    found = e.filter("event_id % 4 < 3").selectExpr("event_id", "timestampadd(HOUR, case event_id % 4 when 0 then -3 when 1 then 5 else 0 end, at) as found_at", "case event_id % 4 when 0 then 'early' when 1 then 'late' else 'same' end as answer")
    far = e.agg(F.max("at").alias("at")).selectExpr("-1L as event_id", "timestampadd(YEAR, 1, at) as at")
    for rows, last, name in ((e, far, "episodes"), (found, far.selectExpr("event_id", "at as found_at", "'last' as answer"), "evidence")):
        rows.coalesce(1).write.parquet(f"{out}/{name}")
        last.coalesce(1).write.mode("append").parquet(f"{out}/{name}")
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/{name}")
    met = jobs.stream_enrich(read("episodes", e.schema), read("evidence", found.schema), ["event_id"], "at", "found_at")
    jobs.run_once(met.select("event_id", "evidence_state", "answer"), out + "/t", out + "/c")
    return spark.read.schema("event_id long, evidence_state string, answer string").parquet(out + "/t").filter("event_id >= 0")
