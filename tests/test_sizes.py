"""What keeps a job's cost in proportion to its input: documents parsed once, rows dealt out, no shuffle of texts."""

import re

import pytest
from pyspark.sql import functions as F

from commitlens.operators import diff, evidence, legacy
from commitlens.plans import diff_queries, more_queries, queries, scratch, table_queries, views  # noqa: F401  (they register their queries)

SF = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


POM = "<project><properties><v.x>{}</v.x></properties><dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${{v.x}}</version></dependency></dependencies></dependencyManagement></project>"


def test_poms_are_parsed_once_in_many_tasks(spark):
    made = views.relation(spark, SF, more_queries.POMS, more_queries.POM_ROWS)
    assert made.rdd.getNumPartitions() >= 4
    plan = physical(legacy.bom_versions(made))
    assert len(re.findall("XPathListEvaluator", plan)) == 4


def test_only_boms_that_are_asked_for_are_parsed(spark):
    poms = spark.createDataFrame([("o:b", "1", POM.format(3)), ("o:b", "2", POM.format(4)), ("o:c", "1", "no document")], "bom string, bom_version string, xml string")
    rows = spark.createDataFrame(
        [(1, "x;bom_managed_by:al:o:b:1", ""), (2, "", ""), (3, "bom_managed_by:al:o:b", ""), (4, "bom_managed_by:al:o:z:1", "")], "pos long, dependency_group string, version_kind string"
    ).withColumns({c: F.lit(v) for c, v in {"declared_package": "g:a", "package_candidate": "", "version_spec": "", "resolved_version": "", "resolution_source": ""}.items()})
    asked = legacy.bom_references(rows)
    assert sorted(map(tuple, asked.collect())) == [("o:b", "1"), ("o:z", "1")]
    versions = legacy.bom_versions(poms, asked=asked)
    assert [tuple(r) for r in versions.collect()] == [("o:b", "1", "g:a", "3")]
    want = [(1, "resolved", "3"), (2, "not_managed", ""), (3, "not_applicable", ""), (4, "target_not_listed", "")]
    got = legacy.resolve_bom(rows, versions).select("pos", "bom_status", "resolved_version")
    assert sorted(map(tuple, got.collect())) == want
    assert "SortMergeJoin" not in physical(got)


def test_many_versions_of_boms_leave_rows_without_reference_in_place(spark, monkeypatch):
    monkeypatch.setattr(legacy, "is_small", lambda df: False)
    versions = spark.createDataFrame([("o:b", "1", "g:a", "3")], "bom string, bom_version string, target string, resolved string")
    rows = spark.createDataFrame([(1, "bom_managed_by:al:o:b:1"), (2, None), (3, "")], "pos long, dependency_group string").withColumns(
        {c: F.lit(v) for c, v in {"version_kind": "", "declared_package": "g:a", "package_candidate": "", "version_spec": "", "resolved_version": "", "resolution_source": ""}.items()}
    )
    got = legacy.resolve_bom(rows, versions)
    assert sorted((r.pos, r.bom_status, r.resolved_version) for r in got.collect()) == [(1, "resolved", "3"), (2, "not_managed", ""), (3, "not_managed", "")]


def test_languages_of_commits_need_one_shuffle_of_narrow_rows(spark):
    """Patches are made, cut and summed up where their commit's row was dealt; the flags of a key have a fixed size."""
    plan = physical(queries.c17(spark, SF))
    assert plan.count("Exchange") == 1 and "ObjectHashAggregate(keys=[pos#" in plan
    assert "bool_or" in plan or "max(" in plan


@pytest.mark.parametrize("name", ["c16_chosen_languages", "c16_extract_events", "c13_maven_manifest", "c3_python_statements", "c3_python_imports", "c2_js_forms", "c6_normalize_imports", "c1_c7_npm_manifest"])
def test_texts_and_lines_are_not_shuffled(spark, name):
    """Commits are dealt out while their rows are narrow, and stay there: neither their texts nor their lines are shuffled."""
    plan = physical(queries.queries()[name](spark, SF))
    assert plan.count("REPARTITION_BY_NUM") == (2 if name == "c1_c7_npm_manifest" and "hashpartitioning(o_orderkey" in plan else 1)
    assert "hashpartitioning(pos" not in plan


def test_lookups_are_told_apart_in_as_many_tasks_as_they_need(spark):
    df = spark.createDataFrame([("p", "exact", "1"), ("p", "exact", "1"), ("p", "name_only", None), ("q", "excluded", "x")], "package_name string, query_kind string, query_value string")
    got = evidence.lookup_keys(df, parts=9)
    assert got.rdd.getNumPartitions() == 9
    assert sorted(map(tuple, got.collect())) == [("advisory", "npm", "p", "exact", "1"), ("registry", "npm", "p", "exact", "1"), ("registry", "npm", "p", "name_only", "")]


def test_rows_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(scratch, "DEALT_ROWS", 100)
    table = spark.read.parquet(f"{SF}/orders.parquet")
    assert scratch.parts(table, 100) == max(4, -(-table.count() // 100))
    assert scratch.dealt(table.select("o_orderkey"), "o_orderkey", n=7).rdd.getNumPartitions() == 7


def test_diffs_of_a_row_are_those_of_its_files(spark):
    df = spark.createDataFrame([(1, ["x", "y"], []), (2, ["z"], [])], "pos int, a array<string>, b array<string>")
    one = df.select("pos", diff.added_files(("a", F.col("a")), ("q/b", F.col("b"))).alias("patch"))
    files = df.selectExpr("pos", "inline(array(struct('a' as path, 'a' as ordinal, a as lines), struct('q/b' as path, 'q/b' as ordinal, b as lines)))")
    assert df.select(diff.added_files(("a", F.col("a")), ("b", F.lit(None).cast("array<string>"))).alias("p")).filter("p like '%b/b%'").count() == 0
    assert sorted(one.collect()) == sorted(diff.render_patches(files, "pos").select("pos", "patch").collect())


def test_the_driver_does_not_fit(spark, monkeypatch):
    """The chosen texts are fitted in a task; the driver's memory holds landmarks and weights only."""
    toxicity = pytest.importorskip("commitlens.llm.toxicity")
    rows = [(i, ("you are a worthless idiot" if i % 2 else "the quiet river runs along") + f" w{i}", i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    monkeypatch.setattr(toxicity, "fit", None)
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert model is not None and "^idiot$" in model.kernel.landmarks


def test_answers_do_not_depend_on_the_time(spark):
    """What a package's history says to a query is worked out once, not for each time that an episode asks at; no table of runs
    of ranks is made for small packages, and each declaration is summed up once."""
    plan = physical(queries.queries()["f3_asof_registry"](spark, SF))
    assert "author_date" not in "".join(re.findall(r"Aggregate\(keys=\[([^\]]*)\]", plan))
    assert "Window" not in plan and "power" not in plan


def test_odd_queries_of_a_registry(spark):
    """Queries without package, value, time or a known kind; ranges of packages without or with odd releases only."""
    at = "timestamp_ntz'2020-01-01 00:00:00'"
    asked = [(0, None, "exact", "1.0.0"), (1, "p", "exact", None), (2, None, "range", "^1.0.0"), (3, "p", "range", None), (4, "p", None, "x"), (5, "p", "other", ""), (6, "p", "excluded", "x"), (7, "none", "range", "^1.0.0"), (8, "odd", "range", "^1.0.0"), (9, None, "name_only", ""), (10, "p", "range", "^1.0.0")]
    q = spark.createDataFrame(asked, "id int, package_name string, query_kind string, query_value string").selectExpr("*", f"if(id = 10, null, {at}) as author_date")
    rel = spark.sql("select * from values ('p', '1.0.0', timestamp_ntz'2019-01-01 00:00:00'), ('odd', 'next', timestamp_ntz'2019-01-01 00:00:00') as t(package_name, version, published_at)")
    got = evidence.registry_status(q, rel, ["id"])
    absent, cannot = "current_absent_unknown", "cannot_compare"
    assert {r.id: r.registry_status for r in got.collect()} == {0: absent, 1: absent, 2: cannot, 3: cannot, 4: cannot, 5: cannot, 6: "excluded", 7: absent, 8: cannot, 9: absent, 10: cannot}
    assert {r.id: r.reasons[-1] for r in got.collect() if r.reasons} == {0: "registry_release_history_empty", 1: "registry_requested_version_absent", 7: "registry_release_history_empty", 8: "range_candidate_version_unparseable", 9: "registry_release_history_empty", 10: "author_date_missing"}
    assert sorted(evidence.registry_status(q, rel, ["id"], reasons=False).collect()) == sorted(got.drop("reasons").collect())


def test_imports_meet_manifests_where_they_were_dealt(spark):
    """Joins and windows within a commit shuffle nothing but the two sides once, and an import's prefixes are made after that."""
    from commitlens.operators import linking

    events = spark.createDataFrame([(1, "i", "import", "m.go", "Go", 1, 0, "g.c/a/b", "g.c/a/b", "", "go_module_path_mapping"), (1, "m", "manifest_addition", "go.mod", "Go", 1, 0, "g.c/a", "g.c/a", "v1", "direct_manifest")], "pos long, event_id string, event_type string, path string, ecosystem string, line_no int, ordinal int, raw_target string, package_name string, version_spec string, status string").withColumn("reasons", F.array().cast("array<string>"))
    man = events.filter("event_id = 'm'").selectExpr("pos", "ecosystem", "package_name as declared", "event_id as manifest_id", "path as manifest", "false as aliased").repartition(5, "pos")
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    with scratch.co_located(spark):
        met = linking._meetings(linking._imports(events, "pos").repartition(5, "pos"), man, "pos").hint("merge")
        assert len(re.findall(r"Exchange hashpartitioning", physical(met))) == 2
        assert [(r.import_id, r.manifest_id, r.alignment) for r in met.collect()] == [("i", "m", "matched_manifest")]
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before
