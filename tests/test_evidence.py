"""Stated cases of adjudication, linking, sources and streams."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from commitlens.functions import versions
from commitlens.operators import adjudication, attribution, evidence, grammars, imports, linking, quality, windows
from commitlens.sources import tables
from commitlens.streaming import jobs


def test_labels(spark):
    base = "case string, repo string, ecosystem string, package_name string, query_kind string, query_value string, registry_status string"
    late, none, absent = "published_after_author_date", "no_matching_version_before_author_date", "current_absent_unknown"
    cases = [
        ("parent_preexisting", "o/r", "npm", "p", "exact", "1.0.0", late), ("future_gt_24h", "o/r", "npm", "p", "exact", "1.0.0", late), ("future_le_24h", "o/r", "npm", "p", "exact", "1.0.0", late), ("coordinated_release", "o/r", "npm", "p", "exact", "1.0.0", late),
        ("current_version_absent", "o/r", "npm", "p", "exact", "9.9.9", absent), ("repeated_current_absence", "o/r", "PyPI", "p", "name_only", "", absent), ("cargo_no_matching_version", "o/r", "Cargo", "p", "range", "99", none),
        ("go_local_workspace", "o/r", "Go", "example.com/x", "name_only", "", absent), ("maven_vendor_match", "o/r", "Maven", "g:a", "exact", "1", absent),
    ]
    df = spark.createDataFrame(cases, base).withColumn("episode_id", F.col("case"))
    one = lambda schema, *rows: spark.createDataFrame(rows, "episode_id string, " + schema)
    q = "parent_state string, flags array<string>, strong_review_candidate boolean"
    inputs = {
        "queue": one(q, ("parent_preexisting", "package_and_query_preexisting", [], True), ("future_gt_24h", "a", [], True), ("future_le_24h", "a", [], True), ("coordinated_release", "a", ["owned_package_release_workflow_possible"], True), ("cargo_no_matching_version", "a", [], True)),
        "fresh": one("decision string, seconds long", ("future_gt_24h", "fresh_matching_published_after_committer", 86401), ("future_le_24h", "fresh_matching_published_after_committer", None), ("cargo_no_matching_version", "fresh_no_matching_version", None)),
        "current": one("decision string, nonpublic_hint boolean", ("current_version_absent", "fresh_package_exists_query_absent_now", False), ("repeated_current_absence", "fresh_package_absent_now", False)),
        "context": one("hints array<string>", ("go_local_workspace", ["explicit_workspace_or_local_context"]), ("maven_vendor_match", ["resolved_version_present"])),
    }
    got = {r.case: (r.final_label.split("_")[0], r.confidence, list(r.evidence_flags)) for r in adjudication.adjudicate(adjudication.star(df, inputs)).collect()}
    assert got == {
        "parent_preexisting": ("not", "high", ["parent_preexisting"]), "future_gt_24h": ("confirmed", "high", ["fresh_postdate_gt_24h"]), "future_le_24h": ("probable", "medium", ["fresh_postdate_le_24h"]),
        "coordinated_release": ("not", "high", ["owned_package_release_workflow_possible"]), "current_version_absent": ("probable", "medium", ["current_version_absent"]), "repeated_current_absence": ("indeterminate", "low", []),
        "cargo_no_matching_version": ("confirmed", "high", ["fresh_no_matching_version"]), "go_local_workspace": ("not", "high", ["explicit_workspace_or_local_context"]), "maven_vendor_match": ("not", "high", ["resolved_version_present"]),
    }


def test_owned(spark):
    rows = [
        ("Acme/tool", "npm", "@acme/x", True), ("acme/tool", "npm", "tool", True), ("acme/tool", "npm", "@other/tool", False), ("acme/my-tool", "PyPI", "my_tool", True), ("acme/tool", "Go", "https://github.com/acme/tool/v2", True),
        ("acme/tool", "Go", "github.com/other/tool", False), ("acme/tool", "Maven", "org.acme:x", True), ("big-data/fast-core", "Maven", "com.data.big:x", True), ("x/fast-json-core", "Maven", "org.y:fast-core", True), ("q-z/tool", "Maven", "org.y:tool", False),
    ]
    df = spark.createDataFrame(rows, "repo string, eco string, package string, want boolean")
    wrong = [r for r in df.withColumn("got", adjudication.is_owned(F.col("repo"), F.col("eco"), F.col("package"))).collect() if r.got != r.want]
    assert not wrong


def test_patch_flags_and_comments(spark):
    lines = spark.createDataFrame([
        ("s", "a/Cargo.toml", 1, True, 'my_crate = { path = "../x" }'), ("s", "package.json", 1, False, '  "name": "left-pad",'), ("s", "package.json", 2, True, '  "axios": "workspace:*",'), ("s", "yarn.lock", 1, True, "axios sha512-abc"),
        ("s", "pyproject.toml", 5, True, '# "gone>=1"'), ("s", "pyproject.toml", 6, True, '"here>=1"'),
    ], "sha string, path string, line_no int, added boolean, text string")
    cases = spark.createDataFrame([("c", "s", "Cargo", "my-crate", None), ("n", "s", "npm", "axios", None), ("d", "s", "npm", "left-pad", None), ("z", "s", "Go", "nothing", "")], "episode_id string, sha string, ecosystem string, package_name string, effective_name string")
    got = {r.episode_id: list(r.patch_flags) for r in adjudication.patch_flags(cases, lines).collect()}
    assert got == {"c": ["cargo_nonpublic_spec"], "n": ["lock_integrity", "workspace_or_nonregistry_spec"], "d": ["package_defined_in_patch"], "z": []}
    labels = spark.createDataFrame([(e, "probable_hallucination", "medium") for e in ("x", "y", "w")], "episode_id string, final_label string, confidence string")
    ev = spark.createDataFrame([("x", "s", "manifest_addition", "pyproject.toml", 5), ("y", "s", "manifest_addition", "pyproject.toml", 5), ("y", "s", "manifest_addition", "pyproject.toml", 6), ("w", "s", "import", "a.py", 5)], "episode_id string, sha string, event_type string, path string, line_no int")
    assert {r.episode_id: r.corrected for r in adjudication.comment_guard(labels, ev, lines).collect()} == {"x": True, "y": False, "w": False}
    assert [tuple(r) for r in adjudication.comment_audit(labels, ev, lines).collect()] == [("x", "probable_hallucination", "not_hallucination", [lines.filter("path = 'pyproject.toml' and line_no = 5").first().text])]
    full = labels.withColumns({"adjudication_basis": F.lit("b"), "evidence_flags": F.when(F.col("episode_id") == "y", F.array(F.lit("zz")))})
    got = {r.episode_id: (r.final_label, r.confidence, r.adjudication_basis, r.evidence_flags) for r in adjudication.comment_guard(full, ev, lines).collect()}
    assert got == {"x": ("not_hallucination", "high", adjudication.COMMENT_BASIS, [adjudication.COMMENT_FLAG]), "y": ("probable_hallucination", "medium", "b", ["zz"]), "w": ("probable_hallucination", "medium", "b", None)}
    assert adjudication.comment_audit(labels, ev, lines.limit(0)).count() == 0  # an event without its line is no comment


def test_requirements(spark):
    texts = {
        "requests[security]>=2 ; python_version < '3'  # why": ("requests", ">=2"), "numpy": ("numpy", ""), "a @ git+https://x": ("a", "@ git+https://x"), "# no": None, "-r base.txt": None, "": None, "two words": None, "x ; extra == 'y'": ("x", ""),
        "pkg;sys_platform=='win32'": ("pkg", ""), "pkg ; weird": ("pkg", "; weird"),
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("r", grammars.requirement(F.col("t")))
    assert {r.t: (tuple(r.r) if r.r else None) for r in df.collect()} == texts


def test_import_packages(spark):
    rows = [
        ("TypeScript", "./x", None), ("TypeScript", "node:fs", None), ("JavaScript", "fs/promises", None), ("JavaScript", "@repo/x", ""), ("JavaScript", "@a/b/c", "@a/b"), ("JavaScript", "lodash/get", "lodash"), ("Python", "os.path", None), ("Python", "_x", None), ("Python", "cv2", "opencv-python"),
        ("Python", "my_Pkg.sub", "my-pkg"), ("Rust", "crate::a", None), ("Rust", "my_crate::a", "my-crate"), ("Go", "net/http", None), ("Go", "local/x", None), ("Go", "github.com/a/b", "github.com/a/b"), ("Java", "java.util.List", None), ("Java", "org.x.Y", ""), ("Go", "", None),
    ]
    df = spark.createDataFrame(rows, "language string, raw_target string, want string")
    wrong = [r for r in df.withColumn("got", imports.import_package(F.col("language"), F.col("raw_target"))["package"]).collect() if r.got != r.want]
    assert not wrong


def test_alias_and_depth(spark):
    df = spark.createDataFrame([("npm:left-pad@1.0.0",), ("npm:@a/b@^2",), ("npm:@a/b",), ("npm:1.2.3",), ("^1",), (None,)], "s string")
    got = [tuple(r[0]) if r[0] else None for r in df.select(linking.npm_alias(F.col("s"))).collect()]
    assert got == [("left-pad", "1.0.0"), ("@a/b", "^2"), None, None, None, None]
    rows = [("a/b/x.ts", "package.json", 0), ("a/b/x.ts", "a/package.json", 1), ("a/b/x.ts", "a/b/package.json", 2), ("a/b/x.ts", "a/bc/package.json", -1), ("ab/x.ts", "a/package.json", -1), ("x.ts", "a/package.json", -1)]
    df = spark.createDataFrame(rows, "s string, m string, want int")
    assert all(r.got == r.want for r in df.withColumn("got", linking.depth(F.col("s"), F.col("m"))).collect())


def test_registry_payloads(spark):
    rows = [
        ("npm", "a", {"time": {"created": "2020-01-01T00:00:00Z", "1.0.0": "2020-01-02T00:00:00Z"}}), ("npm", "b", {"versions": {"2.0.0": {"name": "b"}}}), ("PyPI", "c", {"releases": {"1": [{"upload_time": "2020-01-05T00:00:00"}, {"upload_time": "2020-01-04T00:00:00"}], "2": []}}),
        ("Cargo", "d", {"versions": [{"num": "0.1.0", "created_at": "2020-01-06T00:00:00Z"}]}), ("Maven", "e:f", {"response": {"docs": [{"v": "3", "timestamp": 1577836800000}]}}), ("Go", "g", {"Version": "v1.0.0", "Time": "2020-01-07T00:00:00Z"}),
    ]
    df = spark.createDataFrame([(e, p, json.dumps(j)) for e, p, j in rows] + [("npm", "bad", "{"), ("Go", "none", None)], "ecosystem string, package_name string, payload string")
    got = {(r.package_name, r.version): r.published_at and r.published_at.strftime("%m-%d") for r in tables.flatten_registry(df).collect()}
    assert got == {("a", "1.0.0"): "01-02", ("b", "2.0.0"): None, ("c", "1"): "01-04", ("c", "2"): None, ("d", "0.1.0"): "01-06", ("e:f", "3"): "01-01", ("g", "v1.0.0"): "01-07"}


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text('﻿a,b\n1,"x\ny"\n2,"say ""hi"""\n')
    df = tables.read_table(spark, str(tmp_path / "t.csv"), "a int, b string")
    assert sorted(map(tuple, df.collect())) == [(1, "x\ny"), (2, 'say "hi"')]
    with pytest.raises(Exception):
        tables.read_table(spark, str(tmp_path / "t.csv"), "a int, c string").collect()
    tables.write_table(df, str(tmp_path / "out"), ["a"])
    with pytest.raises(Exception):
        tables.write_table(df, str(tmp_path / "out"), ["a"])
    with pytest.raises(ValueError):
        tables.write_table(df.unionByName(df), str(tmp_path / "out2"), ["a"])
    assert not (tmp_path / "out2").exists()
    (tmp_path / "e.jsonl").write_text('{"evidence_type":"registry","source":"npm","ecosystem":"npm","package_name":"a","lookup_status":"ok","queried_at":"2020-01-01T00:00:00Z"}\nnot json\n{"evidence_type":"other"}\n{"evidence_type":"advisory","source":"s"}\n')
    good, bad = tables.read_evidence(spark, str(tmp_path / "e.jsonl"))
    assert [r.package_name for r in good.collect()] == ["a"]
    assert sorted(r.reject_reason for r in bad.collect()) == ["missing_ecosystem", "not_an_object", "unknown_type"]


def test_checkpoint_guard(spark, tmp_path):
    """Added files are taken without reading the old ones; changed or missing files and other settings are refused."""
    folder, record = tmp_path / "in put", str(tmp_path / "record")
    put = lambda name, *xs: spark.createDataFrame([(x,) for x in xs], "x int").coalesce(1).write.mode("overwrite").parquet(str(folder / name))
    guard = lambda v="v": jobs.checkpoint_guard(spark, str(folder), "x int", {"k": v}, record)
    put("a", 1, 2)
    assert (guard(), guard()) == (1, 0)
    put("b", 3)
    assert (guard(), guard()) == (1, 0)
    with pytest.raises(ValueError, match="settings"):
        guard("w")
    file = next((folder / "a").glob("*.parquet"))
    file.touch()
    assert (guard(), guard()) == (1, 0)  # another time, the same rows
    other = next((folder / "b").glob("*.parquet")).read_bytes()
    kept = file.read_bytes()
    for crc in (folder / "a").glob(".*.crc"):
        crc.unlink()
    file.write_bytes(other)
    with pytest.raises(ValueError, match="inputs differ"):
        guard()
    file.write_bytes(kept)
    assert guard() == 1
    file.unlink()
    with pytest.raises(ValueError, match="gone"):
        guard()


def test_fingerprints_add_up(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 as m", "if(id % 3 = 0, null, id) as n").repartition(5).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    parts = quality.file_fingerprints(t)
    assert parts.count() == 5 and quality.merged(parts).first() == quality.fingerprint(t).first()
    m = quality.manifest(t, "t", ["id"]).first()
    assert (m.columns, m.key, m.n_rows) == ("id:bigint|m:bigint|n:bigint", "id", 1000)


def test_write_table_checks_while_it_writes(spark, tmp_path):
    good = spark.range(100).selectExpr("id", "string(id % 3) as s")
    tables.write_table(good, str(tmp_path / "t"), ["id"])
    assert spark.read.parquet(str(tmp_path / "t")).exceptAll(good).isEmpty()
    for df, why in ((good.unionByName(good.limit(1)), "duplicate_key': 1"), (good.withColumn("id", F.expr("nullif(id, 7)")), "empty_key': 1"), (good.withColumn("id", F.lit("")), "duplicate_key': 99")):
        with pytest.raises(ValueError, match=why):
            tables.write_table(df, str(tmp_path / "u"), ["id"])
    with pytest.raises(ValueError, match="exists"):
        tables.write_table(good.limit(1), str(tmp_path / "t"), ["id"])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"] and spark.read.parquet(str(tmp_path / "t")).count() == 100


def test_star_is_one_shuffle(spark):
    c = spark.range(5).selectExpr("id as episode_id", "'x' as name")
    one = spark.createDataFrame([(1, 2, "old"), (1, 5, "new"), (3, 1, None), (9, 1, "none")], "episode_id long, seq int, v string")
    two = spark.createDataFrame([(1, 1, ["a"]), (1, 1, ["b"]), (2, 1, [])], "episode_id long, seq int, w array<string>")
    out = adjudication.star(c, {"one": one, "two": two}, seq="seq")
    got = {r.episode_id: (r.one and r.one.v, r.two and r.two.w) for r in out.collect()}
    assert got == {0: (None, None), 1: ("new", ["b"]), 2: (None, []), 3: (None, None), 4: (None, None)}
    assert [r.one is None for r in out.orderBy("episode_id").collect()] == [True, False, True, False, True]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = adjudication.star(c, {"one": one, "two": two}, seq="seq")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(episode_id") == 2  # the candidates' and the inputs'


def test_windows_over_midnight_and_without_a_cap(spark):
    ts = lambda *rows: spark.createDataFrame([(t,) for t in rows], "t string").selectExpr("cast(t as timestamp_ntz) as author_date")
    w = spark.sql("select date'2020-01-01' as day, timestamp_ntz'2020-01-01 23:00:00' as window_start, timestamp_ntz'2020-01-02 01:00:00' as window_end")
    got = windows.in_windows(ts("2020-01-01 22:59:59", "2020-01-01 23:00:00", "2020-01-02 00:30:00", "2020-01-02 01:00:00"), w).collect()
    assert sorted(str(r.author_date) for r in got) == ["2020-01-01 23:00:00", "2020-01-02 00:30:00"] and {str(r.day) for r in got} == {"2020-01-01"}
    many = spark.range(64).selectExpr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(id as int)) as author_date")
    long = spark.sql("select timestamp_ntz'2020-01-01 00:00:00' as window_start, timestamp_ntz'2021-01-01 00:00:00' as window_end")
    done = windows.bisect_windows(many, long, cap=40, least_seconds=1).filter("status <> 'split_probe'")
    assert done.agg(F.sum("n")).first()[0] == 64 and done.agg(F.max("n")).first()[0] <= 40
    odd = windows.sample_windows(spark, "2020-01-01", "2020-06-01", 1000, 1).selectExpr("max(window_end > timestampadd(DAY, 1, cast(day as timestamp_ntz))) as over", "count(distinct date_format(window_start, 'HH:mm')) as n").first()
    assert not odd.over and odd.n == 2


def test_patches_by_path(spark, tmp_path):
    for p in ("a/1.patch", "b/1.patch", "b/c d/1.patch"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    index = spark.createDataFrame([("x", "a/1.patch"), ("y", "b/1.patch"), ("z", "./b/c d/1.patch"), ("n", "c/1.patch")], "sha string, patch_path string")
    assert sorted((r.sha, r.patch) for r in tables.read_patches(spark, index, str(tmp_path)).collect()) == [("x", "a/1.patch"), ("y", "b/1.patch"), ("z", "b/c d/1.patch")]


def test_query_kinds_of_pypi(spark):
    cases = {"==1.2; python_version<'3'": ("exact", "1.2"), "==1.*": ("exact", "1.*"), ">=1; extra == 'x'": ("range", ">=1"), "'===2.0'": ("exact", "2.0"), "; python_version > '3'": ("name_only", ""), "==1,<2": ("range", "==1,<2")}
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    kind = versions.query_kind(F.lit("PyPI"), F.col("s"))
    assert {r.s: (r.k, r.v) for r in df.select("s", kind.alias("k"), versions.query_value(F.lit("PyPI"), F.col("s"), kind).alias("v")).collect()} == cases


def test_registry_lookups_and_reasons(spark):
    at = "timestamp_ntz'2020-01-01 00:00:00'"
    q = spark.createDataFrame([(i, p, k, v) for i, (p, k, v) in enumerate([("ok", "exact", "1.0.0"), ("ok", "exact", "9.9.9"), ("ok", "range", "^1.0.0"), ("ok", "range", "^7.0.0"), ("gone", "exact", "1.0.0"), ("broken", "name_only", ""), ("never", "exact", "1.0.0"), ("ok", "range", "next"), ("late", "name_only", "")])], "id int, package_name string, query_kind string, query_value string").selectExpr("*", f"{at} as author_date")
    rel = spark.sql("select * from values ('ok', '1.0.0', timestamp_ntz'2019-01-01 00:00:00'), ('ok', '1.2.0', timestamp_ntz'2021-01-01 00:00:00'), ('late', '1.0.0', timestamp_ntz'2021-01-01 00:00:00') as t(package_name, version, published_at)")
    lookups = spark.createDataFrame([("ok", "ok"), ("late", "ok"), ("gone", "not_found"), ("broken", "error")], "package_name string, lookup_status string")
    got = {r.id: (r.registry_status, list(r.reasons)) for r in evidence.registry_status(q, rel, ["id"], lookups=lookups).collect()}
    lost = "unknown_deleted_or_unpublished_possible"
    assert got == {
        0: ("exists_before_author_date", []), 1: ("current_absent_unknown", [lost, "registry_requested_version_absent"]), 2: ("exists_before_author_date", []), 3: ("no_matching_version_before_author_date", ["history_validation_required"]),
        4: ("current_absent_unknown", [lost, "registry_package_not_found_at_query"]), 5: ("cannot_compare", ["registry_error"]), 6: ("cannot_compare", ["registry_lookup_failed"]), 7: ("cannot_compare", ["unsupported_range_syntax"]), 8: ("published_after_author_date", ["history_validation_required"]),
    }


def test_episodes_with_contexts(spark):
    cols = "sha string, event_id string, event_type string, path string, ecosystem string, line_no int, ordinal int, raw_target string, package_name string, version_spec string, status string"
    i, m = "import", "manifest_addition"
    events = spark.createDataFrame([
        ("s", "i1", i, "src/a.ts", "npm", 1, 0, "left", "left", "", "direct_mapping"), ("s", "i2", i, "src/a.ts", "npm", 2, 0, "right", "right", "", "direct_mapping"), ("s", "i3", i, "src/a.ts", "npm", 3, 0, "ours", "ours", "", "direct_mapping"),
        ("s", "i4", i, "src/a.ts", "npm", 4, 0, "bare", "bare", "", "direct_mapping"), ("s", "m1", m, "package.json", "npm", 1, 0, "left", "left", "^1.0.0", "direct_manifest"), ("s", "m2", m, "package.json", "npm", 2, 0, "idle", "idle", "^2.0.0", "direct_manifest"),
    ], cols).withColumn("reasons", F.array().cast("array<string>"))
    known = spark.createDataFrame([
        ("s", "src/a.ts", "left", "npm", "left", "1.4.0", "lockfile", "matched_manifest_and_lock"), ("s", "src/a.ts", "right", "npm", "right", "3.0.0", "lockfile", "matched_existing_manifest"), ("s", "src/a.ts", "ours", "npm", "ours", "", "", "first_party_excluded"), ("s", "package.json", "idle", "npm", "idle", "2.5.0", "lockfile", "matched_manifest"),
    ], "sha string, source_path string, raw_target string, ecosystem string, package_name string, resolved_version string, resolution_source string, alignment_status string")
    known = known.withColumns({"import_root": F.col("raw_target"), "version_spec": F.lit(""), "dependency_group": F.lit(""), "dependency_path": F.lit(""), "repo": F.lit("r"), "reason_codes": F.array().cast("array<string>")})
    episodes, links = linking.build_episodes(events, "sha", known)
    assert {(r.identity, r.query_kind, r.query_value, r.alignment_status, r.dependency_quadrant) for r in episodes.collect()} == {
        ("left", "exact", "1.4.0", "matched_manifest_and_lock", "I+M+"), ("right", "exact", "3.0.0", "matched_existing_manifest", "I+M-"), ("ours", "excluded", "", "first_party_excluded", "I+M-"), ("bare", "name_only", "", "no_matching_manifest", "I+M-"), ("idle", "exact", "2.5.0", "not_applicable_manifest_only", "I-M+"),
    }
    assert {(r.event_id, r.link_method) for r in links.collect()} == {("i1", "identity_match"), ("m1", "identity_match"), ("i2", "context_match"), ("i3", "context_match"), ("i4", "import_only"), ("m2", "manifest_only")}


def bisected_by_hand(times, start, end, cap, least):
    out, todo = [], [(start, end, 0)]
    while todo:
        s, e, depth = todo.pop()
        n, seconds = sum(s <= t < e for t in times), int((e - s).total_seconds())
        status = "ok" if n <= cap else "split_probe" if seconds > least else "cap_bound_terminal"
        out.append((s, e, n, depth, status))
        if status == "split_probe":
            m = s + datetime.timedelta(seconds=seconds // 2)
            todo += [(s, m, depth + 1), (m, e, depth + 1)]
    return sorted(out)


@pytest.mark.parametrize(("cap", "least"), [(0, 1), (2, 7), (5, 1), (300, 1)])
def test_bisected_windows(spark, cap, least):
    """Windows of odd lengths, off the second, over midnight, empty and overlapping, against splitting one by one."""
    r = random.Random(cap)
    base = datetime.datetime(2020, 2, 28, 22, 0, 0)
    times = [base + datetime.timedelta(seconds=r.choice([r.randint(0, 9000), 4000]), microseconds=r.choice([0, 5])) for _ in range(200)]
    spans = [(base, base + datetime.timedelta(seconds=7201)), (base + datetime.timedelta(seconds=100, microseconds=3), base + datetime.timedelta(seconds=8000, microseconds=3)), (base - datetime.timedelta(days=3), base - datetime.timedelta(days=2)), (base, base)]
    c = spark.createDataFrame([(t,) for t in times], "author_date timestamp_ntz")
    w = spark.createDataFrame([*spans, spans[0]], "window_start timestamp_ntz, window_end timestamp_ntz")
    got = windows.bisect_windows(c, w, cap, least).collect()
    assert sorted(map(tuple, got)) == sorted(x for s, e in spans if e > s for x in bisected_by_hand(times, s, e, cap, least))


@pytest.mark.parametrize("most", [0, 500_000])
def test_text_rules(spark, most):
    """Many rules, short, empty, overlapping and of common pieces, sent to all tasks or shuffled."""
    r = random.Random(most)
    word = lambda k: "".join(r.choice("abc é") for _ in range(k))
    messages = [None, "", "ABCABC", *[word(r.randint(0, 60)) + r.choice(["", "Agent-7", "AGENT"]) for _ in range(150)], "abc " * 5000]
    values = ["agent-7", "agent", "a", "é", "ab", "abc", "", "cab cab", None, *[word(r.randint(1, 9)) for _ in range(150)]]
    commits = spark.createDataFrame(list(enumerate(messages)), "seq int, message string").repartition(3)
    rules = spark.createDataFrame([(f"a{i}", "c", "m", v) for i, v in enumerate(values)], "agent string, channel string, mode string, value string")
    got = attribution.text_hits(commits, rules, most).collect()
    want = sorted((i, f"a{k}") for i, m in enumerate(messages) for k, v in enumerate(values) if v is not None and ((m is not None and v in m.lower()) or v == ""))
    assert sorted((x.seq, x.agent) for x in got) == want
    assert attribution.text_hits(commits, rules.limit(0), most).count() == 0


def test_episodes_come_of_their_drafts_alone(spark):
    """What an episode and a link say is summed up from the drafts: no join back to the events."""
    from commitlens.operators import diff, imports, linking

    patch = "diff --git a/Cargo.toml b/Cargo.toml\n+++ b/Cargo.toml\n@@ -0,0 +1,2 @@\n+[dependencies]\n+serde = \"1.0\"\ndiff --git a/a.rs b/a.rs\n+++ b/a.rs\n@@ -0,0 +1,2 @@\n+use serde::X;\n+use rand::Y;"
    events = imports.extract_events(diff.patch_lines(spark.createDataFrame([("s", patch)], "sha string, patch string")), "sha", ("Rust",))
    episodes, links = linking.build_episodes(events)
    assert all("Join" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (episodes, links))
    assert sorted((x.identity, x.dependency_quadrant) for x in episodes.collect()) == [("rand", "I+M-"), ("serde", "I+M+")]
    assert sorted((x.event_type, x.link_method) for x in links.collect()) == [("import", "identity_match"), ("import", "import_only"), ("manifest_addition", "identity_match")]
