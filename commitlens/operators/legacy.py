"""The earlier label chain over wide match rows: predicates, queries, lookups, labels, and versions managed by a BOM.

match rows: repo, sha, ecosystem, declared_package, package_candidate, declared_dependency_match, mapping_status,
version_spec, version_kind, resolved_version, resolution_source, dependency_group, namespace_hint,
dependency_file_changed_in_diff, author_date. A null text counts as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.plans.scratch import is_small, materialize, small

#: Registries that the labels know.
REGISTRIES = ("npm", "PyPI", "Cargo", "Go", "Maven", "NuGet", "Packagist")
#: Prefixes of specs that this chain takes for private or local.
PRIVATE = ("file:", "workspace:", "path:", "git:", "http:", "https:", "../", "./", "/")


def _t(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def exact_version(spec: Column, kind: Column) -> Column:
    """The version that a spec names: without quotes and one equality sign, if it is resolved or looks like one; else ''."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(spec, F.lit(""))), "^\"+|\"+$", ""), "^'+|'+$", "")
    value = F.trim(F.regexp_replace(bare, "^={1,3}", ""))
    return F.when((kind == "resolved") | value.rlike(r"^v?\d+(\.\d+)*([-+][A-Za-z0-9_.-]+)?$"), value).otherwise("")


def with_query(rows: DataFrame) -> DataFrame:
    """Adds query_package (an alias asks for its target) and query_version (resolved first; a range asks for none)."""
    alias = (_t("ecosystem") == "npm") & F.contains(_t("dependency_group"), F.lit("npm.alias")) & (_t("namespace_hint") != "")
    package = F.when(alias, _t("namespace_hint")).when(_t("declared_package") != "", _t("declared_package")).otherwise(_t("package_candidate"))
    resolved = exact_version(F.col("resolved_version"), F.lit("resolved"))
    version = F.when(resolved != "", resolved).when(_t("version_kind") == "range", "").otherwise(exact_version(F.col("version_spec"), _t("version_kind")))
    return rows.withColumns({"query_package": package, "query_version": version})


def legacy_flags(rows: DataFrame) -> DataFrame:
    """Adds the predicates of the label chain as boolean columns (rows with query_package and query_version)."""
    group, low, match = _t("dependency_group"), F.lower(F.trim(_t("version_spec"))), _t("declared_dependency_match")
    has = lambda c, t: F.contains(c, F.lit(t))
    local = reduce(lambda a, b: a | b, [has(low, t) for t in ("workspace", "path =", "git =", " git+")] + [low.startswith(p) for p in (*PRIVATE, "git+")])
    observed, first = match.startswith("observed_in"), match == "first_party_module_import"
    nothing = (_t("declared_package") == "") & (_t("package_candidate") == "")
    go, version = _t("query_package"), F.lower(F.trim(_t("query_version")))
    return rows.withColumns({
        "is_private": (_t("version_kind") == "non_registry") | local,
        "is_first_party": (_t("resolution_source") == "first_party_module") | first,
        "is_catalog_possible": group.startswith("gradle.version_catalog:"),
        "is_bom_managed": (_t("version_kind") == "bom_managed") | has(group, "bom_managed_by:"),
        "is_snapshot": (_t("ecosystem") == "Maven") & F.upper(_t("query_version")).endswith("-SNAPSHOT"),
        "is_custom_registry": (_t("ecosystem") == "npm") & has(group, "npm.custom_registry:"),
        "is_alias": (_t("ecosystem") == "npm") & has(group, "npm.alias") & (_t("namespace_hint") != ""),
        "not_introduced": observed & (F.lower(F.trim(_t("dependency_file_changed_in_diff"))) == "false"),
        "is_uncertain": ~observed & ~first & (nothing | (match == "mapping_unknown") | has(_t("mapping_status"), "unknown")),
        "valid_go_module": has(go, "/") & ~go.rlike(r"[\s${}()\[\]<>'\"]") & has(F.split(go, "/")[0], "."),
        "packagist_non_exact": version.startswith("dev-") | version.endswith("-dev") | has(version, "x-dev"),
    })


def partial_matches(version: Column, versions: Column, most: int = 8) -> Column:
    """The first `most` of the versions (array) under a version of two numbers, sorted; empty for any other."""
    return F.when(version.rlike(r"^\d+\.\d+$"), F.slice(F.array_sort(F.filter(versions, lambda v: v.startswith(F.concat(version, F.lit("."))))), 1, most)).otherwise(F.array().cast("array<string>"))


def legacy_queries(rows: DataFrame, order: str = "pos") -> DataFrame:
    """ecosystem, package_key, query_version and the first row of each, of the rows that a registry can be asked about."""
    f = legacy_flags(with_query(rows)).filter("not (is_uncertain or is_private or is_first_party or is_catalog_possible or is_snapshot or is_custom_registry) and query_version <> ''")
    f = f.withColumn("package_key", F.lower("query_package"))
    return f.groupBy("ecosystem", "package_key", "query_version").agg(F.min_by(F.struct(order, "query_package"), order).alias("x")).select("ecosystem", "package_key", "query_version", "x.*")


def failure_bucket(status: Column) -> Column:
    """What an answer's status (a text) means."""
    s = F.coalesce(status.cast("string"), F.lit("None"))
    return (
        F.when(s == "200", "ok").when(s.isin("unsupported_ecosystem", "no_package", "malformed_package_name"), s).when(s.isin("", "0", "None"), "network_or_decode_error").when(s == "400", "bad_request_or_malformed_version")
        .when(s.isin("401", "403"), "auth_or_forbidden").when(s == "404", "not_found_current_registry").when(s == "429", "rate_limited").when(s.isin("408", "409", "425"), "temporary_registry_error").when(s.startswith("5"), "registry_server_error")
        .otherwise(F.concat(F.lit("http_"), s))
    )


def failure_detail(status: Column, error: Column) -> Column:
    """The same with what the error's text tells."""
    bucket, low = failure_bucket(status), F.lower(F.coalesce(error, F.lit("")))
    return (
        F.when(bucket == "ok", "ok").when(low.rlike("timed out|timeout"), "timeout").when(low.rlike("name or service not known|getaddrinfo|dns"), "dns_or_resolution_error").when(low.rlike("json|decode"), "decode_error")
        .when(low.rlike("connection reset|remote end closed"), "connection_closed").when(bucket == "not_found_current_registry", "http_404_not_found").otherwise(bucket)
    )


def append_note(notes: Column, note: Column) -> Column:
    """notes (joined by ;) with one more, once; a null note adds none."""
    parts = F.filter(F.split(F.coalesce(notes, F.lit("")), ";"), lambda x: x != "")
    return F.array_join(F.when(note.isNull() | F.array_contains(parts, note), parts).otherwise(F.concat(parts, F.array(note))), ";")


def merge_second_source(first: DataFrame, second: DataFrame, key: list[str], source: str = "depsdev") -> DataFrame:
    """first (key, version, package_exists, version_exists, publish_time, note, bucket, detail) with what a second source
    (key, package_exists, version_exists, publish_time) corrects: false becomes true, a missing time is filled."""
    j = first.join(second.select(*key, *[F.col(c).alias(f"two_{c}") for c in ("package_exists", "version_exists", "publish_time")]), key, "left")
    fix = lambda c: F.coalesce(F.col(f"two_{c}") & ~F.col(c), F.lit(False))
    package, version = fix("package_exists"), fix("version_exists")
    filled = F.col("two_publish_time").isNotNull() & F.col("publish_time").isNull()
    note = F.col("note")
    for when, text in ((package, f"{source}_corrected_package_exists"), (version, f"{source}_corrected_version_exists"), (filled, f"{source}_filled_publish_time")):
        note = append_note(note, F.when(when, text))
    there = F.coalesce(F.col("version_exists"), F.lit(False)) | version
    known = F.col("two_package_exists").isNotNull() | F.col("two_version_exists").isNotNull() | F.col("two_publish_time").isNotNull()
    ok = known & (there | ((F.coalesce(F.col("package_exists"), F.lit(False)) | package) & (F.coalesce("version", F.lit("")) == "")))
    return j.select(*key, "version", F.when(package, True).otherwise(F.col("package_exists")).alias("package_exists"), F.when(version, True).otherwise(F.col("version_exists")).alias("version_exists"), F.coalesce("publish_time", "two_publish_time").alias("publish_time"), note.alias("note"), F.when(ok, "ok").otherwise(F.col("bucket")).alias("bucket"), F.when(ok, "ok").otherwise(F.col("detail")).alias("detail"))


def summarize_advisories(advisories: DataFrame, key: list[str]) -> DataFrame:
    """advisory_count, advisory_ids and malicious_ids (sorted, joined by ;) and the earliest time, from advisories (key,
    id, published, body); one that starts with MAL- or whose body says malicious is malicious."""
    bad = F.col("id").startswith("MAL-") | F.contains(F.lower(F.coalesce("body", F.lit(""))), F.lit("malicious"))
    ids = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";")
    return advisories.groupBy(*key).agg(F.count("*").alias("advisory_count"), ids(F.nullif("id", F.lit(""))).alias("advisory_ids"), ids(F.when(bad, F.nullif("id", F.lit("")))).alias("malicious_ids"), F.min("published").alias("earliest_advisory"))


def legacy_final(rows: DataFrame, registry: DataFrame, advisories: DataFrame) -> DataFrame:
    """Match rows with registry_ and advisory_ columns and their label, reason and strength. registry (ecosystem, package,
    version, status, bucket, detail, note, package_exists, version_exists, publish_time) is asked by the package in
    lower case, then as it is; advisories (ecosystem, package, version, and summarize_advisories' columns) as it is."""
    f = legacy_flags(with_query(rows))
    reg = registry.select("ecosystem", F.col("package"), F.col("version").alias("query_version"), F.struct(*[c for c in registry.columns if c not in ("ecosystem", "package", "version")]).alias("r"))
    adv = advisories.select("ecosystem", F.col("package").alias("query_package"), F.col("version").alias("query_version"), F.struct("advisory_count", "malicious_ids", "earliest_advisory").alias("a"))
    low = reg.select("ecosystem", F.col("package").alias("low"), "query_version", F.col("r").alias("r_low"))
    exact = reg.select("ecosystem", F.col("package").alias("query_package"), "query_version", F.col("r").alias("r_exact"))
    j = f.withColumn("low", F.lower("query_package")).join(low, ["ecosystem", "low", "query_version"], "left").join(exact, ["ecosystem", "query_package", "query_version"], "left").join(adv, ["ecosystem", "query_package", "query_version"], "left")
    j = j.withColumn("r", F.coalesce("r_low", "r_exact")).drop("low", "r_low", "r_exact")
    return j.withColumn("x", legacy_label()).select("*", "x.final_label", "x.label_reason", "x.evidence_strength").drop("x")


def legacy_label() -> Column:
    """struct(final_label, label_reason, evidence_strength): the first rule that fits."""
    bucket, detail, eco = F.coalesce("r.bucket", F.lit("")), F.coalesce("r.detail", F.lit("")), _t("ecosystem")
    missing, no_version = F.coalesce(~F.col("r.package_exists"), F.lit(False)), F.coalesce(~F.col("r.version_exists"), F.lit(False))
    at, published, warned = F.col("author_date"), F.col("r.publish_time"), F.col("a.earliest_advisory")
    status, match = F.coalesce(F.col("r.status").cast("string"), F.lit("")), _t("declared_dependency_match")
    no = "cannot_compare"
    more = F.when((detail != "") & (detail != bucket) & (detail != "ok"), F.concat(F.lit("_"), detail)).otherwise("")
    rules = [
        ((_t("query_package") == "") | F.col("is_uncertain"), no, "mapping_uncertain", "weak"),
        (~eco.isin(*REGISTRIES), no, "unsupported_ecosystem", "weak"),
        (F.col("is_first_party"), no, "first_party_module_import", "strong_exclusion"),
        (F.col("is_private"), no, "private_or_local_dependency", "strong_exclusion"),
        (F.col("is_catalog_possible"), no, "catalog_possible_dependency_not_build_usage", "weak"),
        ((eco == "Go") & (F.col("query_version") == "v0.0.0"), no, "go_placeholder_version", "strong_exclusion"),
        (F.col("is_snapshot"), no, "maven_snapshot_or_non_central_version", "weak"),
        (F.col("is_custom_registry"), no, "npm_custom_registry_not_queried", "weak"),
        (match.startswith("cannot_compare_no_parsed_dependencies"), no, "no_manifest_or_no_parsed_dependencies", "weak"),
        (status.isin("unsupported_ecosystem", "no_package", "malformed_package_name", "0"), no, F.concat(F.lit("registry_"), F.when(bucket == "", "lookup_failed").otherwise(bucket)), "weak"),
        (bucket.isin("bad_request_or_malformed_version", "auth_or_forbidden", "rate_limited", "temporary_registry_error", "registry_server_error", "network_or_decode_error"), no, F.concat(F.lit("registry_"), bucket, more), "weak"),
        (match == "not_observed_in_parsed_dependency_files", "not_observed_in_parsed_dependency_files", "manifest_does_not_explain_import", "medium"),
        ((F.col("query_version") == "") & F.col("is_bom_managed"), no, "bom_managed_version_not_resolved", "weak"),
        ((F.col("query_version") == "") & (_t("version_kind") == "range"), no, "no_exact_version_range", "weak"),
        ((F.col("query_version") == "") & (_t("version_kind") == "unresolved"), no, "no_declared_or_resolved_version", "weak"),
        (F.col("query_version") == "", no, "no_resolved_version", "weak"),
        (F.col("r.note") == "npm_partial_semver_prefix_matches_current_versions", no, "no_exact_version_range", "weak"),
        ((eco == "Packagist") & F.col("packagist_non_exact"), no, "no_exact_version_range", "weak"),
        ((eco == "Maven") & (missing | no_version), no, "maven_default_registry_missing_custom_repository_possible", "weak"),
        ((missing | no_version) & F.col("not_introduced"), no, "dependency_not_introduced_in_commit", "strong_exclusion"),
        (missing, "unknown_deleted_or_unpublished_possible", "current_registry_package_or_version_missing_no_history", "weak"),
        (no_version, "unknown_deleted_or_unpublished_possible", "current_registry_version_missing_no_history", "weak"),
        (published > at, "version_published_after_author_date_candidate", "publish_time_after_author_date_requires_history_validation", "candidate"),
        ((F.coalesce("a.malicious_ids", F.lit("")) != "") & (warned <= at), "known_malicious_package_before_author_date", "malicious_advisory_published_before_commit", "strong"),
        ((F.col("a.advisory_count") > 0) & (warned <= at), "known_public_advisory_before_author_date", "advisory_published_before_commit", "strong"),
        (published <= at, "version_exists_before_author_date", "publish_time_before_or_equal_commit_author_date", "strong"),
    ]
    row = lambda label, reason, strength: F.struct(F.lit(label).alias("final_label"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("label_reason"), F.lit(strength).alias("evidence_strength"))
    out = row(no, "publish_time_unknown", "weak")
    for when, *what in reversed(rules):
        out = F.when(F.coalesce(when, F.lit(False)), row(*what)).otherwise(out)
    return out


def bom_reference(group: Column) -> Column:
    """struct(alias, package, version) of the first bom_managed_by:alias:group:artifact:version in a group's tags; null
    where a part is missing."""
    tag = F.try_element_at(F.filter(F.split(F.coalesce(group, F.lit("")), ";"), lambda x: x.startswith("bom_managed_by:")), F.lit(1))
    parts = F.split(F.regexp_replace(tag, "^bom_managed_by:", ""), ":", 4)
    whole = (F.size(parts) == 4) & (parts[1] != "") & (parts[2] != "") & (parts[3] != "")
    return F.when(whole, F.struct(parts[0].alias("alias"), F.concat(parts[1], F.lit(":"), parts[2]).alias("package"), parts[3].alias("version")))


def resolve_bom(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """Match rows that a BOM manages take its version: adds bom_status (not_managed, not_applicable, target_not_listed,
    resolved); versions: bom, bom_version, target, resolved."""
    group = _t("dependency_group")
    managed = (_t("version_kind") == "bom_managed") | F.contains(group, F.lit("bom_managed_by:"))
    target = F.when(_t("declared_package") != "", _t("declared_package")).otherwise(_t("package_candidate"))
    j = rows.withColumn("b", F.when(managed & F.contains(target, F.lit(":")), bom_reference(group))).withColumns({"bom": F.col("b.package"), "bom_version": F.col("b.version"), "target": target, "managed": managed})
    known, at = materialize(versions, "boms"), ["bom", "bom_version", "target"]
    if is_small(known):
        j = j.join(F.broadcast(known), at, "left")
    else:  # rows without a reference would all be one task
        j = j.filter("b is not null").join(known, at, "left").unionByName(j.filter("b is null").withColumn("resolved", F.lit(None).cast("string")))
    hit = F.col("resolved").isNotNull()
    source = F.concat(F.lit("bom_resolved_from:"), "bom", F.lit(":"), "bom_version")
    status = F.when(~F.col("managed"), "not_managed").when(F.col("b").isNull(), "not_applicable").when(hit, "resolved").otherwise("target_not_listed")
    return j.withColumns({
        "bom_status": status, "version_spec": F.when(hit, F.col("resolved")).otherwise(F.col("version_spec")), "version_kind": F.when(hit, "exact").otherwise(F.col("version_kind")),
        "resolved_version": F.when(hit, F.col("resolved")).otherwise(F.col("resolved_version")), "resolution_source": F.when(hit, append_note(F.col("resolution_source"), F.lit("gradle_bom_dependency_management"))).otherwise(F.col("resolution_source")),
        "dependency_group": F.when(hit, append_note(F.col("dependency_group"), source)).otherwise(F.col("dependency_group")),
    }).select(*rows.columns, "bom_status")


def bom_references(rows: DataFrame) -> DataFrame:
    """The BOMs (bom, bom_version) that match rows refer to, each once."""
    return rows.select(bom_reference(_t("dependency_group")).alias("b")).filter("b is not null").select(F.col("b.package").alias("bom"), F.col("b.version").alias("bom_version")).distinct()


def bom_versions(poms: DataFrame, rounds: int = 5, asked: DataFrame | None = None) -> DataFrame:
    """bom, bom_version, target, resolved of the managed dependencies of POM documents (bom, bom_version, xml); ${names}
    of the document's properties are put in, in `rounds` rounds, and what still holds one is left out. asked: the BOMs
    (bom, bom_version) that are wanted; only their documents are parsed."""
    if asked is not None:
        poms = poms.join(small(materialize(asked.select("bom", "bom_version").distinct(), "asked")), ["bom", "bom_version"], "left_semi")
    at = lambda p: F.xpath("xml", F.lit(p))
    dep = "//*[local-name()='dependencyManagement']//*[local-name()='dependency']/*[local-name()='{}']/text()"
    prop = "//*[local-name()='properties']/*"
    names = F.transform(F.regexp_extract_all(F.regexp_extract("xml", r"(?s)<properties>(.*?)</properties>", 1), F.lit(r"<([A-Za-z0-9_.-]+)>[^<]*</"), F.lit(1)), lambda x: x)
    p = poms.select("bom", "bom_version", at(dep.format("groupId")).alias("g"), at(dep.format("artifactId")).alias("a"), at(dep.format("version")).alias("v"), names.alias("names"), at(prop + "/text()").alias("texts"))
    p = p.withColumn("props", F.when(F.size("names") == F.size("texts"), F.map_from_arrays(F.array_distinct("names"), F.slice("texts", 1, F.size(F.array_distinct("names"))))).otherwise(F.create_map().cast("map<string,string>")))
    p = p.withColumn("props", F.map_concat(F.map_filter("props", lambda k, _: ~k.isin("project.version", "project.groupId")), F.create_map(F.lit("project.version"), F.col("bom_version"), F.lit("project.groupId"), F.split("bom", ":")[0])))
    # a filter, or a generator that is not outer, would parse each document several times more
    whole = (F.size("g") == F.size("a")) & (F.size("a") == F.size("v"))
    d = p.select("bom", "bom_version", "props", F.inline_outer(F.when(whole, F.arrays_zip("g", "a", "v")))).filter("g is not null")

    def put_in(text: Column) -> Column:
        name = F.regexp_extract(text, r"\$\{([^}]+)\}", 1)
        value = F.try_element_at("props", name)
        return F.when((name != "") & value.isNotNull(), F.replace(text, F.concat(F.lit("${"), name, F.lit("}")), value)).otherwise(text)

    turns = F.array_repeat(F.lit(0), rounds)
    d = d.withColumns({c: F.aggregate(turns, F.col(c), lambda text, _: put_in(text)) for c in ("g", "v")})
    d = d.withColumn("resolved", exact_version(F.col("v"), F.lit(""))).filter("resolved <> '' and not contains(g, '${')")
    return d.groupBy("bom", "bom_version", F.concat(F.trim("g"), F.lit(":"), F.trim("a")).alias("target")).agg(F.max("resolved").alias("resolved"))
