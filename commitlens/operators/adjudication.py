"""Labels of candidate cases from what other evidence says: ordered rules, the first that holds decides.

One wide row for each case holds the inputs (`star`), absent inputs are null; a label is a struct of label, confidence
and the flag that its rule adds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.operators.imports import NODE_BUILTINS

#: Hints and flags that rule a finding out, registry states that are judged by time, names of manifests and lock files.
LOCAL_CONTEXT = ("explicit_workspace_or_local_context", "non_registry_dependency_spec", "resolved_version_present", "lockfile_context_present")
STRONG_NOT = ("local_workspace_or_mapping_evidence", "resolved_or_lockfile_evidence", "not_published_after_committer", "maven_official_query_match", "owned_package_release_workflow_possible")
TEMPORAL = ("published_after_author_date", "no_matching_version_before_author_date")
CANDIDATES = (*TEMPORAL, "current_absent_unknown")
SEMVER_NAMES = {
    "semver_no_matching_version": "fresh_no_matching_version", "semver_matching_exists_before_or_at_committer": "fresh_matching_exists_before_or_at_committer",
    "semver_matching_published_after_committer": "fresh_matching_published_after_committer",
}
MANIFEST_NAMES = {"npm": ("package.json",), "Cargo": ("cargo.toml",), "PyPI": ("pyproject.toml", "setup.cfg"), "Go": ("go.mod",), "Maven": ("pom.xml", "build.gradle", "build.gradle.kts", "libs.versions.toml")}
LOCK_NAMES = ("package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "yarn.lock", "cargo.lock", "go.sum", "gradle.lockfile")
CURRENT_NODE_BUILTINS = [n for n in NODE_BUILTINS if n != "async_hooks"]
DAY = 86400
LABELS = {"not": "not_hallucination", "confirmed": "confirmed_hallucination", "probable": "probable_hallucination", "indeterminate": "indeterminate"}


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: F.length(x) >= 3))


def is_owned(repo: Column, ecosystem: Column, package: Column) -> Column:
    """Whether a package's name points to the repository's owner or name."""
    owner, name = F.substring_index(repo, "/", 1), F.regexp_replace(repo, "^[^/]*/", "")
    group, artifact = F.substring_index(package, ":", 1), F.regexp_replace(package, "^[^:]*:", "")
    mine = _tokens(owner)
    maven = F.contains(_plain(group), _plain(owner)) | F.contains(_plain(group), _plain(name)) | ((F.size(mine) > 0) & (F.size(F.array_except(mine, _tokens(group))) == 0)) | (F.size(F.array_intersect(_tokens(name), _tokens(artifact))) >= 2)
    scoped = _plain(F.substring_index(F.substring(package, 2, 1 << 30), "/", 1)) == _plain(owner)
    go = F.startswith(F.regexp_replace(F.lower(package), "^https?://", ""), F.concat(F.lit("github.com/"), F.lower(repo)))
    return (
        F.when((ecosystem == "npm") & package.startswith("@"), scoped).when(ecosystem.isin("npm", "PyPI", "Cargo"), _plain(package) == _plain(name))
        .when(ecosystem == "Go", go).when((ecosystem == "Maven") & package.contains(":"), maven).otherwise(False)
    )


def build_candidates(episodes: DataFrame, commits: DataFrame, links: DataFrame, key: str = "sha") -> DataFrame:
    """Episodes in a state that needs a label, with their commit and their linked events as a sorted array."""
    cases = episodes.filter(F.col("registry_status").isin(*CANDIDATES))
    rows = links.groupBy("episode_id").agg(F.array_sort(F.collect_set(F.struct("event_type", "path", "line_no"))).alias("events"))
    return cases.join(commits, key).join(rows, "episode_id", "left")


def star(candidates: DataFrame, inputs: dict[str, DataFrame], key: str = "episode_id", seq: str | None = None) -> DataFrame:
    """candidates with a struct column for each input, null where it has no row; of repeated keys the last by seq stays.

    The inputs' rows are put below each other, each in its own column, and shuffled once: one aggregate gives the last of
    each, one join brings them to the candidates.
    """
    if not inputs:
        return candidates
    kinds = {name: df.select(F.struct(*[c for c in df.columns if c not in (key, seq)]).alias("x")).schema["x"].dataType for name, df in inputs.items()}
    rows = None
    for name, df in inputs.items():
        rest = F.struct(*[c for c in df.columns if c not in (key, seq)])
        part = df.select(key, *[(rest if n == name else F.lit(None).cast(t)).alias(n) for n, t in kinds.items()], (F.col(seq) if seq else F.lit(0)).alias("_seq"))
        rows = part if rows is None else rows.unionByName(part)
    # of equal seq the greatest row stays
    last = [F.max(F.when(F.col(n).isNotNull(), F.struct(F.col("_seq").alias("at"), F.col(n).alias("row"))))["row"].alias(n) for n in inputs]
    return candidates.join(rows.groupBy(key).agg(*last), key, "left")


#: What each rule says of its reason, by the rule's name; "" stands for what is left at the end.
TEMPORAL_BASIS = {
    "parent": "same package and query preexisted in first parent",
    "explained": "systematic local, resolved, timing, or official-registry explanation",
    "stdlib": "Python standard-library import, not an external dependency",
    "weak": "weak or import-only temporal signal after conservative exclusions",
    "patch": "path/workspace/custom-registry/lock or package-definition evidence",
    "before": "fresh official registry match predates committer time",
    "none": "versioned manifest change has no satisfying version in fresh public registry history",
    "late": "first satisfying public version was published more than 24h after committer time",
    "soon": "first satisfying public version was published within 24h after committer time",
    "": "official endpoint or publication-time evidence remains incomplete",
}
CURRENT_BASIS = {
    "local": "same-commit local/workspace/non-registry or resolved-lock evidence",
    "stdlib": "Python standard-library import",
    "wheel": "wheel evidence proves the candidate distribution provides the import",
    "alternate": "same-commit manifest verifies alternate Python distribution",
    "go": "Go subpackage/internal/local module was queried as a registry module",
    "node": "Node built-in module",
    "crate": "Rust crate matches repository package",
    "corrected": "fresh official registry match predates author time",
    "corrected_before": "corrected match predates committer time",
    "own_release": "project's own package release train",
    "maven": "official Maven artifact predates author time",
    "maven_before": "Maven artifact predates committer time",
    "maven_own": "project's own Maven release train",
    "maven_late": "Maven exact version published more than 24h after committer time",
    "maven_close": "Maven version postdates author but causal timing remains close",
    "maven_name": "Maven coordinate exists but name-only signal has no version time",
    "patch": "patch contains path/workspace/custom-registry/lock/package-definition evidence",
    "semver": "standard npm semver finds a current matching version",
    "alternate_index": "version may come from an alternate package index",
    "absent": "package exists but fresh official registry has no requested version/range",
    "maven_absent": "Maven coordinate exists but requested version is absent from Central and Google",
    "": "present-day absence, import mapping, private registry, deletion, or coverage remains unresolved",
}


def _cascade(rules: list[tuple[str, Column, str, str, Column | str | None]], basis: dict[str, str]) -> Column:
    """struct(label, confidence, flags, basis) of the first rule that holds."""
    out = None
    for name, cond, label, confidence, flag in rules:
        flags = F.array().cast("array<string>") if flag is None else F.array(F.lit(flag)) if isinstance(flag, str) else flag
        value = F.struct(F.lit(LABELS[label]).alias("label"), F.lit(confidence).alias("confidence"), flags.alias("flags"), F.lit(basis[name]).alias("basis"))
        cond = F.coalesce(cond, F.lit(False))
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def temporal_label(c: Callable[[str], Column] = F.col) -> Column:
    """For cases that a release after the commit explains, or no release at all."""
    flags, fresh = F.coalesce(c("queue.flags"), F.array().cast("array<string>")), c("fresh")
    renamed = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SEMVER_NAMES.items() for x in kv]), c("npm.semver_decision")), c("npm.semver_decision"))
    decision = F.when(c("npm").isNotNull(), renamed).otherwise(c("fresh.decision"))
    seconds = F.when(c("npm").isNotNull(), c("npm.seconds")).otherwise(c("fresh.seconds"))
    patch = F.coalesce(c("patch_flags"), F.array().cast("array<string>"))
    late = decision == "fresh_matching_published_after_committer"
    stdlib = (c("python.manifest_event_count") == 0) & (c("python.mapping_state") == "stdlib_import_present")
    out = _cascade([
        ("parent", c("queue.parent_state") == "package_and_query_preexisting", "not", "high", "parent_preexisting"), ("explained", F.arrays_overlap(flags, F.array(*[F.lit(x) for x in STRONG_NOT])), "not", "high", None), ("stdlib", stdlib, "not", "high", "python_stdlib"),
        ("weak", ~F.coalesce(c("queue.strong_review_candidate"), F.lit(False)) | fresh.isNull(), "indeterminate", "low", None), ("patch", F.size(patch) > 0, "not", "high", patch),
        ("before", decision == "fresh_matching_exists_before_or_at_committer", "not", "high", "fresh_before_committer"), ("none", decision == "fresh_no_matching_version", "confirmed", "high", "fresh_no_matching_version"),
        ("late", late & (seconds > DAY), "confirmed", "high", "fresh_postdate_gt_24h"), ("soon", late, "probable", "medium", "fresh_postdate_le_24h"), ("", F.lit(True), "indeterminate", "low", F.array_compact(F.array(decision))),
    ], TEMPORAL_BASIS)
    return out.withField("flags", F.array_sort(F.array_distinct(F.concat(flags, out["flags"]))))


def current_label(c: Callable[[str], Column] = F.col) -> Column:
    """For cases whose package or version the registry does not hold at present."""
    eco, package, value = c("ecosystem"), c("package_name"), c("query_value")
    owned = is_owned(c("repo"), eco, package)
    hints = F.array_intersect(c("context.hints"), F.array(*[F.lit(x) for x in LOCAL_CONTEXT]))
    has_python = c("python").isNotNull()
    stdlib = (c("python.manifest_event_count") == 0) & (c("python.mapping_state") == "stdlib_import_present")
    go = (eco == "Go") & (F.contains(F.concat(F.lit("/"), F.lower(package), F.lit("/")), F.lit("/internal/")) | ~F.substring_index(package, "/", 1).contains(".") | owned)
    root = F.substring_index(F.regexp_replace(F.lower(package), "^node:", ""), "/", 1)
    corrected, late = c("corrected.decision"), c("corrected.decision") == "corrected_match_published_after_author"
    before = c("hidden.seconds") <= 0
    maven, maven_late = c("maven_time.decision"), c("maven_time.decision") == "maven_exact_published_after_author"
    patch = F.coalesce(c("patch_flags"), F.array().cast("array<string>"))
    asked = c("current").isNotNull()
    given = c("current_npm.semver_current_decision")
    decision = F.when(c("current_npm").isNotNull(), F.when(given == "semver_package_exists_query_absent_now", "fresh_package_exists_query_absent_now").otherwise(given)).otherwise(c("current.decision"))
    absent = asked & (decision == "fresh_package_exists_query_absent_now")
    dynamic = F.upper(value).contains("SNAPSHOT") | value.contains("${")
    return _cascade([
        ("local", F.size(hints) > 0, "not", "high", F.array_sort(hints)), ("stdlib", has_python & stdlib, "not", "high", "python_stdlib"), ("wheel", c("python.mapping_state") == "candidate_distribution_provides_import", "not", "high", "python_wheel_proof"),
        ("alternate", has_python & (c("python_alt.verification_state") == "same_commit_alternate_manifest_match"), "not", "high", "python_alternate_manifest"), ("go", go, "not", "high", "go_module_granularity"),
        ("node", (eco == "npm") & root.isin(*CURRENT_NODE_BUILTINS), "not", "high", "node_builtin"), ("crate", (eco == "Cargo") & (c("query_kind") == "name_only") & owned, "not", "high", "cargo_repository_crate"),
        ("corrected", corrected == "corrected_match_exists_before_or_at_author", "not", "high", "corrected_registry_match"), ("corrected_before", late & before, "not", "high", "hidden_committer_correction"), ("own_release", late & owned, "not", "high", "owned_release_workflow"),
        ("maven", maven == "maven_exact_exists_before_or_at_author", "not", "high", "maven_artifact_before_author"), ("maven_before", maven_late & before, "not", "high", "hidden_committer_correction"),
        ("maven_own", maven_late & is_owned(c("repo"), F.lit("Maven"), package), "not", "high", "owned_release_workflow"), ("maven_late", maven_late & (c("hidden.seconds") > DAY), "confirmed", "high", "hidden_maven_postdate_gt_24h"),
        ("maven_close", maven_late, "indeterminate", "low", "hidden_maven_postdate"), ("maven_name", maven == "maven_name_only_exists_time_not_comparable", "indeterminate", "low", "maven_name_exists"),
        ("patch", asked & (F.coalesce(c("current.nonpublic_hint"), F.lit(False)) | (F.size(patch) > 0)), "not", "high", F.array_sort(F.array_union(patch, F.array(F.lit("current_nonpublic_spec"))))),
        ("semver", asked & (decision == "semver_query_match_exists_now"), "not", "high", "npm_semver_correction"), ("alternate_index", absent & (value.contains("+") | package.startswith("com.unity.")), "indeterminate", "low", "alternate_index_possible"),
        ("absent", absent & ~owned, "probable", "medium", "current_version_absent"), ("maven_absent", (c("maven.requery_class") == "official_package_exists_query_absent_or_unparsed") & ~dynamic, "probable", "medium", "maven_version_absent"),
        ("", F.lit(True), "indeterminate", "low", None),
    ], CURRENT_BASIS)


#: The inputs that the rules read, with their types; an input that is not given is null for every case.
INPUTS = {
    "context": "struct<hints:array<string>>", "python": "struct<manifest_event_count:int,mapping_state:string>", "python_alt": "struct<verification_state:string>",
    "queue": "struct<parent_state:string,flags:array<string>,strong_review_candidate:boolean>", "fresh": "struct<decision:string,seconds:bigint>", "npm": "struct<semver_decision:string,seconds:bigint>",
    "current": "struct<decision:string,nonpublic_hint:boolean>", "current_npm": "struct<semver_current_decision:string>", "corrected": "struct<decision:string>", "maven": "struct<requery_class:string>",
    "maven_time": "struct<decision:string>", "hidden": "struct<seconds:bigint>", "patch_flags": "array<string>",
}


def adjudicate(cases: DataFrame) -> DataFrame:
    """Adds final_label, confidence, adjudication_basis and evidence_flags (sorted) to cases with the columns of `star`."""
    full = cases.withColumns({n: F.lit(None).cast(t) for n, t in INPUTS.items() if n not in cases.columns})
    full = full.withColumn("verdict", F.when(F.col("registry_status").isin(*TEMPORAL), temporal_label()).otherwise(current_label()))
    return full.select(*[c for c in cases.columns if c not in INPUTS], F.col("verdict.label").alias("final_label"), F.col("verdict.confidence").alias("confidence"), F.col("verdict.basis").alias("adjudication_basis"), F.col("verdict.flags").alias("evidence_flags"))


#: The columns of a published row, in order.
PUBLISHED = ("case_id", "episode_id", "languages_json", "repo", "sha", "agent", "ecosystem", "package_name", "query_kind", "query_value", "original_registry_status", "final_label", "confidence", "adjudication_basis", "evidence_flags_json", "patch_path")


def published_rows(adjudicated: DataFrame) -> DataFrame:
    """Adjudicated cases as the rows that are published, all of text: languages (array) and flags as JSON, the registry status
    under its own name, missing values empty."""
    rows = adjudicated.withColumns({"original_registry_status": F.col("registry_status"), "languages_json": F.to_json("languages"), "evidence_flags_json": F.to_json(F.array_sort("evidence_flags"))})
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in PUBLISHED])


def relevant_lines(lines: DataFrame, key: str = "sha") -> DataFrame:
    """Lines of manifests, lock files and requirements files, with `file` (their name in lower case)."""
    name = F.lower(F.substring_index("path", "/", -1))
    known = [n for ns in MANIFEST_NAMES.values() for n in ns] + list(LOCK_NAMES)
    return lines.withColumn("file", name).filter(F.col("file").isin(*known) | F.col("file").rlike(r"^requirements.*\.txt$")).select(key, "path", "file", "line_no", "added", "text")


def patch_flags(cases: DataFrame, lines: DataFrame, key: str = "sha") -> DataFrame:
    """episode_id, patch_flags: what the patch itself says about a case's package (package_name, effective_name)."""
    rel = relevant_lines(lines, key)
    names = F.filter(F.array_distinct(F.array(F.lower("package_name"), F.lower(F.coalesce("effective_name", F.lit(""))))), lambda x: x != "")
    j = cases.select("episode_id", key, "ecosystem", "package_name", names.alias("names")).join(rel, key)
    low, eco, file = F.lower("text"), F.col("ecosystem"), F.col("file")
    named = F.exists("names", lambda n: F.contains(low, n))
    cargo_key = F.replace(F.regexp_extract(low, r"""^\s*['"]?([a-z0-9_.-]+)['"]?\s*=""", 1), F.lit("_"), F.lit("-"))
    cargo = F.array_contains(F.transform("names", lambda n: F.replace(n, F.lit("_"), F.lit("-"))), cargo_key) | F.array_contains("names", F.regexp_extract(low, r"""\bpackage\s*=\s*['"]([^'"]+)['"]""", 1))
    npm = F.array_contains("names", F.lower(F.regexp_extract("text", r'^\s*"([^"]+)"\s*:\s*"[^"]*"\s*,?\s*$', 1)))
    other = F.lit(False)
    for e in ("PyPI", "Go", "Maven"):
        other = other | ((eco == e) & file.isin(*MANIFEST_NAMES[e]))
    other = (other | ((eco == "PyPI") & file.startswith("requirements"))) & named
    declares = F.col("added") & F.when((eco == "Cargo") & (file == "cargo.toml"), cargo).when((eco == "npm") & (file == "package.json"), npm).otherwise(other)
    local = F.col("text").rlike(r"(?i)(workspace:|file:|link:|git\+)") | ((eco == "npm") & F.col("text").rlike("(?i)https?://")) | ((eco == "PyPI") & F.col("text").rlike(r"(?i)\s@\s*(git\+|https?://|file:)"))
    defined = (eco == "npm") & (file == "package.json") & F.regexp_extract(low, r"""['"]name['"]\s*:\s*['"]([^'"]+)['"]""", 1).eqNullSafe(F.lower("package_name"))
    rules = {
        "cargo_nonpublic_spec": declares & (eco == "Cargo") & F.col("text").rlike(r"\b(path|registry|git)\s*="), "lock_integrity": F.col("added") & file.isin(*LOCK_NAMES) & named & F.col("text").rlike(r"(?i)(sha512-|checksum\s*=|h1:)"),
        "package_defined_in_patch": defined, "workspace_or_nonregistry_spec": declares & local,
    }
    hit = j.groupBy("episode_id").agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return hit.select("episode_id", F.array_compact(F.array(*[F.when(F.col(n), n) for n in sorted(rules)])).alias("patch_flags"))


#: What a case gets whose manifest lines are comments.
COMMENT_FLAG = "commented_manifest_parser_false_positive"
COMMENT_BASIS = "manifest event was parsed from a commented-out dependency line"


def commented_cases(evidence: DataFrame, lines: DataFrame, key: str = "sha") -> DataFrame:
    """episode_id, commented_lines (by path and number) of the cases whose manifest events are all commented lines, one of
    them in a pyproject.toml. evidence: episode_id, key, event_type, path, line_no; an event without a line is no comment."""
    man = evidence.filter("event_type = 'manifest_addition'").join(lines.filter("added").select(key, "path", "line_no", "text"), [key, "path", "line_no"], "left")
    comment = F.coalesce(F.ltrim("text").startswith("#"), F.lit(False))
    said = F.collect_list(F.when(comment, F.struct("path", "line_no", "text")))
    each = man.groupBy("episode_id").agg(F.bool_and(comment).alias("all_comments"), F.bool_or(F.lower("path").endswith("pyproject.toml")).alias("toml"), F.array_sort(said).alias("said"))
    return each.filter("all_comments and toml").select("episode_id", F.col("said.text").alias("commented_lines"))


def comment_guard(labels: DataFrame, evidence: DataFrame, lines: DataFrame, key: str = "sha") -> DataFrame:
    """labels with the cases of commented_cases turned to not_hallucination; `corrected` marks them. Where labels have an
    adjudication_basis or evidence_flags, those say so too."""
    fix = commented_cases(evidence, lines, key).select("episode_id", F.lit(True).alias("hit"))
    out = labels.join(fix, "episode_id", "left").withColumn("corrected", F.coalesce("hit", F.lit(False))).drop("hit")
    flags = lambda: F.array_sort(F.array_union(F.coalesce("evidence_flags", F.array().cast("array<string>")), F.array(F.lit(COMMENT_FLAG))))
    new = {"final_label": lambda: F.lit(LABELS["not"]), "confidence": lambda: F.lit("high"), "adjudication_basis": lambda: F.lit(COMMENT_BASIS), "evidence_flags": flags}
    return out.withColumns({c: F.when(F.col("corrected"), value()).otherwise(F.col(c)) for c, value in new.items() if c in labels.columns})


def comment_audit(labels: DataFrame, evidence: DataFrame, lines: DataFrame, key: str = "sha") -> DataFrame:
    """episode_id, old_label, new_label, commented_lines of the labels that comment_guard turns."""
    return labels.select("episode_id", F.col("final_label").alias("old_label"), F.lit(LABELS["not"]).alias("new_label")).join(commented_cases(evidence, lines, key), "episode_id")
