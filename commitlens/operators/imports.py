"""Import statements of added source lines, and the registry package that each may stand for."""

from __future__ import annotations

import sys
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitlens.functions import paths
from commitlens.functions.ranges import let
from commitlens.operators.grammars import KINDS, LANGUAGE_KIND, MANIFEST_ECOSYSTEM, findings
from commitlens.operators.quality import event_id

#: The kinds of source files.
SOURCE_KINDS = tuple(dict.fromkeys(LANGUAGE_KIND.values()))
#: Names that come with a language, and packages named unlike what they provide.
NODE_BUILTINS = (
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "diagnostics_channel", "dns", "domain", "events", "fs",
    "http", "http2", "https", "module", "net", "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream", "string_decoder", "sys",
    "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib",
)
GO_BUILTINS = (
    "archive", "bufio", "bytes", "compress", "context", "crypto", "database", "embed", "encoding", "errors", "expvar", "flag", "fmt", "hash", "html", "image", "index",
    "io", "log", "math", "mime", "net", "os", "path", "reflect", "regexp", "runtime", "sort", "strconv", "strings", "sync", "testing", "text", "time", "unicode",
)
RUST_BUILTINS = ("crate", "self", "super", "std", "core", "alloc")
PYTHON_ALIASES = {"bs4": "beautifulsoup4", "cv2": "opencv-python", "dotenv": "python-dotenv", "PIL": "pillow", "sklearn": "scikit-learn", "yaml": "pyyaml"}
NPM_NAME = r"^(?:@[A-Za-z0-9][A-Za-z0-9._~-]*/)?[A-Za-z0-9][A-Za-z0-9._~-]*$"


def imports_of(lines: DataFrame, key: str = "sha", kinds: tuple[str, ...] = SOURCE_KINDS) -> DataFrame:
    """key, path, line_no, language, ordinal, raw_target of the import statements in added lines of the given languages.

    Python: whole statements, several on a line, and statements that go on over several lines by a bracket or a backslash
    (the number is that of the first). JavaScript: from clauses, import, require and import() anywhere on a line. Rust: use
    and extern crate. Go: single imports and blocks, which context lines open and close too.
    """
    found = findings(lines, key, kinds)
    return found.select(key, "path", "line_no", paths.source_language(F.col("path")).alias("language"), "ordinal", F.col("target").alias("raw_target"))


python_imports = partial(imports_of, kinds=("py",))
js_imports = partial(imports_of, kinds=("js",))
go_imports = partial(imports_of, kinds=("go",))
rust_java_imports = partial(imports_of, kinds=("rust", "java"))
all_imports = imports_of


def import_package(language: Column, target: Column, python_builtins: frozenset[str] = sys.stdlib_module_names) -> Column:
    """struct(package, status, reason) for a target; null for what no registry holds (relative, built in, protocol).
    python_builtins: the modules that come with Python; state them where results must not change with the interpreter."""
    first, dotted = F.substring_index(target, "/", 1), F.substring_index(target, ".", 1)
    keep = lambda p, s, r="": F.struct(p.alias("package"), F.lit(s).alias("status"), F.lit(r).alias("reason"))
    nothing = F.lit("")
    npm = F.when(target.startswith("@"), F.substring_index(target, "/", 2)).otherwise(first)
    js = (
        F.when(target.rlike(r"^(\.|/|#|@/|~/)") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(target.rlike(r"^(\$|@workspace/|@repo/|@packages/)"), keep(nothing, "mapping_uncertain", "possible_workspace_alias"))
        .when(first.isin(*NODE_BUILTINS), None).when(~npm.rlike(NPM_NAME), keep(nothing, "mapping_uncertain", "invalid_npm_package_candidate")).otherwise(keep(npm, "direct_mapping"))
    )
    alias = F.element_at(F.create_map(*[F.lit(x) for kv in PYTHON_ALIASES.items() for x in kv]), dotted)
    python = (
        F.when(target.startswith(".") | dotted.startswith("_") | dotted.isin(*sorted(python_builtins)), None)
        .when(alias.isNotNull(), keep(alias, "alias_mapping")).otherwise(keep(F.lower(F.replace(dotted, F.lit("_"), F.lit("-"))), "direct_or_normalized_mapping"))
    )
    crate = F.substring_index(target, "::", 1)
    rust = F.when(crate.isin(*RUST_BUILTINS), None).otherwise(keep(F.replace(crate, F.lit("_"), F.lit("-")), "hyphen_underscore_mapping"))
    go = F.when(target.rlike(r"^[./]") | first.isin(*GO_BUILTINS) | ~first.contains("."), None).otherwise(keep(target, "go_module_path_mapping"))
    java = F.when(target.rlike(r"^javax?\."), None).otherwise(keep(nothing, "mapping_uncertain", "mapping_uncertain"))
    return F.when(F.trim(target) == "", None).when(language.isin("TypeScript", "JavaScript"), js).when(language == "Python", python).when(language == "Rust", rust).when(language == "Go", go).when(language == "Java", java)


def normalize_imports(imports: DataFrame) -> DataFrame:
    """Imports that may name a package, with package_name, status and reasons."""
    m = imports.withColumn("m", import_package(F.col("language"), F.col("raw_target"))).filter("m is not null")
    reasons = F.filter(F.array("m.reason"), lambda x: x != "")
    return m.select(*imports.columns, F.col("m.package").alias("package_name"), F.col("m.status").alias("status"), reasons.alias("reasons"))


def extract_events(lines: DataFrame, key: str = "sha", languages: tuple[str, ...] = ()) -> DataFrame:
    """All import and manifest events of research paths, with their content ids, in one pass over the lines. languages: only
    the imports of these, and the manifests of their ecosystems."""
    kinds = KINDS
    if languages:
        ecosystems = {paths.ECOSYSTEMS[x] for x in languages}
        kinds = tuple(dict.fromkeys([LANGUAGE_KIND[x] for x in languages])) + tuple(k for k, e in MANIFEST_ECOSYSTEM.items() if e in ecosystems)
    found = findings(lines.filter(paths.is_research_path(F.col("path"))), key, kinds)
    found = found.withColumn("language", F.when(F.col("status").isNull(), paths.source_language(F.col("path"))))
    if languages:
        found = found.filter(F.col("language").isNull() | F.col("language").isin(*languages))
    manifest_ecosystem = F.element_at(F.create_map(*[F.lit(x) for kv in MANIFEST_ECOSYSTEM.items() for x in kv]), F.col("kind"))

    def event(kind, ecosystem, package, spec, status, reasons):
        return F.struct(F.lit(kind).alias("event_type"), ecosystem.alias("ecosystem"), package.alias("package_name"), spec.alias("version_spec"), status.alias("status"), reasons.alias("reasons"))

    # a list that a generator takes apart, as a filter on the package would work it out once more, and the code of all languages is too long to be compiled
    imported = let(import_package(F.col("language"), F.col("target")), lambda m: F.when(m.isNotNull(), event("import", paths.ecosystem(F.col("language")), m["package"], F.lit(""), m["status"], F.filter(F.array(m["reason"]), lambda x: x != ""))))
    declared = event("manifest_addition", manifest_ecosystem, F.col("target"), F.col("spec"), F.col("status"), F.col("reasons"))
    events = found.select(key, "path", "line_no", "ordinal", F.col("target").alias("raw_target"), F.explode_outer(F.array(F.when(F.col("language").isNotNull(), imported).otherwise(declared))).alias("e"))
    events = events.filter("e is not null").select(key, "e.event_type", "path", "e.ecosystem", "line_no", "ordinal", "raw_target", "e.package_name", "e.version_spec", "e.status", "e.reasons")
    return events.withColumn("event_id", event_id(F.col(key).cast("string"), *[F.col(c) for c in ("event_type", "path", "line_no", "ordinal", "raw_target")]))


def build_commits(events: DataFrame, index: DataFrame, key: str = "sha", population: DataFrame | None = None, changed: DataFrame | None = None) -> DataFrame:
    """Each commit of the index with its numbers of import and manifest events and its quadrant (I+M+ ... I-M-).

    population (key, agent, author_date, in the order of seq if there is one): its first row's agent and author_date are
    added, empty where it has none. changed (key, languages): the changed languages. Both also name the repository's
    language: repo_language of the index, else commit_primary_language.
    """
    n = events.groupBy(key).agg(F.count_if(F.col("event_type") == "import").alias("import_event_count"), F.count_if(F.col("event_type") == "manifest_addition").alias("manifest_event_count"))
    out = index.join(n, key, "left").fillna(0, ["import_event_count", "manifest_event_count"])
    sign = lambda c: F.when(F.col(c) > 0, "+").otherwise("-")
    out = out.withColumn("dependency_quadrant", F.concat(F.lit("I"), sign("import_event_count"), F.lit("M"), sign("manifest_event_count")))
    if population is not None:
        seq = F.col("seq") if "seq" in population.columns else F.struct("author_date", "agent")
        first = population.groupBy(key).agg(F.min_by(F.struct("agent", F.col("author_date").cast("string").alias("author_date")), seq).alias("p"))
        out = out.join(first, key, "left").withColumns({c: F.coalesce(f"p.{c}", F.lit("")) for c in ("agent", "author_date")}).drop("p")
        languages = [F.nullif(F.col(c), F.lit("")) for c in ("repo_language", "commit_primary_language") if c in index.columns]
        out = out.withColumn("repo_primary_language", F.coalesce(*languages, F.lit("")))
    if changed is not None:
        out = out.join(changed.select(key, F.col("languages").alias("actual_changed_languages")), key, "left").fillna({"actual_changed_languages": ""})
    return out


def sample_commits(commits: DataFrame, per_language: int, total: int, language: str = "language", order: str = "pos", extracted: DataFrame | None = None, key: str = "sha") -> DataFrame:
    """The first per_language commits of each language by their place in the index, at most total in all. With extracted
    (key), only commits that gave something count, and only those use up the quota."""
    if extracted is not None:
        commits = commits.join(extracted.select(key).distinct(), key, "left_semi")
    rank = F.row_number().over(Window.partitionBy(language).orderBy(order))
    return commits.withColumn("place", rank).filter(F.col("place") <= per_language).orderBy(order).limit(total)
