"""Import statements and declared dependencies in the lines of a diff: all grammars in one pass.

Lines are dealt out once, by file and hunk (a POM by file), and every window below keeps that partitioning. A grammar's
state is that of the last line which changed it: `state` (section, managed part, block of Go), then `inside` (array, option),
which needs the section. Two grammars need more than one line: a POM's dependency and a Python import that goes on over
several lines. Their lines form islands, numbered by the lines that open them; an island's text is put together only if it
closes and holds nothing else. Context lines change state, only added lines declare.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitlens.functions import paths
from commitlens.functions.ranges import let

#: Sections of package.json that declare dependencies, and the grammars' tokens.
NPM_SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
NPM_ENTRY = r'^\s*"([^"]+)"\s*:\s*"([^"]*)"\s*,?\s*$'
NPM_OPENS = r'^\s*"([^"]+)"\s*:\s*\{'
HEADER = r"^\[.*\]$"
TOML_PAIR = r"""^\s*['"]?([A-Za-z0-9_.-]+)['"]?\s*=\s*(.+?)\s*$"""
REQUIREMENT = r"^([A-Za-z0-9][A-Za-z0-9_.-]*)(?:\[[^\]]+\])?\s*(.*)$"
MARKER = (
    r"(?i);\s*(?:python_version|python_full_version|os_name|sys_platform|platform_release|platform_system|platform_version|platform_machine|"
    r"platform_python_implementation|implementation_name|implementation_version|extra)\b.*$"
)
CARGO_SECTION = r"(?i)^\[(target\.[^]]+\.)?(dev-|build-)?dependencies\]$"
GO_REQUIRE = r"^(?:require\s+)?(\S+)\s+(v\S+)(?:\s+//.*)?$"
QUOTED = r"""['"]([^'"]+)['"]"""
REQUIRES_OPTION = r"(?i)^install_requires\s*=\s*(.*)$"
RUST_USE, RUST_CRATE = r"^\s*use\s+([A-Za-z_][\w:]*)", r"^\s*extern\s+crate\s+([A-Za-z_]\w*)"
JAVA = r"^\s*import\s+(?:static\s+)?([A-Za-z_]\w*(?:\.[A-Za-z_*]\w*)+)\s*;?"
GO_ONE = r"""^\s*import\s+(?:[._A-Za-z]\w*\s+)?["`]([^"`]+)["`]"""
GO_IN_BLOCK = r"""^\s*(?:[._A-Za-z]\w*\s+)?["`]([^"`]+)["`]"""
#: The four ways to import in JavaScript, wherever they stand on a line, but not after a hyphen.
JS_FROM = r"""\bfrom\s*['"][^'"]+['"]"""
JS_IMPORT = r"""^\s*import\s*['"][^'"]+['"]"""
JS_REQUIRE = r"""\brequire\(\s*['"][^'"]+['"]\s*\)"""
JS_DYNAMIC = r"""\bimport\(\s*['"][^'"]+['"]\s*\)"""
JS_ANY = rf"(?<!-)(?:{JS_FROM}|{JS_IMPORT}|{JS_REQUIRE}|{JS_DYNAMIC})"
#: Gradle's configurations, the endings of derived ones, and what may stand after one that has no bracket.
GRADLE_NAMES = ("api", "implementation", "compile", "runtime", "provided", "thirdParty", "compileOnly", "runtimeOnly", "annotationProcessor", "classpath")
GRADLE_ENDINGS = ("Api", "Implementation", "CompileOnly", "RuntimeOnly", "Compile", "Runtime", "AnnotationProcessor")
GRADLE_ARGUMENT = r"""["']|(?:project|platform|enforcedPlatform|fg\.deobf|include)\s*\(|libs\b|group\s*[:=]"""
GRADLE_WORD = rf'(?<![\w.])"?([A-Za-z_]\w*)"?(?=\s*\(|\s+(?:{GRADLE_ARGUMENT}))'
GRADLE_SKIP = r"^\s*(//|/\*|\*|#)|\bproject\s*\("
GRADLE_COORDINATE = r"""['"]([A-Za-z0-9_.${}-]+):([A-Za-z0-9_.${}-]+):([^'"]+)['"]"""
GRADLE_ALIAS = r"\blibs(?:\.[A-Za-z_]\w*)+"
#: Python's import statements, whole; parts of a line that open or continue one over several lines.
PY_WORD = r"[A-Za-z_]\w*+"
PY_NAME = r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*"
PY_AS = rf"{PY_WORD}(?:\s++as\s++{PY_WORD})?+"
PY_IMPORT = rf"^import\s+({PY_NAME}(?:\s+as\s+[A-Za-z_]\w*)?(?:\s*,\s*{PY_NAME}(?:\s+as\s+[A-Za-z_]\w*)?)*)$"
PY_FROM = rf"^from\s+(\.[.\s]*(?:{PY_NAME})?|{PY_NAME})\s*\bimport\b\s*(?:\*|{PY_AS}(?:\s*+,\s*+{PY_AS})*+|\(\s*+{PY_AS}(?:\s*+,\s*+{PY_AS})*+\s*+,?+\s*+\))$"
PY_REST = rf"(?:{PY_AS}\s*+(?:,\s*+|$|(?=[)#\;])))*+"
PY_BRACKET = rf"^\s*from\s+[\w.\s]+?\bimport\b\s*\(\s*+{PY_REST}(?:#.*)?$"
PY_SLASH = r"^\s*(?:import|from)\b[^#'\"]*\\$"
PY_BODY = rf"^\s*+{PY_REST}\)?+\s*+;?+\s*+\\?+(?:#.*)?+$"
PY_COMPOUND = r"^(?:if|elif|else|for|while|with|try|except|finally|def|class|async|match|case|@)\b|^@"
PY_DANGLING = r"(?:[-=+*/%&|^~<>.:@]|\b(?:and|or|not|in|is|if|else|lambda|return\s+not))$"
#: The ecosystem of each kind of manifest.
MANIFEST_ECOSYSTEM = {"npm": "npm", "requirements": "PyPI", "pyproject": "PyPI", "setup_cfg": "PyPI", "cargo": "Cargo", "gomod": "Go", "maven": "Maven", "gradle": "Maven", "catalog": "Maven"}
LANGUAGE_KIND = paths.LANGUAGE_KIND
BLANKS = paths.BLANKS
#: Grammars that judge each line by itself.
STATELESS = ("requirements", "gradle", "js", "rust", "java")
KINDS = (*MANIFEST_ECOSYSTEM, *dict.fromkeys(LANGUAGE_KIND.values()))
#: Most grammars whose findings become a column, which Spark compiles; the code of all is slower than interpreting it in explode.
COMPILED_KINDS = 3
ITEM = "array<struct<ordinal:int,target:string,spec:string,status:string,reasons:array<string>>>"


def _found(text: Column | str, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def unquoted(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), """^["']+|["']+$""", "")


def requirement(text: Column) -> Column:
    """struct(package, spec) of a requirement text without extras, comment and marker; null if it is none."""
    cut = F.rtrim(F.regexp_replace(F.trim(text), r"\s+#.*$", ""))
    name, spec = _found(cut, REQUIREMENT), F.rtrim(F.regexp_replace(F.regexp_extract(cut, REQUIREMENT, 2), MARKER, ""))
    ok = name.isNotNull() & ~F.trim(text).rlike("^[#-]") & ((spec == "") | spec.rlike("^(===|~=|==|!=|<=|>=|<|>|@|;)"))
    return F.when(ok, F.struct(name.alias("package"), spec.alias("spec")))


def _item(target: Column, spec: Column | None = None, ordinal: Column | None = None, status: Column | str | None = "direct_manifest", reasons: Column | None = None) -> Column:
    """One finding as a struct; spec as it is declared, without quotes."""
    status = F.lit(status).cast("string") if not isinstance(status, Column) else status
    return F.struct(
        (F.lit(0) if ordinal is None else ordinal).cast("int").alias("ordinal"), target.alias("target"), (F.lit("") if spec is None else unquoted(F.coalesce(spec, F.lit("")))).alias("spec"), status.alias("status"),
        (F.array().cast("array<string>") if reasons is None else reasons).alias("reasons"),
    )


def _one(when: Column, item: Column) -> Column:
    return F.when(when, F.array(item)).otherwise(F.array().cast(ITEM))


def _each(targets: Column) -> Column:
    """Import targets with their ordinals."""
    return F.transform(targets, lambda t, i: _item(t, ordinal=i, status=None))


def _required(texts: Column) -> Column:
    """The requirements among texts, each with its place as ordinal."""
    each = F.transform(texts, lambda x, i: F.struct(i.alias("i"), requirement(x).alias("r")))
    return F.transform(F.filter(each, lambda x: x["r"].isNotNull()), lambda x: _item(x["r"]["package"], x["r"]["spec"], x["i"]))


def python_targets(text: Column) -> Column:
    """Targets of the import statements of a logical line, in order; none if the line is no sequence of simple statements.

    Quoted texts are blanked and a comment cut first, so that a `;` or a bracket in them says nothing; statements are what
    stands between the `;`; a line with an open bracket or quote, a dangling operator or an empty statement is no line.
    """
    bare = F.regexp_replace(text, r"""("(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+')""", "0")
    bare = F.regexp_replace(F.regexp_replace(bare, r"#.*$", ""), r"^\s+|[\s]+$", "")
    bare = F.regexp_replace(bare, r";$", "")
    same = lambda a, b: F.length(F.translate(bare, a, "")) == F.length(F.translate(bare, b, ""))
    whole = same("(", ")") & same("[", "]") & same("{", "}") & ~bare.rlike(r"""["']""") & ~bare.rlike(PY_COMPOUND)
    parts = F.transform(F.split(bare, ";"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    named = lambda p: F.transform(F.split(F.regexp_extract(p, PY_IMPORT, 1), r"\s*,\s*"), lambda x: F.regexp_extract(x, rf"^\s*({PY_NAME})", 1))
    module = lambda p: F.array(F.regexp_replace(F.regexp_extract(p, PY_FROM, 1), r"\s", ""))
    is_import = lambda p: p.rlike(r"^(?:import|from)\b")
    sound = ~F.exists(parts, lambda p: (p == "") | F.when(is_import(p), ~p.rlike(PY_IMPORT) & ~p.rlike(PY_FROM)).otherwise(p.rlike(PY_DANGLING)))
    got = F.flatten(F.transform(parts, lambda p: F.when(p.rlike(PY_IMPORT), named(p)).when(p.rlike(PY_FROM), module(p)).otherwise(F.array().cast("array<string>"))))
    return F.when(bare.contains("import") & whole & sound, got).otherwise(F.array().cast("array<string>"))


def gradle_declares(text: Column) -> Column:
    """Does the line call one of Gradle's configurations, or one derived from them?"""
    words = F.regexp_extract_all(text, F.lit(GRADLE_WORD), F.lit(1))
    derived = lambda w: F.lit(False)
    for e in GRADLE_ENDINGS:
        derived = lambda w, e=e, d=derived: d(w) | (w.endswith(e) & (F.length(w) > len(e)))
    return ~text.rlike(GRADLE_SKIP) & F.exists(words, lambda w: w.isin(*GRADLE_NAMES) | derived(w))


def _by_kind(cases: dict[str, Column], otherwise: Column | None = None) -> Column:
    """A value by the line's kind."""
    out = None
    for kind, value in cases.items():
        out = F.when(F.col("kind") == kind, value) if out is None else out.when(F.col("kind") == kind, value)
    return out if otherwise is None else out.otherwise(otherwise)


#: Lines that can matter where not all do: of grammars without state those that may declare, of Python those that import or
#: could continue an import.
ALONE = {
    "js": lambda t, added: added & t.rlike("from|import|require"), "rust": lambda t, added: added & t.rlike("use|extern"), "java": lambda t, added: added & t.contains("import"),
    "requirements": lambda t, added: added, "gradle": lambda t, added: added, "py": lambda t, added: t.contains("import") | t.rlike(PY_BODY),
}


def _wanted(kind: Column, kinds: tuple[str, ...]) -> Column:
    """Lines that can matter."""
    out = F.when(~kind.isin(*kinds), False)
    for k in kinds:
        out = out.when(kind == k, ALONE[k](F.col("text"), F.col("added"))) if k in ALONE else out
    return F.coalesce(out.otherwise(kind.isNotNull()), F.lit(False))


#: The rules below say of a line, by its text t and its trimmed text s, what its grammar's state becomes (null: stays).
def _head(s: Column) -> Column:
    return s.rlike(HEADER)


TURNS = {
    "npm": lambda t, s: F.coalesce(_found(t, NPM_OPENS), F.when(t.rlike(r"^\s*\}"), "")), "pyproject": lambda t, s: F.when(_head(s), F.lower(s)), "setup_cfg": lambda t, s: F.when(_head(s), F.lower(s)),
    "cargo": lambda t, s: F.when(_head(s), F.when(s.rlike(CARGO_SECTION), "in").otherwise("out")), "catalog": lambda t, s: F.when(_head(s), F.when(F.lower(s) == "[libraries]", "in").otherwise("out")),
    "gomod": lambda t, s: F.when(s.startswith("require ("), "in").when(s == ")", "out"), "go": lambda t, s: F.when(s.startswith("import ("), "in").when(s == ")", "out"),
    "maven": lambda t, s: F.when(t.contains("</dependencyManagement"), "out").when(t.contains("<dependencyManagement"), "in"), "py": lambda t, s: F.when(t.rlike(PY_BRACKET), "bracket").when(t.rlike(PY_SLASH), "slash"),
}
#: Lines that open an array, an option or an island of lines, by the state too.
OPENS = {
    "pyproject": lambda t, s, state: (state == "[project]") & s.startswith("dependencies") & ~_head(s), "setup_cfg": lambda t, s, state: (state == "[options]") & s.rlike(REQUIRES_OPTION) & ~_head(s),
    "maven": lambda t, s, state: t.contains("<dependency>") & (state != "in"),
}
#: Whether the lines from this one on stand inside an array or option.
INSIDE = {
    "pyproject": lambda t, s, opens: F.when(_head(s), False).when(opens, s.contains("[") & ~s.contains("]")).when(s.startswith("]"), False),
    "setup_cfg": lambda t, s, opens: F.when(_head(s), False).when(opens, True).when((s != "") & ~t.rlike(r"^\s"), False),
}


def _py_closes(t: Column, s: Column, state: Column) -> Column:
    return F.when(state == "bracket", F.regexp_replace(t, r"#.*$", "").contains(")")).otherwise(~s.endswith("\\"))


def _py_code(t: Column) -> Column:
    """A line of a statement over several lines, without its comment and backslash."""
    return F.regexp_replace(F.regexp_replace(t, r"#.*$", ""), r"\\\s*$", "")


def _pom_identity(t: Column) -> Column:
    return t.contains("<dependency>") | t.contains("<groupId>") | t.contains("<artifactId>")


def findings(lines: DataFrame, key: str = "sha", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """key, path, kind, line_no, ordinal, target, spec, status (null for imports), reasons of every import statement and every
    declared dependency in lines, of the given kinds of files. lines: a row for each line (key, file_no, path, hunk, line_no,
    added, text), whose states take windows, or the rows of diff.patch_scopes, which need no window, sort or shuffle."""
    if "scope" in lines.columns:
        return _declared(_stated_scopes(lines, key, kinds), key, kinds)
    # patch_lines gives the kind, worked out once for a file
    kind = F.col("kind") if "kind" in lines.columns else paths.kind_of(F.col("path"))
    kept = lines.filter(kind.isin(*kinds)).filter(_wanted(kind, kinds) if "kind" in lines.columns else let(kind, lambda k: _wanted(k, kinds)))
    df = kept.select(key, "file_no", "path", "hunk", "line_no", "added", "text", kind.alias("kind"))
    if set(kinds) <= set(STATELESS):
        nothing = {"s": F.trim("text", F.lit(BLANKS)), "state": F.lit(""), "opens": F.lit(False), "inside": F.lit(False), "body": F.lit(None).cast("string"), "at": F.col("line_no")}
        return _declared(df.withColumns(nothing), key, kinds)
    df = df.withColumn("scope", F.when(F.col("kind") == "maven", 0).otherwise(F.col("hunk")))
    if "kind" not in lines.columns:  # lines of patch_lines lie where their patch does
        df = df.repartition(key, "file_no", "scope")
    return _declared(_stated_lines(df, key, kinds), key, kinds)


def _pieces(lines: Column, first: Column, turn) -> Column:
    """An array (a column or variable) cut before the elements of which turn says something: array of struct(value, lines),
    value being what turn says of the first element of lines; what stands before the first such element has the value first."""
    said = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), turn(x).alias("value"))), lambda m: m["value"].isNotNull())
    end = lambda marks, j: F.coalesce(F.get(marks, j + 1)["i"], F.size(lines))
    return let(
        F.concat(F.array(F.struct(F.lit(0).alias("i"), first.alias("value"))), said),
        lambda marks: F.transform(marks, lambda m, j: F.struct(m["value"].alias("value"), F.slice(lines, m["i"] + 1, end(marks, j) - m["i"]).alias("lines"))),
    )


def _line(x: Column, state: Column, opens: Column | None = None, inside: Column | None = None, body: Column | None = None, at: Column | None = None) -> Column:
    """A line with its state, as a struct."""
    flag = lambda c: (F.lit(False) if c is None else F.coalesce(c, F.lit(False))).cast("boolean")
    return F.struct(
        (x["line_no"] if at is None else at).alias("at"), x["added"].alias("added"), x["text"].alias("text"), x["s"].alias("s"), state.cast("string").alias("state"),
        flag(opens).alias("opens"), flag(inside).alias("inside"), (F.lit(None) if body is None else body).cast("string").alias("body"),
    )


def _island(lines: Column, closes) -> Column:
    """The array up to the first element that closes; empty if none does."""
    return F.slice(lines, 1, F.array_position(F.transform(lines, lambda x: F.coalesce(closes(x), F.lit(False))), True).cast("int"))


def _stated(kind: str, scope: Column) -> Column:
    """The lines of a scope that may declare something, with their states; by nested cuts."""
    plain = lambda x: x["added"]
    if kind in ALONE:
        scope = F.filter(scope, lambda x: ALONE[kind](x["text"], x["added"]))
    if kind in STATELESS:
        return F.transform(scope, lambda x: _line(x, F.lit("")))
    if kind == "py":
        return let(scope, _py_stated)
    pieces = _pieces(scope, F.lit(""), lambda x: TURNS[kind](x["text"], x["s"]))
    each = lambda f: F.flatten(F.transform(pieces, f))
    if kind in INSIDE:
        opens = lambda x, p: OPENS[kind](x["text"], x["s"], p["value"])
        inner = lambda p: _pieces(p["lines"], F.lit(False), lambda x: INSIDE[kind](x["text"], x["s"], opens(x, p)))
        return each(lambda p: F.flatten(F.transform(inner(p), lambda q: F.transform(F.filter(q["lines"], plain), lambda x: _line(x, p["value"], opens(x, p), q["value"])))))
    if kind == "maven":
        stated = each(lambda p: F.transform(p["lines"], lambda x: F.struct(x["line_no"].alias("line_no"), x["added"].alias("added"), x["text"].alias("text"), x["s"].alias("s"), p["value"].alias("state"))))
        islands = let(stated, lambda all_: _pieces(all_, F.lit(False), lambda x: F.when(OPENS["maven"](x["text"], x["s"], x["state"]), True)))
        islands = F.filter(islands, lambda p: p["value"])
        closed = F.filter(F.transform(islands, lambda p: _island(p["lines"], lambda x: x["text"].contains("</dependency>"))), lambda i: F.exists(i, lambda x: x["added"] & _pom_identity(x["text"])))
        return F.transform(closed, lambda i: _line(i[0], i[0]["state"], F.lit(True), body=F.array_join(F.transform(i, lambda x: x["text"]), "\n"), at=F.filter(i, plain)[0]["line_no"]))
    return each(lambda p: F.transform(F.filter(p["lines"], plain), lambda x: _line(x, p["value"])))


def _py_stated(scope: Column) -> Column:
    """Python's lines that import, with the text of the statement that one opens over several lines. A piece is an island: its
    first line opens it, and no later one does."""

    def statement(p):
        island = _island(p["lines"], lambda x: (x["line_no"] > p["lines"][0]["line_no"]) & _py_closes(x["text"], x["s"], p["value"]))
        whole = lambda i: (F.size(i) > 0) & (F.element_at(i, -1)["line_no"] - i[0]["line_no"] == F.size(i) - 1)
        return F.when(p["value"] != "", let(island, lambda i: F.when(whole(i), F.array_join(F.transform(i, lambda x: _py_code(x["text"])), " "))))

    def stated(p):
        line = lambda body: lambda x, i: _line(x, p["value"], (i == 0) & (p["value"] != ""), body=F.when(i == 0, body))
        return let(statement(p), lambda body: F.filter(F.transform(p["lines"], line(body)), lambda x: x["added"] & (x["body"].isNotNull() | x["text"].contains("import"))))

    return F.flatten(F.transform(_pieces(scope, F.lit(""), lambda x: TURNS["py"](x["text"], x["s"])), stated))


def _stated_scopes(scopes: DataFrame, key: str, kinds: tuple[str, ...]) -> DataFrame:
    """The lines of scopes that may declare something, a row each, with their states."""
    each = _by_kind({k: _stated(k, F.col("scope")) for k in kinds})
    # outer, as else Spark works the list out once more to filter empty ones
    rows = scopes.filter(F.col("kind").isin(*kinds)).select(key, "path", "kind", F.explode_outer(each).alias("x")).filter("x is not null")
    return rows.select(key, "path", "kind", "x.*")


def _stated_lines(df: DataFrame, key: str, kinds: tuple[str, ...]) -> DataFrame:
    """Lines with their states, by windows over the lines of a scope."""
    file, order = [key, "file_no", "scope"], ["hunk", "line_no"]
    upto = Window.partitionBy(*file).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    t, s = F.col("text"), F.col("s")
    df = df.withColumn("s", F.trim("text", F.lit(BLANKS)))
    has = lambda c: c in kinds
    pick = lambda cases: {k: v for k, v in cases.items() if has(k)} or {"": F.lit(None)}
    # what the last line that changed the state says
    turn = _by_kind(pick({k: f(t, s) for k, f in TURNS.items()})).cast("string")
    df = df.withColumn("turn", turn).withColumn("state", F.coalesce(F.last("turn", True).over(upto), F.lit("")))
    state = F.col("state")
    # what needs the section: arrays and options, and the lines that open an island
    opens = _by_kind(pick({k: f(t, s, state) for k, f in OPENS.items()} | {"py": F.col("turn").isNotNull()}), F.lit(False))
    df = df.withColumn("opens", F.coalesce(opens.cast("boolean"), F.lit(False)))
    begins = F.col("opens")
    inside = _by_kind(pick({k: f(t, s, begins) for k, f in INSIDE.items()})).cast("boolean")
    island = F.when(F.col("kind").isin("maven", "py") & begins, True)
    df = df.withColumn("inside", inside).withColumn("inside", F.coalesce(F.last("inside", True).over(upto), F.lit(False))).withColumn("island", F.count(island).over(upto))
    if has("maven") or has("py"):
        closes = _by_kind(pick({"maven": t.contains("</dependency>"), "py": ~begins & _py_closes(t, s, state)}), F.lit(False)) & (F.col("island") > 0)
        within = Window.partitionBy(*file, "island").orderBy(*order)
        df = df.withColumn("closes", closes).withColumns({
            "closed": F.coalesce(F.count_if("closes").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0,
            "in_line": F.col("line_no") - F.first("line_no").over(within.rowsBetween(Window.unboundedPreceding, 0)) == F.row_number().over(within) - 1,
        })
        # an island that closes, and of Python one that nothing else interrupts; its text, and where it counts as added
        over = Window.partitionBy(*file, "island", "closed").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        df = df.withColumn("whole", (F.col("island") > 0) & ~F.col("closed") & F.bool_or("closes").over(over))
        df = df.withColumn("whole", F.when(F.col("kind") == "maven", F.col("whole") & F.bool_or(F.col("added") & _pom_identity(t)).over(over)).otherwise(F.col("whole") & F.bool_and("in_line").over(over)))
        line = F.when(F.col("kind") == "py", _py_code(t)).otherwise(t)
        df = df.withColumn("body", F.collect_list(F.when(F.col("whole"), line)).over(over))
        first_added = F.min(F.when(F.col("added") & F.col("whole"), F.struct(*order))).over(over)
        df = df.withColumn("at", F.when(F.col("kind") == "maven", first_added["line_no"]).otherwise(F.col("line_no")))
        return df.withColumn("body", F.when(F.col("opens") & F.col("whole"), F.when(F.col("kind") == "py", F.array_join("body", " ")).otherwise(F.array_join("body", "\n"))))
    return df.withColumns({"body": F.lit(None).cast("string"), "at": F.col("line_no")})


def _declared(df: DataFrame, key: str, kinds: tuple[str, ...]) -> DataFrame:
    """The findings of lines whose state is known."""
    t, s, added, opens, state, inside = (F.col(c) for c in ("text", "s", "added", "opens", "state", "inside"))
    head, none = s.rlike(HEADER), F.array().cast(ITEM)
    quoted = F.regexp_extract_all("text", F.lit(QUOTED), F.lit(1))
    # what several rules ask of a line is a column, worked out once and only where they apply
    pair = F.col("kind").isin("pyproject", "cargo") & added & ~s.rlike(HEADER)
    if {"pyproject", "cargo"} & set(kinds):
        df = df.withColumns({"toml_key": F.when(pair, F.regexp_extract("text", TOML_PAIR, 1)), "toml_value": F.when(pair, F.regexp_extract("text", TOML_PAIR, 2))})
        is_crate = pair & (F.col("kind") == "cargo") & (state == "in")
        df = df.withColumns({"toml_version": F.when(is_crate, F.regexp_extract("toml_value", r"""\bversion\s*=\s*['"]([^'"]+)['"]""", 1)), "toml_field": F.when(is_crate, F.regexp_extract("toml_key", r"^.*\.([^.]*)$", 1))})
    else:
        df = df.withColumns({c: F.lit(None).cast("string") for c in ("toml_key", "toml_value", "toml_version", "toml_field")})
    key_, value = F.nullif("toml_key", F.lit("")), F.col("toml_value")
    poetry = (state == "[tool.poetry.dependencies]") & ~s.startswith("#") & key_.isNotNull() & (F.lower(key_) != "python")
    pyproject = F.when(opens, _required(quoted)).when(head, none).when(poetry, F.array(_item(key_, value))).when(inside & ~s.startswith("#"), _required(F.slice(quoted, 1, 1))).otherwise(none)
    setup_cfg = F.when(inside & ~head, _required(F.array(F.when(opens, F.regexp_extract("s", REQUIRES_OPTION, 1)).otherwise(s)))).otherwise(none)
    dotted, field = key_.contains("."), F.lower(F.nullif("toml_field", F.lit("")))
    inherits = F.when(dotted, (field == "workspace") & (F.lower(F.trim(value)) == "true")).otherwise(value.rlike(r"(?i)\bworkspace\s*=\s*true\b"))
    version = F.coalesce(F.nullif("toml_version", F.lit("")), value)
    crate = F.when(dotted, F.regexp_extract(key_, r"^(.*)\.[^.]*$", 1)).otherwise(key_)
    inherited = F.when(inherits, F.array(F.lit("workspace_inherited"))).otherwise(F.array().cast("array<string>"))
    cargo = _one((state == "in") & ~head & key_.isNotNull() & (~dotted | (field == "version") | inherits), _item(crate, F.when(inherits, "workspace:").otherwise(version), reasons=inherited))
    module = F.regexp_extract("s", GO_REQUIRE, 1)
    gomod = _one(((state == "in") | s.startswith("require ")) & ~s.startswith("require (") & s.rlike(GO_REQUIRE), _item(module, F.regexp_extract("s", GO_REQUIRE, 2)))
    tag = lambda name: F.trim(F.regexp_extract("body", rf"<{name}>\s*([^<]+?)\s*</{name}>", 1))
    maven = _one(F.col("body").isNotNull() & (tag("groupId") != "") & (tag("artifactId") != ""), _item(F.concat(tag("groupId"), F.lit(":"), tag("artifactId")), tag("version")))
    named = lambda n: _found("text", rf"""\b{n}\s*[:=]\s*['"]([^'"]+)['"]""")
    one = F.when(t.rlike(GRADLE_COORDINATE), F.concat(F.regexp_extract("text", GRADLE_COORDINATE, 1), F.lit(":"), F.regexp_extract("text", GRADLE_COORDINATE, 2)))
    mapped, alias = F.concat(named("group"), F.lit(":"), named("name")), _found("text", GRADLE_ALIAS, 0)
    loose = one.isNull() & mapped.isNull()
    spec = F.when(one.isNotNull(), F.regexp_extract("text", GRADLE_COORDINATE, 3)).when(mapped.isNotNull(), F.coalesce(named("version"), F.lit("")))
    unresolved = F.when(loose, F.array(F.lit("version_unresolved"))).otherwise(F.array().cast("array<string>"))
    gradle = _one(gradle_declares(t) & F.coalesce(one, mapped, alias).isNotNull(), _item(F.coalesce(one, mapped, alias), spec, status=F.when(loose, "unresolved_gradle_alias").otherwise("direct_manifest"), reasons=unresolved))
    catalog_module = _found("text", r"""\bmodule\s*=\s*['"]([^'"]+)['"]""")
    catalog = _one((state == "in") & ~head & catalog_module.isNotNull(), _item(catalog_module, _found("text", r"""\bversion\s*=\s*['"]([^'"]+)['"]"""), status="direct_manifest_catalog"))
    some = lambda *targets: _each(F.array_compact(F.array(*targets)))
    js = F.transform(F.regexp_extract_all("text", F.lit(JS_ANY), F.lit(0)), lambda m: F.regexp_extract(m, QUOTED, 1))
    go = F.when(s.startswith("import (") | ((state == "in") & (s == ")")), none).otherwise(some(F.when(state == "in", _found("text", GO_IN_BLOCK)).otherwise(_found("text", GO_ONE))))
    cases = {
        "npm": _one(state.isin(*NPM_SECTIONS) & t.rlike(NPM_ENTRY), _item(F.regexp_extract("text", NPM_ENTRY, 1), F.regexp_extract("text", NPM_ENTRY, 2))),
        "requirements": _required(F.array("s")), "pyproject": pyproject, "setup_cfg": setup_cfg, "cargo": cargo, "gomod": gomod, "gradle": gradle, "catalog": catalog,
        "js": _each(js), "rust": some(_found("text", RUST_USE), _found("text", RUST_CRATE)), "java": some(_found("text", JAVA)), "go": go, "py": _each(python_targets(F.coalesce("body", "s"))),
    }
    on_line = _by_kind({k: v for k, v in cases.items() if k in kinds} or {"": none}, none)
    items = F.when(F.col("kind") == "maven", maven).when(added, on_line) if "maven" in kinds else F.when(added, on_line)
    if len(kinds) <= COMPILED_KINDS:
        df, items = df.withColumn("items", items), F.col("items")
    # outer, as else Spark works the list out once more to filter empty ones
    each = df.select(key, "path", "kind", F.col("at").alias("line_no"), F.explode_outer(items).alias("x")).filter("x is not null")
    return each.select(key, "path", "kind", "line_no", "x.*")
