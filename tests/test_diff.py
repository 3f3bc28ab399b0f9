"""Diff lines, statements and manifests against plain loops over lines, and forms that the rendered rows do not hold."""

import ast
import random
import re

import pytest
from pyspark.sql import functions as F

from commitlens.operators import diff, grammars, imports, manifests


def lines_by_hand(patch):
    """file, path, hunk, number, added and text of each line of the new file, by one loop."""
    files, path, kept, number, hunk = [], "", [], 0, 0
    for raw in re.split(r"\r\n|\r|\n", patch):
        if m := re.match(r"diff --git a/(.*?) b/(.*)\Z", raw, re.S):
            files.append((path, kept))
            path, kept, number, hunk = m[2], [], 0, 0
        elif (m := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", raw)) is not None:
            number, hunk = int(m[1]), hunk + 1
        elif raw.startswith("+++"):
            path = raw[6:] if raw.startswith("+++ b/") and raw != "+++ b//dev/null" else path
        elif hunk and raw[:1] in ("+", " "):
            kept.append((hunk, number, raw[0] == "+", raw[1:]))
            number += 1
    files.append((path, kept))
    return [(i, p, *x) for i, (p, k) in enumerate(files) if p for x in k]


def a_patch(r):
    out = r.choice([[], ["--- a/first", "+++ b/first", "@@ -1,2 +5,2 @@", " x", "+y"]])
    for _ in range(r.randint(0, 4)):
        name = r.choice(["a.py", "b b/c.js", "d.txt"])
        out.append(f"diff --git a/{name} b/{name}")
        if r.random() < 0.8:
            out += ["index 0..1", f"--- a/{name}", r.choice(["+++ b/", "+++ b/new/"]) + name]
        for _ in range(r.randint(0, 3)):
            out.append(f"@@ -{r.randint(0, 9)},3 +{r.randint(0, 99)}{r.choice(['', ',7'])} @@ ctx")
            out += [r.choice(["+", " ", "-", "", "\\ No newline at end of file", "+++ b/odd", "---x"]) + r.choice(["", "import a", "diff --git a/x b/x"]) for _ in range(r.randint(0, 12))]
    return "\n".join(out)


@pytest.mark.parametrize(("long_patch", "piece"), [(1 << 22, 1 << 16), (0, 1), (0, 3), (150, 7)])
def test_patch_lines(spark, long_patch, piece):
    """Whole patches and patches cut in pieces of one, three and seven lines give what a loop gives."""
    r = random.Random(3)
    patches = {f"s{i}": a_patch(r) for i in range(60)}
    df = spark.createDataFrame([*patches.items(), ("none", None), ("empty", "")], "sha string, patch string")
    got = diff.patch_lines(df, "sha", long_patch, piece).collect()
    want = sorted((s, *x) for s, p in patches.items() for x in lines_by_hand(p))
    assert sorted((x.sha, x.file_no, x.path, x.hunk, x.line_no, x.added, x.text) for x in got) == want
    assert len(want) > 300


def added(spark, path, lines):
    patch = f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -0,0 +1,{len(lines)} @@\n" + "\n".join("+" + x for x in lines)
    return diff.patch_lines(spark.createDataFrame([("s", patch)], "sha string, patch string"))


PY_LINES = [
    "import a", "import a; import b.c as d", "from x import y; z = 1", "  from ..p import q", "from . import q", "from x import (a, b,)", "from x import *", "import a # c; import b", "import a;", "import a;; import b", "import a if", "x = (import a)",
    "s = 'import a'; import b", 's = "a;b"; import c', "import a; s = 'open", "import a; f(", "import a; x = 1 +", "if x: import a", "for i in y: import a; import b", "try: import a", "lambda: 0; import q", "def f(): import a", "from x import", "import", "from import y", "importx", "from x import a as b, c",
    "import a.b.c, d as e , f", "assert 1; from q.w import e # z", "'''doc'''; import z", "@import a", "import a, ", "from .. import (a as b, c)", "return; import a", "a, b = 1, 2; import k", "from __future__ import annotations", "import a.", "class A: import b", "x: int = 3; import t",
]


def test_python_statements_on_a_line(spark):
    """What Python's own parser takes as statements of the line."""
    df = spark.createDataFrame([(x,) for x in PY_LINES], "t string").select("t", grammars.python_targets(F.col("t")).alias("got"))
    for x in df.collect():
        want = []
        try:
            for node in ast.parse(x.t.strip()).body:
                want += [n.name for n in node.names] if isinstance(node, ast.Import) else ["." * node.level + (node.module or "")] if isinstance(node, ast.ImportFrom) else []
        except SyntaxError:
            pass
        assert x.got == want, x.t


def test_python_statements_over_lines(spark):
    lines = ["from x.y import (", "    a,", "    b as c,  # (why)", "", "    d", ")", "import m, \\", "    n", "from broken import (", "    a = 1,", ")", "from open import (", "    a", "import last", "from one import (  # c", "  a)", "x = [", "  import_, ", "]", "from unclosed import ("]
    got = imports.python_imports(added(spark, "a.py", lines)).orderBy("line_no", "ordinal").collect()
    assert [(r.line_no, r.ordinal, r.raw_target) for r in got] == [(1, 0, "x.y"), (7, 0, "m"), (7, 1, "n"), (14, 0, "last"), (15, 0, "one")]


def test_python_statement_with_context(spark):
    """The first line has to be added; context lines may stand between."""
    patch = "diff --git a/a.py b/a.py\n+++ b/a.py\n@@ -1,4 +1,4 @@\n+from new import (\n     a,\n )\n from old import (\n+    b,\n )\n@@ -9 +20 @@\n+from cut import (\n@@ -19 +30 @@\n+    a)\n"
    got = imports.python_imports(diff.patch_lines(spark.createDataFrame([("s", patch)], "sha string, patch string"))).collect()
    assert [(r.line_no, r.raw_target) for r in got] == [(1, "new")]


def test_js_forms(spark):
    lines = ['} from "left-pad";', "import{x}from'y'", "const a=require('p'), b=require('p');", "--changed-files-from\" \"$X\"", "import( 'z' )", "require('open'", "  import \"side\"", "x import 'no'", "export * from 'e' // from 'f'"]
    got = imports.js_imports(added(spark, "src/a.mts", lines)).orderBy("line_no", "ordinal").collect()
    assert [(r.line_no, r.ordinal, r.raw_target) for r in got] == [(1, 0, "left-pad"), (2, 0, "y"), (3, 0, "p"), (3, 1, "p"), (5, 0, "z"), (7, 0, "side"), (9, 0, "e"), (9, 1, "f")]


GRADLE = [
    ("modImplementation \"net.a.b:c:0.92\"", "net.a.b:c"), ("compile 'org.slf4j:api:2.0'", "org.slf4j:api"), ("include implementation(\"com.z:H:7\")", "com.z:H"), ("jarJar(implementation('com.m:j:8'))", "com.m:j"), ('"implementation"(platform("io.n:bom:4"))', "io.n:bom"),
    ("implementation fg.deobf(\"net.c.p:P-1:1.0\")", "net.c.p:P-1"), ("commonTest.dependencies { implementation(libs.kotlin.test) }", "libs.kotlin.test"), ("shotTestImplementation(libs.a.api)", "libs.a.api"), ("implementation group: 'g', name: 'n', version: '1'", "g:n"),
    ("implementation project(':x')", None), ("api(project(path = \":x\"))", None), ("throw GradleException(\"Run :a-api:b:c first\")", None), ("logger.warn(\"implementation org.e:f:1.0\")", None), ("// implementation(\"o:c:1.0\")", None), ("relocate(\"com.g.api\", \"com.m.libs.api\")", None),
    ("apiDocs.set(\"http://l:80/v3\")", None), ("Api 'a:b:1'", None), ("x.implementation('a:b:1')", None), ("implementation foo('a:b:1')", None),
]


def test_gradle(spark):
    for i, (line, package) in enumerate(GRADLE):
        got = [r.package_name for r in manifests.gradle_manifest(added(spark, f"m{i}/build.gradle.kts", [line])).collect()]
        assert got == ([package] if package else []), line


def test_maven_across_hunks_and_management(spark):
    pom = ["<dependencyManagement>", "<dependency>", "<groupId>m</groupId>", "<artifactId>m</artifactId>", "</dependency>", "</dependencyManagement>", "<dependency>", "<groupId>", " g </groupId>", "<artifactId>a</artifactId>", "<version>1</version>", "</dependency>", "<version>9</version>", "<dependency>", "<groupId>x</groupId>"]
    got = manifests.maven_manifest(added(spark, "pom.xml", pom)).collect()
    assert [(r.line_no, r.package_name, r.version_spec) for r in got] == [(7, "g:a", "1")]


def test_events_of_chosen_languages(spark):
    patch = "\n".join(f"diff --git a/{p} b/{p}\n+++ b/{p}\n@@ -0,0 +1,3 @@\n+{t}" for p, t in (("a.py", "import requests"), ("a.ts", "import x from 'y'"), ("requirements.txt", "flask==1"), ("package.json", '"dependencies": {\n+"z": "1"'), ("node_modules/a.py", "import no")))
    lines = diff.patch_lines(spark.createDataFrame([("s", patch)], "sha string, patch string"))
    names = lambda *languages: sorted(r.package_name for r in imports.extract_events(lines, "sha", languages).collect())
    assert names() == ["flask", "requests", "y", "z"]
    assert names("Python") == ["flask", "requests"]
    assert names("TypeScript") == ["y", "z"]
    assert names("JavaScript") == ["z"]


def test_events_are_one_exchange(spark):
    lines = spark.createDataFrame([("s", 1, "a.py", 1, 1, True, "import a")], "sha string, file_no long, path string, hunk int, line_no int, added boolean, text string")
    plan = imports.extract_events(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
    physical = imports.extract_events(lines)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert physical.count("Exchange hashpartitioning") == 1


def test_rendered_statuses(spark):
    files = spark.createDataFrame([("s", "a", 1, ["x"], "modified", None), ("s", "b", 2, ["y"], "removed", None), ("s", "c", 3, ["z"], "renamed", "old"), ("s", "d", 4, None, "renamed", "o"), ("s", "e", 5, ["w"], None, None)], "sha string, path string, ordinal int, lines array<string>, status string, previous_path string")
    lines = diff.patch_lines(diff.render_patches(files)).collect()
    assert sorted((r.path, r.text, r.added) for r in lines) == [("a", "x", True), ("c", "z", True), ("e", "w", True)]


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_patch_lines_are_numbered_in_place(spark):
    """Numbering the lines of patches neither shuffles nor sorts them, and reads the patches once."""
    plan = physical(diff.patch_lines(spark.createDataFrame([("s", "")], "sha string, patch string")))
    assert not [x for x in ("Exchange", "Sort", "Window", "Union") if x in plan]


def test_line_ends_and_odd_headers(spark):
    """All three line ends, a header without a second path, a path of no file, and a hunk before any header."""
    patch = "\r\n".join(["@@ -1 +7 @@", "+++ b/pre", "+x", "diff --git a/only", "+y", "diff --git a/q b/q", "+++ b//dev/null", "@@ -1 +3 @@"]) + "\r+a\n-b\r\n c"
    got = diff.patch_lines(spark.createDataFrame([("s", patch)], "sha string, patch string")).drop("sha", "kind").collect()
    assert sorted(tuple(x) for x in got) == [(0, "pre", 1, 7, True, "x"), (0, "pre", 1, 8, True, "y"), (1, "q", 1, 3, True, "a"), (1, "q", 1, 4, False, "c")]


SCOPED = {
    "package.json": ['  "dependencies": {', '  "devDependencies": {', '    "a": "1",', '    "b": "^2"', "  },", "}", '  "scripts": {'],
    "pyproject.toml": ["[project]", "dependencies = [", '    "a>=1", # x', '  "b"', "]", 'dependencies = ["c", "d>1"]', "[tool.poetry.dependencies]", 'e = "^1"', "# [x]", "[other]"],
    "setup.cfg": ["[options]", "install_requires = f>1", "install_requires =", "    a>=1", "b", "", "[x]", "zip = 1"],
    "Cargo.toml": ["[dependencies]", 'a = "1"', 'b = { version = "2" }', "c.workspace = true", "[dev-dependencies]", "[profile]", 'd.version = "3"'],
    "go.mod": ["require (", "\ta.b/c v1.0.0", "\td.e/f v2 // indirect", ")", "require g.h/i v1", "module x"],
    "pom.xml": ["<dependency>", "<groupId>g</groupId>", "<artifactId>a</artifactId>", "<version>1</version>", "</dependency>", "<dependencyManagement>", "</dependencyManagement>", "<dependency> <groupId>h</groupId> <artifactId>b</artifactId> </dependency>"],
    "build.gradle": ["implementation 'a:b:1'", "api libs.x.y", "// api 'c:d:2'"], "libs.versions.toml": ["[libraries]", 'a = { module = "g:a", version = "1" }', "[plugins]", "x = 1"],
    "requirements.txt": ["a==1", "# b", "-r x", "c"], "a.js": ["import x from 'y'", "const z = require('z'), w = import('w')", "x"], "a.rs": ["use a::b;", "extern crate c;", "fn use_() {}"], "A.java": ["import a.b.C;", "import static d.E.*;", "class import_ {}"],
    "a.go": ["import (", '\t"a/b"', '\t_ "c/d"', ")", 'import "e/f"', 'var x = "y"'],
    "a.py": ["from x import (", "    a,", "    b as c,  # why", ")", "    d)", "import m, \\", "    n", "import z; import y", "from q import r", "x = 1", "", "from .. import (  # c", "from k \\", "  import l", "    = 1,"],
}


def scoped_patch(r):
    out = r.choice([[], ["+++ b/pom.xml", "@@ -1 +7 @@", *["+" + x for x in SCOPED["pom.xml"]]]])
    for name in r.sample(sorted(SCOPED), 4):
        out += [f"diff --git a/{name} b/{name}", f"+++ b/{name}"]
        for at in range(r.randint(1, 3)):
            out.append(f"@@ -1 +{100 * at + r.randint(1, 50)} @@")
            out += [r.choice("++++ -") + r.choice(SCOPED[name]) for _ in range(r.randint(0, 25))]
    return "\n".join(out)


@pytest.mark.parametrize("kinds", [grammars.KINDS, ("py",), ("maven", "js"), ("pyproject", "setup_cfg"), ("js", "rust", "java"), ("gomod", "go", "npm", "cargo", "catalog")])
def test_scopes_say_what_lines_say(spark, kinds):
    """States cut out of a hunk are those that windows over its lines give, broken and interrupted forms too."""
    r = random.Random(str(kinds))
    patches = spark.createDataFrame([(f"s{i}", scoped_patch(r)) for i in range(150)] + [("none", None), ("empty", "")], "sha string, patch string")
    lines, scopes = diff.patch_lines(patches), diff.patch_scopes(patches)
    got, want = (sorted(map(str, grammars.findings(x, "sha", kinds).collect())) for x in (scopes, lines))
    assert got == want and len(want) > 100
    assert {x.kind for x in grammars.findings(scopes, "sha", kinds).select("kind").distinct().collect()} == set(kinds)


def test_scopes_need_no_window(spark):
    """States of all grammars without a window, sort or shuffle of lines."""
    plan = physical(imports.extract_events(diff.patch_scopes(spark.createDataFrame([("s", "")], "sha string, patch string"))))
    assert not [x for x in ("Exchange", "Sort", "Window", "Union") if x in plan]
