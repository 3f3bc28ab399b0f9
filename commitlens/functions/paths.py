"""What a path says: research scope, language, ecosystem, kind of manifest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path segments outside the study; suffixes of source languages; ecosystems and grammars of languages; manifests by file name.
OUTSIDE = ("node_modules", "vendor", "vendored", "generated")
SUFFIXES = {
    "TypeScript": (".ts", ".tsx", ".mts", ".cts"), "JavaScript": (".js", ".jsx", ".mjs", ".cjs"), "Python": (".py", ".pyw"), "Rust": (".rs",), "Go": (".go",), "Java": (".java",),
}
#: The order in which languages are told.
LANGUAGES = ("TypeScript", "Python", "JavaScript", "Rust", "Go", "Java")
ECOSYSTEMS = {"TypeScript": "npm", "JavaScript": "npm", "Python": "PyPI", "Rust": "Cargo", "Go": "Go", "Java": "Maven"}
LANGUAGE_KIND = {"TypeScript": "js", "JavaScript": "js", "Python": "py", "Rust": "rust", "Go": "go", "Java": "java"}
MANIFESTS = {
    "package.json": "npm", "pyproject.toml": "pyproject", "setup.cfg": "setup_cfg", "cargo.toml": "cargo", "go.mod": "gomod", "pom.xml": "maven",
    "build.gradle": "gradle", "build.gradle.kts": "gradle", "libs.versions.toml": "catalog",
}
#: What is cut off both ends of a line.
BLANKS = " \t\n\x0b\f\r"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_research_path(path: Column) -> Column:
    plain = F.substring_index(F.translate(F.lower(path), "\\", "/"), "?", 1)
    return ~F.arrays_overlap(F.split(plain, "/"), F.array(*[F.lit(s) for s in OUTSIDE]))


def source_language(path: Column) -> Column:
    """Language of a file by its suffix, which is no file name of its own."""
    suffix = F.regexp_extract(F.substring_index(F.lower(path), "?", 1), r"[^/](\.[^./]+)$", 1)
    return F.element_at(F.create_map(*[F.lit(x) for lang, ends in SUFFIXES.items() for e in ends for x in (e, lang)]), suffix)


def ecosystem(language: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in ECOSYSTEMS.items() for x in kv]), language)


def manifest_kind(path: Column) -> Column:
    """Kind of the manifest at path, by its name in lower case; requirements*.txt counts as requirements; null for other files."""
    known = F.element_at(F.create_map(*[F.lit(x) for kv in MANIFESTS.items() for x in kv]), F.lower(basename(path)))
    return F.coalesce(known, F.when(F.lower(basename(path)).rlike(r"^requirements.*\.txt$"), "requirements"))


def kind_of(path: Column) -> Column:
    """The grammar of a file: that of its manifest, or of its language."""
    by_language = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE_KIND.items() for x in kv]), source_language(path))
    return F.coalesce(manifest_kind(path), by_language)
