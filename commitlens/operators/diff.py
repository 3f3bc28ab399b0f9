"""Unified diffs: rendered from rows, and exploded into lines with their numbers by nested splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.functions import paths
from commitlens.functions.ranges import let

#: The places before the lines that begin a file or a hunk; what those lines and a file's `+++` lines say.
FILE_START = r"(?=diff --git a/(?:(?! b/)[^\r\n])*+ b/[^\r\n])(?<![^\r\n])"
HUNK_START = r"(?=@@ -\d+(?:,\d+)? \+\d{1,10}(?:,\d+)? @@)(?<![^\r\n])"
HEADER, NEW_PATH, HUNK = r"^diff --git a/(?:(?! b/)[^\r\n])*+ b/([^\r\n]+)", r"(?:\A|[\r\n])\+\+\+ b/([^\r\n]+)", r"^@@ -\d+(?:,\d+)? \+(\d{1,10})(?:,\d+)? @@"


def patch_lines(patches: DataFrame, key: str = "sha", long_patch: int = 0, piece_lines: int = 0) -> DataFrame:
    """key, file_no, path, kind (of the file's grammar), hunk, line_no (in the new file), added, text for every line that the
    new file has.

    A file's path is the last `+++ b/` seen in it, else the header's; lines before its first hunk, removed lines, headers and
    bare empty lines are neither kept nor counted. A patch is cut before the lines that begin a file, a file before those that
    begin a hunk, and a hunk into its lines: the numbers are places in these lists, so nothing is shuffled or sorted and
    patches are read once, long ones too. long_patch and piece_lines have no effect any more.
    """
    hunks = _files(patches, key).select(key, "file_no", "path", "kind", "begins", F.posexplode(F.split("file", HUNK_START)).alias("j", "lines"))
    hunks = hunks.select(key, "file_no", "path", "kind", (F.col("j") + F.col("begins")).alias("hunk"), "lines").filter("hunk > 0")
    lines = hunks.select(key, "file_no", "path", "kind", "hunk", _start(F.col("lines")).alias("start"), F.posexplode(_kept(F.col("lines"))).alias("k", "raw"))
    return lines.select(key, "file_no", "path", "kind", "hunk", (F.col("start") + F.col("k")).cast("int").alias("line_no"), F.col("raw").startswith("+").alias("added"), F.substring("raw", 2, 1 << 30).alias("text"))


def patch_scopes(patches: DataFrame, key: str = "sha") -> DataFrame:
    """key, file_no, path, kind, scope (array of line_no, added, text, s: trimmed): the lines of patch_lines, a row for each hunk,
    of a POM for each file. Only files that have a grammar."""
    whole = F.col("kind") == "maven"
    files = _files(patches, key).filter("kind is not null")
    # what a lambda uses of a hunk comes out of the generator, as else it would be worked out for each line
    hunk = lambda h, j, start: F.struct(j.alias("j"), start.alias("start"), h.alias("part"))
    parts = F.when(whole, F.array(hunk(F.col("file"), F.lit(1), F.lit(0)))).otherwise(F.transform(F.split("file", HUNK_START), lambda h, j: hunk(h, j, _start(h))))
    parts = files.select(key, "file_no", "path", "kind", "begins", F.explode_outer(parts).alias("x")).select(key, "file_no", "path", "kind", "begins", "x.*").filter("j + begins > 0")

    def numbered(part: Column, start: Column) -> Column:
        line = lambda no, added, text: F.struct(no.cast("int").alias("line_no"), added.alias("added"), text.alias("text"), F.trim(text, F.lit(paths.BLANKS)).alias("s"))
        return F.transform(_kept(part), lambda x, k: line(start + k, x.startswith("+"), F.substring(x, 2, 1 << 30)))

    hunks = F.filter(F.split("part", HUNK_START), lambda _, j: j + F.col("begins") > 0)
    pom = F.flatten(F.transform(hunks, lambda h: let(_start(h), lambda n: numbered(h, n))))
    return parts.select(key, "file_no", "path", "kind", F.when(whole, pom).otherwise(numbered(F.col("part"), F.col("start"))).alias("scope"))


def _files(patches: DataFrame, key: str) -> DataFrame:
    """key, file_no, file (its part of the patch), path, kind, begins (1 if a hunk stands before the first header)."""

    def one(file: Column, i: Column) -> Column:
        path = F.coalesce(F.try_element_at(F.filter(F.regexp_extract_all(file, F.lit(NEW_PATH), F.lit(1)), lambda p: p != "/dev/null"), F.lit(-1)), F.nullif(F.regexp_extract(file, HEADER, 1), F.lit("")))
        return let(path, lambda p: F.struct(i.alias("i"), file.alias("file"), p.alias("path"), paths.kind_of(p).alias("kind")))

    # path and kind come out of the generator, as else a filter on them would work them out once more
    starts = F.col("patch").rlike(HEADER).cast("int").alias("starts")
    files = patches.select(key, starts, F.explode_outer(F.transform(F.split("patch", FILE_START), one)).alias("x")).select(key, "starts", "x.*").filter("path is not null")
    files = files.select(key, (F.col("i") + F.col("starts")).cast("long").alias("file_no"), "file", "path", "kind")  # what stands before the first header is file 0
    return files.withColumn("begins", ((F.col("file_no") == 0) & F.col("file").rlike(HUNK)).cast("int"))


def _start(hunk: Column) -> Column:
    return F.nullif(F.regexp_extract(hunk, HUNK, 1), F.lit("")).cast("int")


def _kept(hunk: Column) -> Column:
    """The hunk's lines that the new file has, with their sign."""
    return F.filter(F.split(hunk, r"\r\n|\r|\n"), lambda x: x.startswith(" ") | (x.startswith("+") & ~x.startswith("+++")))


def npm_package(target):
    """Package of an import target: two segments with a scope, else one; null for paths, aliases and other protocols."""
    local = target.rlike(r"^(\.|/|#|@/|~/|\$|@workspace/|@repo/|@packages/)|^[A-Za-z][A-Za-z0-9+.-]*:")
    return F.when(~local, F.when(target.startswith("@"), F.substring_index(target, "/", 2)).otherwise(F.substring_index(target, "/", 1)))


def _file_patch(path: Column, lines: Column, status: Column, old: Column) -> Column:
    """A file's part of a unified diff; a file without lines has a header only."""
    n, text = F.size(lines).cast("string"), F.lit
    mode = F.when(status == "added", "new file mode 100644\nindex 0000000..1111111\n").when(status == "removed", "deleted file mode 100644\nindex 1111111..0000000\n").when(status == "renamed", F.concat(text("rename from "), old, text("\nrename to "), path, text("\n"))).otherwise("index 1111111..2222222 100644\n")
    head = F.concat(text("diff --git a/"), old, text(" b/"), path, text("\n"), mode)
    sides = F.concat(F.when(status == "added", "--- /dev/null\n").otherwise(F.concat(text("--- a/"), old, text("\n"))), F.when(status == "removed", "+++ /dev/null\n").otherwise(F.concat(text("+++ b/"), path, text("\n"))))
    hunk = F.when(status == "removed", F.concat(text("@@ -1,"), n, text(" +0,0 @@\n"))).otherwise(F.concat(text("@@ -0,0 +1,"), n, text(" @@\n")))
    sign = F.when(status == "removed", "-").otherwise("+")
    body = F.concat(sides, hunk, F.array_join(F.transform(lines, lambda x: F.concat(sign, x)), "\n"))
    return F.concat(head, F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, body).otherwise(""))


def added_files(*files: tuple[str, Column]) -> Column:
    """One unified diff that adds files (path, lines), in this order: for rows that hold all of a commit. A file whose lines
    are null is left out."""
    part = lambda path, lines: let(lines, lambda x: F.when(x.isNotNull(), _file_patch(F.lit(path), x, F.lit("added"), F.lit(path))))
    return F.concat_ws("\n", *[part(path, lines) for path, lines in files])


def render_patches(files: DataFrame, key: str = "sha") -> DataFrame:
    """One unified diff for each key from files (key, path, ordinal, lines: array of texts). An optional column status says
    added (the default), modified, removed or renamed (with previous_path); a file without lines has a header only."""
    status = F.coalesce("status", F.lit("added")) if "status" in files.columns else F.lit("added")
    old = F.coalesce("previous_path", "path") if "previous_path" in files.columns else F.col("path")
    chunk = _file_patch(F.col("path"), F.col("lines"), status, old)
    return files.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("ordinal", chunk.alias("c"))))["c"], "\n").alias("patch"))


def changed_languages(lines: DataFrame, language, key: str = "sha") -> DataFrame:
    """Languages of research paths with an added line, in the fixed order, as a text."""
    found = lines.filter(F.col("added") & paths.is_research_path(F.col("path"))).withColumn("l", language).filter("l is not null")
    seen = found.groupBy(key).agg(*[F.bool_or(F.col("l") == x).alias(x) for x in paths.LANGUAGES])  # one buffer of fixed size for a key
    return seen.select(key, F.concat_ws(";", *[F.when(F.col(x), x) for x in paths.LANGUAGES]).alias("languages"))
