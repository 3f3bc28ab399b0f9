"""Version texts as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from commitlens.functions.ranges import let

#: Prefixes of specs that name no registry version.
PRIVATE = ("file:", "link:", "workspace:", "path:", "git:", "git+", "github:", "../", "./", "/")
EXACT = r"^v?\d+\.\d+(\.\d+(\.\d+)?)?([-+][0-9A-Za-z.+-]+)?$"


def normalize_package(ecosystem: Column, package: Column) -> Column:
    """PyPI: runs of - _ . become one -, lower case; npm and Cargo: lower case; others as they are."""
    return F.when(ecosystem == "PyPI", F.lower(F.regexp_replace(package, "[-_.]+", "-"))).when(ecosystem.isin("npm", "Cargo"), F.lower(package)).otherwise(package)


def is_private_spec(spec: Column) -> Column:
    return spec.rlike("(?i)^(" + "|".join(map(re.escape, PRIVATE)) + r")|\{ path")


def bare_spec(ecosystem: Column, spec: Column) -> Column:
    """A spec without quotes around it and, for PyPI, without the environment marker after a semicolon."""
    spec = F.trim(F.coalesce(spec, F.lit("")))
    cut = F.when((ecosystem == "PyPI") & F.contains(spec, F.lit(";")), F.trim(F.substring_index(spec, ";", 1))).otherwise(spec)
    quoted = F.contains(cut, F.lit('"')) | F.contains(cut, F.lit("'"))
    return F.when(quoted, F.regexp_replace(F.regexp_replace(cut, "^\"+|\"+$", ""), "^'+|'+$", "")).otherwise(cut)


def kind_of_bare(ecosystem: Column, bare: Column) -> Column:
    exact = F.when(ecosystem == "PyPI", bare.rlike(r"^={2,3}\s*[^,;\s]+$") | bare.rlike(EXACT)).when(ecosystem == "Cargo", bare.rlike("^=") & F.regexp_replace(bare, r"^=\s*", "").rlike(EXACT)).otherwise(bare.rlike(EXACT))
    return F.when(bare == "", "name_only").when(is_private_spec(bare), "excluded").when(F.contains(bare, F.lit("${")) | bare.startswith("libs."), "name_only").when(exact, "exact").otherwise("range")


def query_kind(ecosystem: Column, spec: Column) -> Column:
    """exact, range, name_only or excluded. PyPI: == and === with one text are exact, a prefix (==1.*) too."""
    return let(bare_spec(ecosystem, spec), lambda bare: kind_of_bare(ecosystem, bare))


def exact_form(version: Column) -> Column:
    """For equality: trimmed, lower case, without v before a digit."""
    return F.regexp_replace(F.lower(F.trim(version)), r"^v(?=\d)", "")


def release_key(version: Column) -> Column:
    """Numbers of a plain release, without trailing zeros, as an array that sorts; null for anything else."""
    plain = exact_form(version)
    parts = F.transform(F.split(F.regexp_replace(plain, r"(\.0+)+$", ""), r"\."), lambda x: x.try_cast("long"))
    return F.when(plain.rlike(r"^\d{1,15}(\.\d{1,15})*$"), parts)


def value_of_bare(ecosystem: Column, bare: Column, kind: Column) -> Column:
    op = F.when(ecosystem == "PyPI", F.regexp_replace(bare, r"^={2,3}\s*", "")).when(ecosystem == "Cargo", F.regexp_replace(bare, r"^=\s*", "")).otherwise(bare)
    return F.when(kind == "exact", op).when(kind == "range", bare).otherwise("")


def query_value(ecosystem: Column, spec: Column, kind: Column) -> Column:
    """What is asked of the registry: an exact version without its operator, a range as it is, else nothing."""
    return let(bare_spec(ecosystem, spec), lambda bare: value_of_bare(ecosystem, bare, kind))
