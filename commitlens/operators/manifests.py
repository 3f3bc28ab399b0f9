"""Declared dependencies in the added lines of manifests, one operator for each kind of file.

Every operator returns key, path, line_no, ordinal, package_name, version_spec, status, reasons.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.operators.grammars import MANIFEST_ECOSYSTEM, findings


def manifest_additions(lines: DataFrame, key: str = "sha", kinds: tuple[str, ...] = tuple(MANIFEST_ECOSYSTEM)) -> DataFrame:
    """Dependencies that manifests of the given kinds newly declare."""
    return findings(lines, key, kinds).select(key, "path", "line_no", "ordinal", F.col("target").alias("package_name"), F.col("spec").alias("version_spec"), "status", "reasons")


#: The operator of each kind of manifest.
GRAMMARS: dict[str, Callable[..., DataFrame]] = {kind: partial(manifest_additions, kinds=(kind,)) for kind in MANIFEST_ECOSYSTEM}
npm_manifest = GRAMMARS["npm"]
pip_manifest = GRAMMARS["requirements"]
pyproject_manifest = GRAMMARS["pyproject"]
setupcfg_manifest = GRAMMARS["setup_cfg"]
cargo_manifest = GRAMMARS["cargo"]
gomod_manifest = GRAMMARS["gomod"]
maven_manifest = GRAMMARS["maven"]
gradle_manifest = GRAMMARS["gradle"]
catalog_manifest = GRAMMARS["catalog"]
