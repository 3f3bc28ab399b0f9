"""Scans and sinks: contracted CSV, patches, JSON evidence, registry payloads, commit records, content-addressed payloads."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Fields that an evidence record needs, and types of evidence.
EVIDENCE_TYPES = ("registry", "advisory")
REQUIRED = ("source", "ecosystem", "package_name", "lookup_status", "queried_at")
EVIDENCE_SCHEMA = (
    "evidence_type string, source string, ecosystem string, package_name string, lookup_status string, queried_at timestamp, error string, query_kind string, query_value string, "
    "versions array<struct<version:string,published_at:timestamp>>, advisories array<struct<id:string,published:timestamp,withdrawn:timestamp,hydration_status:string,is_malicious:boolean>>, _corrupt_record string"
)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV whose header must be the schema's columns; quoted line breaks are kept and NUL characters dropped.
    A header that differs fails the read."""
    df = spark.read.csv(path, schema=schema, header=True, enforceSchema=False, multiLine=True, quote='"', escape='"', mode="FAILFAST", encoding="UTF-8")
    return df.select(*[F.translate(c, "\x00", "").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def read_patches(spark: SparkSession, index: DataFrame, folder: str) -> DataFrame:
    """The index (patch_path, relative to folder) with its patches, read from all folders below; a commit without its file
    is left out. Paths are compared decoded, whole, below the folder."""
    files = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("at"), F.col("value").alias("patch"))
    base = "/" + folder.split("://")[-1].strip("/") + "/"
    files = files.select(F.substring_index("at", base, -1).alias("file"), "patch")
    clean = F.regexp_replace(F.replace("patch_path", F.lit("\\"), F.lit("/")), r"^(\./|/)+", "")
    return index.withColumn("file", clean).join(files, "file").drop("file")


def scan_index(index: DataFrame, max_rows: int | None = None, order: str = "pos") -> DataFrame:
    """Usable rows of a commit index; max_rows of them, in order, if given."""
    ok = index.filter("status = 'ok'")
    return ok if max_rows is None else ok.orderBy(order).limit(max_rows)


def read_evidence(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Evidence records of JSON lines, and rejects with why."""
    raw = spark.read.schema(EVIDENCE_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return split_evidence(raw)


def split_evidence(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    why = F.lit(None).cast("string")
    for c in reversed(REQUIRED):
        why = F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", f"missing_{c}").otherwise(why)
    why = F.when(F.col("_corrupt_record").isNotNull(), "not_an_object").when(F.coalesce(F.col("evidence_type").isin(*EVIDENCE_TYPES), F.lit(False)), why).otherwise("unknown_type")
    marked = raw.withColumn("reject_reason", why)
    return marked.filter("reject_reason is null").drop("reject_reason", "_corrupt_record"), marked.filter("reject_reason is not null")


def flatten_registry(payloads: DataFrame) -> DataFrame:
    """ecosystem, package_name, version, published_at out of raw registry answers (ecosystem, package_name, payload).

    npm: time by version, or versions alone; PyPI: the earliest upload of each release; Cargo: versions with created_at;
    Maven: documents with v and a time in milliseconds; Go: Version and Time, one record or an array of them.
    """
    p = payloads.select("ecosystem", "package_name", "payload")
    form = (
        "struct<time:map<string,string>,versions:map<string,struct<name:string>>,releases:map<string,array<struct<upload_time_iso_8601:string,upload_time:string>>>>",
        "struct<versions:array<struct<num:string,created_at:string>>>", "struct<response:struct<docs:array<struct<v:string,timestamp:bigint>>>>", "array<struct<Version:string,Time:string>>",
    )
    when = lambda c: F.try_to_timestamp(c)
    one = p.filter("ecosystem in ('npm', 'PyPI')").withColumn("j", F.from_json("payload", form[0]))
    timed = F.filter(F.map_entries("j.time"), lambda e: ~e["key"].isin("created", "modified"))
    npm_list = F.when(F.size("j.time") > 0, F.transform(timed, lambda e: F.struct(e["key"].alias("version"), when(e["value"]).alias("published_at"))))
    bare = F.transform(F.map_keys("j.versions"), lambda v: F.struct(v.alias("version"), F.lit(None).cast("timestamp").alias("published_at")))
    first = lambda files: F.array_min(F.transform(files, lambda f: when(F.coalesce(f["upload_time_iso_8601"], f["upload_time"]))))
    pypi = F.transform(F.map_entries("j.releases"), lambda e: F.struct(e["key"].alias("version"), first(e["value"]).alias("published_at")))
    parts = [one.select("ecosystem", "package_name", F.inline(F.when(F.col("ecosystem") == "PyPI", pypi).otherwise(F.coalesce(npm_list, bare))))]
    cargo = p.filter("ecosystem = 'Cargo'").withColumn("j", F.from_json("payload", form[1]))
    parts.append(cargo.select("ecosystem", "package_name", F.inline(F.transform("j.versions", lambda v: F.struct(v["num"].alias("version"), when(v["created_at"]).alias("published_at"))))))
    maven = p.filter("ecosystem = 'Maven'").withColumn("j", F.from_json("payload", form[2]))
    parts.append(maven.select("ecosystem", "package_name", F.inline(F.transform("j.response.docs", lambda v: F.struct(v["v"].alias("version"), F.timestamp_millis(v["timestamp"]).alias("published_at"))))))
    go = p.filter("ecosystem = 'Go'").withColumn("j", F.from_json("payload", form[3]))
    parts.append(go.select("ecosystem", "package_name", F.inline(F.transform("j", lambda v: F.struct(v["Version"].alias("version"), when(v["Time"]).alias("published_at"))))))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.filter("version <> ''")


def explode_commit_files(commits: DataFrame, key: str = "sha") -> DataFrame:
    """One row for each (filename, previous_filename, status) of a commit's pages (files: array of structs): the first, by
    page if there is such a column, then by place."""
    page = F.col("page") if "page" in commits.columns else F.lit(0)
    f = commits.select(key, page.alias("_page"), F.posexplode("files").alias("_pos", "f"))
    names = ["filename", "previous_filename", "status"]
    f = f.groupBy(key, *[F.col(f"f.{n}").alias(n) for n in names]).agg(F.min_by("f", F.struct("_page", "_pos")).alias("f")).select(key, "f.*")
    return f.withColumn("has_patch", F.coalesce(F.col("patch") != "", F.lit(False)))


def land_raw_items(items: DataFrame) -> DataFrame:
    """The first item of each repo_sha by seq, with the month of its window, to be written partitioned by month."""
    rest = [c for c in items.columns if c != "repo_sha"]
    return items.groupBy("repo_sha").agg(F.min_by(F.struct(*rest), "seq").alias("f")).select("repo_sha", "f.*").withColumn("month", F.date_format("window_start", "yyyy-MM"))


def payload_store(evidence: DataFrame) -> DataFrame:
    """payload_sha256, payload: one row for each digest. The digest is taken here, so two payloads cannot share one unnoticed."""
    return evidence.select(F.sha2("payload", 256).alias("payload_sha256"), "payload").groupBy("payload_sha256").agg(F.min("payload").alias("payload"), F.count("*").alias("n_rows"))


def used_evidence(evidence: DataFrame, episodes: DataFrame) -> DataFrame:
    """Evidence that some episode names in evidence_ids."""
    return evidence.join(episodes.select(F.explode("evidence_ids").alias("evidence_id")).distinct(), "evidence_id", "left_semi")


def write_table(df: DataFrame, path: str, key: list[str], fmt: str = "parquet") -> None:
    """Writes a new table, or nothing: an empty or a repeated key and a path that exists are refused.

    One job: rows meet by key once, and what is checked is counted while they are written to a folder beside path, which
    takes the name path only if the counts are clean. Renaming fails where path exists, so of two writers one wins.
    """
    spark = df.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs
    target, staged = fs.Path(path), fs.Path(f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}")
    folder = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if folder.exists(target):
        raise ValueError(f"not written: {path} exists")
    empty = F.exists(F.array(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]), lambda x: x == "")
    counted, again = Observation(), F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    rows = df.withColumn("_again", again > 1).observe(counted, F.count_if(empty).alias("empty_key"), F.count_if("_again").alias("duplicate_key")).drop("_again")
    try:
        rows.write.format(fmt).mode("errorifexists").save(staged.toString())
        bad = {rule: n for rule, n in counted.get.items() if n}
        if bad:
            raise ValueError(f"not written: {bad}")
        none = spark._sc._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            fs.FileContext.getFileContext(folder.getUri(), spark._jsc.hadoopConfiguration()).rename(staged, target, none)
        except Py4JJavaError as e:
            raise ValueError(f"not written: {path} exists") from e
    finally:
        folder.delete(staged, True)
