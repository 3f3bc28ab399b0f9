"""Intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes of a side that is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="commitlens-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: the lineage ends there, and a lost
    executor costs a re-read. Spark's commit protocol makes a retried task's output appear once."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Does counting prove that df, a materialised table, has at most so many rows and bytes (as JSON)?"""
    n = df.limit(rows + 1).count()
    return n <= rows and (df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) + 16 * n <= most


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is small; else as it is, and its joins shuffle."""
    return F.broadcast(df) if is_small(df, rows, most) else df


#: Most rows of a task that makes patches of them.
DEALT_ROWS = 100_000


def parts(df: DataFrame, rows: int = DEALT_ROWS) -> int:
    """How many partitions hold at most about so many rows of df, a stored table, each; the session's number at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def dealt_rows(*tables: DataFrame, rows: int = DEALT_ROWS) -> int:
    """How many partitions hold at most about so many rows each of stored tables below each other; the session's number at least."""
    return max(int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sum(df.count() for df in tables) // rows))


def dealt(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """df, a stored table of narrow rows, dealt out by keys in as many partitions as its rows need. What is grouped, joined or
    made into texts by these keys afterwards stays where it is, so that the texts are never shuffled, and no task grows
    with the table."""
    return df.repartition(n or parts(df), *keys)


@contextmanager
def co_located(spark: SparkSession) -> Iterator[None]:
    """While it lasts, joins by several columns take both sides as they lie if they are dealt out alike by some of these; Spark
    would otherwise shuffle them once more by all. For actions inside only."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize wrote, once nothing that is still to run reads them."""
    for df in tables:
        spark = df.sparkSession
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getParent().getName() == spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark)).getName():
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
