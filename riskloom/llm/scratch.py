"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """The folder of this application under spark.checkpoint.dir.

    The setting is read from the session. Only where it is unset, as in tests
    on one machine, a temporary folder is chosen and kept in the session; on a
    cluster, whose machines share no such folder, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="riskloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/riskloom-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A path that no one has used; it goes when the session's JVM ends."""
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The setting has this value in here."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffles_dropped(spark: SparkSession):
    """Writes in here delete their shuffle files at their end."""
    return setting(spark, _CLEANUP, "true")


def materialise(df: DataFrame, tag: str, batch: int | None = None) -> DataFrame:
    """Write df once as Parquet and read it back.

    It cuts the lineage, so a lost executor costs one re-read, and it freezes
    values such as partition numbers that a recomputation could change. The
    shuffle files of the write are deleted with its end: nothing reads them.
    `batch` bounds the rows that Python workers get at a time, for wide rows.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    with shuffles_dropped(spark), setting(spark, _BATCH, str(batch)) if batch else nullcontext():
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table of materialise() that nothing reads any more."""
    drop_path(df.sparkSession, df.written_to)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of new_path()."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
