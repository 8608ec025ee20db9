"""Session settings the jobs rely on, and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}
#: The session setting for how many files a task holds open when it writes folders; with more values it sorts the rest.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
OPEN_FILES = "4"


def build_session(app: str = "rollframe", master: str | None = None, shuffle_partitions: int | None = None):
    """A session for tests and benches; on a cluster the submitted settings win."""
    b = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in RUNTIME_CONF.items():
        b = b.config(k, v)
    return b.getOrCreate()


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the session's JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as the cluster names it.

    Only a session that names none (a local test) gets a fresh local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="rollframe-")
    remove_at_exit(spark, path)
    return path


def _write_folders(df: DataFrame, path: str, by: tuple[str, ...]) -> None:
    """A folder per value of ``by``; the few files of a task are open at once, so that nothing is sorted by them."""
    spark = df.sparkSession
    before = spark.conf.get(WRITERS, None)
    spark.conf.set(WRITERS, OPEN_FILES)
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(WRITERS)
        else:
            spark.conf.set(WRITERS, before)


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Write a narrow table to the shared folder, in one folder per value of ``by``, and read it back.

    For a result that several later steps read: they scan its columns instead
    of each working the whole plan out again, and a lost executor costs a
    re-read.  The folder goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/rollframe-{uuid.uuid4().hex}"
    if by:
        _write_folders(df, path, by)
    else:
        df.write.parquet(path)
    remove_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def forget(cut_table: DataFrame, part: str = "") -> None:
    """Delete a table that ``cut`` wrote, or one of its parts (``column=value``), once nothing reads it any more."""
    spark = cut_table.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{cut_table.cut_path}/{part}" if part else cut_table.cut_path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
