"""Versioned snapshots of all tables in a shared folder.

A snapshot is a folder of Parquet tables; the one-row ``_manifest`` is written
last, so a version that failed halfway is never read. State changes by writing
the next version, as there is one writer per store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recallspark.schema import TABLES, RecallError

PREFIX = "version="
MANIFEST = "_manifest"


def _folder(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, root: str) -> list[str]:
    """Complete versions, newest first; a folder listing, one name per version."""
    files, path = _folder(spark, root)
    if not files.exists(path):
        return []
    child = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in files.listStatus(path)]
    return sorted(
        (n[len(PREFIX):] for n in names
         if n.startswith(PREFIX) and files.exists(child(f"{root}/{n}/{MANIFEST}/_SUCCESS"))), reverse=True)


def publish(tables: dict[str, DataFrame], root: str, stamp: str, keep: int = 7) -> str:
    """Write one version, each table laid out by project, and drop all but the newest ``keep``."""
    spark = next(iter(tables.values())).sparkSession
    if stamp in versions(spark, root):
        raise RecallError(f"version {stamp} exists already")
    base = f"{root}/{PREFIX}{stamp}"
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if "project_id" in df.columns:
            writer = writer.partitionBy("project_id")
        writer.parquet(f"{base}/{name}")
    spark.createDataFrame([(name,) for name in sorted(tables)], "name string").coalesce(1).write.mode(
        "overwrite").parquet(f"{base}/{MANIFEST}")
    prune(spark, root, keep)
    return base


def load(spark: SparkSession, root: str, stamp: str | None = None) -> dict[str, DataFrame]:
    """Tables of one version, the newest by default."""
    known = versions(spark, root)
    if not known or (stamp is not None and stamp not in known):
        raise RecallError(f"no snapshot {stamp or ''} under {root}")
    base = f"{root}/{PREFIX}{stamp or known[0]}"
    names = [r["name"] for r in spark.read.parquet(f"{base}/{MANIFEST}").collect()]
    # An empty table has no file to take a schema from.
    return {
        name: (spark.read.schema(TABLES[name]) if name in TABLES else spark.read).parquet(f"{base}/{name}")
        for name in names
    }


def prune(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Remove all complete versions but the newest ``keep``; below one, none."""
    if keep < 1:
        return []
    files, _ = _folder(spark, root)
    child = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    stale = versions(spark, root)[keep:]
    for stamp in stale:
        files.delete(child(f"{root}/{PREFIX}{stamp}"), True)
    return stale


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def history(revisions: DataFrame, project: str) -> DataFrame:
    """Prior bodies of one project's records, newest first."""
    return revisions.where(F.col("project_id") == project).orderBy(F.col("revised_at").desc(), "memory_id")
