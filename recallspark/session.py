"""Session settings, and the few helpers that touch the session itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "recallspark", memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benches. A cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a session that names none (a test, a laptop) gets a temporary folder,
    and only when it runs in local mode: on a cluster a driver-local path would
    be lost with the driver and invisible to executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    made = tempfile.mkdtemp(prefix="recallspark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def settle(df: DataFrame) -> DataFrame:
    """Write a step to shared storage and read it back.

    Later steps then start from files that outlive any executor, plan against
    real sizes (so a join is broadcast only if the written side is small), and
    never repeat the work.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/settled/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
