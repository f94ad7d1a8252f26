"""Session set-up, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def session(app: str = "strandweave", cpus: int | str = "*", partitions: int | None = None) -> SparkSession:
    """A local session with the settings the tests and the bench use; on a cluster the submitter makes the session."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from the session's settings.

    A temporary folder stands in only under a local master, where there are no other machines.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get(CHECKPOINT_KEY) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="strandweave-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """`df` as computed once and kept in the shared folder: its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def laid(df: DataFrame, *keys: str) -> DataFrame:
    """`df`, cut, with equal `keys` in one partition and in order; later joins by them know it and leave it where it lies.

    An adaptive plan forgets how a checkpoint's rows lie (Spark 4.1), so this one step is planned without.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    was = conf.get(name)
    conf.set(name, "false")
    try:
        return cut(df.repartition(*keys).sortWithinPartitions(*keys))
    finally:
        conf.set(name, was)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def replace_table(df: DataFrame, path: str) -> None:
    """Writes `df` as Parquet to `path`, complete before the table that lies there goes; `df` may read that one.

    The new files are written beside it. The old table is moved aside and deleted once the new one is in place.
    """
    df.write.mode("overwrite").parquet(f"{path}.new")
    jvm = df.sparkSession._jvm
    at = [jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new", f"{path}.old")]
    fs = at[0].getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    fs.delete(at[2], True)
    if fs.exists(at[0]) and not fs.rename(at[0], at[2]) or not fs.rename(at[1], at[0]):
        raise OSError(f"{path} could not be replaced")
    fs.delete(at[2], True)


def join_hot(big: DataFrame, side: DataFrame, keys: list[str], n: str, total: int, parts: int = 1000) -> DataFrame:
    """Left join of `big` with `side`, which has one row per key and in `n` the rows of `big` under it.

    Keys with over total/parts rows are under `parts` in number, which bounds what is broadcast; all other
    keys are small enough for a shuffle. `big` is read twice, so it should be cut first. Nulls match nulls.
    """
    hot = F.broadcast(side.where(F.col(n) > total / parts).drop(n).withColumn("_hot", F.lit(True)))
    cold = side.where(F.col(n) <= total / parts).drop(n)
    values = [c for c in cold.columns if c not in keys]

    def left(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnsRenamed({k: f"_k_{k}" for k in keys})
        on: Column = F.lit(True)
        for k in keys:
            on = on & a[k].eqNullSafe(b[f"_k_{k}"])
        return a.join(b, on, "left").drop(*[f"_k_{k}" for k in keys])

    tried = left(big, hot)
    found = tried.where("_hot").select(*big.columns, *values)
    rest = tried.where("_hot IS NULL").select(*big.columns)
    return found.unionByName(left(rest, cold).select(*big.columns, *values))
