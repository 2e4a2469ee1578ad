"""Sessions, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the local bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only in a local session without that setting. On a
    cluster each executor would write to its own disk, and what is read back would lack rows."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", named)
        _drop_at_exit(spark, named)
    return named


def _drop_at_exit(spark: SparkSession, folder: str) -> None:
    def drop() -> None:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may be gone already
            pass

    atexit.register(drop)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder, dropped when the process ends."""
    folder = f"{_shared_folder(spark)}/lodestone-{label}-{uuid.uuid4().hex}"
    _drop_at_exit(spark, folder)
    return folder


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and a lost executor costs no recomputation."""
    spark = df.sparkSession
    folder = scratch(spark, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
