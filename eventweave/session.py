"""Sessions, tables and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("eventweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", _own_folder())
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="eventweave-")
    atexit.register(shutil.rmtree, folder, True)
    return f"file://{folder}"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates: `spark.checkpoint.dir` of the session.

    Where that is unset, a session on one machine gets a temporary folder of its own; on a cluster it is an error, as executors don't share a local disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = getattr(spark.sparkContext, "_eventweave_scratch", None)
        if folder is None:
            folder = spark.sparkContext._eventweave_scratch = _own_folder()
    return folder.rstrip("/")


def _drop(spark: SparkSession, path: str, name: str | None = None) -> None:
    try:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # the session may be gone already
        pass


def materialize(df: DataFrame, name: str = "step", partition_by: list[str] | None = None, bucket_by: str | None = None) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: the lineage ends there, and a lost executor costs no recomputation.

    The files go with `release`, or when the program ends. An empty frame keeps its schema. `bucket_by`: the rows are moved once by this column's hash and
    registered as a bucketed table, so later groupings and joins on it move nothing.
    """
    spark = df.sparkSession
    unique = f"{name}-{uuid.uuid4().hex}"
    path, registered = f"{scratch_dir(spark)}/{unique}", None
    if bucket_by:
        n, registered = int(spark.conf.get("spark.sql.shuffle.partitions")), "eventweave_" + unique.replace("-", "_")
        df.repartition(n, bucket_by).write.bucketBy(n, bucket_by).option("path", path).format("parquet").saveAsTable(registered)
    else:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.table(registered) if registered else spark.read.schema(df.schema).parquet(path)
    out._eventweave_files = (path, registered)
    atexit.register(_drop, spark, path, registered)
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that nothing reads any more."""
    for df in frames:
        if hasattr(df, "_eventweave_files"):
            _drop(df.sparkSession, *df._eventweave_files)
