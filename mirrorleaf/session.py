"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# HTML rows are large, so few of them go into one Arrow batch; AQE splits
# partitions that a hot site makes too big.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.session.timeZone": "UTC",
}

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold some megabytes of text, unless it has set a limit.

    A number of rows alone bounds nothing: a worker holds a batch several times over.
    """
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_BYTES)


def build_session(app: str = "mirrorleaf", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**TUNING, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a session with a
    local master, where one machine is all there is, may do without the setting.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="mirrorleaf-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store_table(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage ends there. Also gives the folder."""
    folder = work_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def persist_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``store_table`` for a table that results are read from later, so it stays."""
    return store_table(spark, df, name)[0]


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a stored table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def folder_exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def local_folder(spark: SparkSession, folder: str) -> str | None:
    """The path of a folder that any process may open as files, None if it is in another store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    address = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return address.getPath() if address.getScheme() == "file" else None
