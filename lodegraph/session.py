"""Session settings that the library's plans expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build(app: str = "lodegraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive plans; further settings by keyword, dots as double underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of this session's own only in local mode, where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="lodegraph-")
        shared_folder.own = folder
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, where its lineage ends: it is worked out once, and any executor can read it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
