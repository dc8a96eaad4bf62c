"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of this session's own only in local mode, where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="lodegraph-")
        shared_dir.own = path
    if not re.match(r"\w+:", path) and spark.sparkContext.master.split("[")[0] != "local":
        # without a scheme Spark means its default file system: name it, so that Python workers mean the same one
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        path = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return path.rstrip("/")


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The store that a URI names, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri)) if re.match(r"\w+:", uri) else (fs.LocalFileSystem(), uri)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and any executor can read it again."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z only; lower() would also change other letters, so it is left to texts of ASCII alone."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(doc_id: Column, text: Column) -> Column:
    """Rows with equal id and text are one row to the operators; never null. The id itself is part of it, so a chance
    equality of hashes could only join rows of one id."""
    return F.struct(doc_id.alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))
