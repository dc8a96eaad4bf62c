"""Stored tables of the graph: append, replace, update by key (all three by manifest), get-or-create, golden sets, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.functions.stemming import stem
from lodegraph.sources.manifest import ManifestTable

GOLDEN = "repo_url string, cases array<struct<id:string,question:string,expected_paths:array<string>,optional_paths:array<string>,expected_keywords:array<string>,notes:string>>"


def append(rows: DataFrame, path: str, partition: str = "repo_id") -> None:
    ManifestTable(rows.sparkSession, path, partition).append(rows)


def replace(rows: DataFrame, path: str, partition: str = "repo_id") -> None:
    """Rows instead of all that their partitions hold; others stay. Running it twice changes nothing, and a run that
    fails leaves what was there."""
    ManifestTable(rows.sparkSession, path, partition).replace(rows)


def update(changes: DataFrame, path: str, key: str, partition: str = "repo_id") -> None:
    """Columns of changes that are not null, into the rows of equal key; only partitions that have such rows are written."""
    ManifestTable(changes.sparkSession, path, partition).update(changes, key)


def read(spark: SparkSession, path: str, partition: str = "repo_id", values: list | None = None) -> DataFrame:
    return ManifestTable(spark, path, partition).read(values=values)


def get_or_create(repos: DataFrame, urls: DataFrame) -> DataFrame:
    """The newest row of each url, and a pending one for urls that have none. repos: id, url, status, created_at."""
    newest = repos.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy(F.col("created_at").desc(), "id"))).where("_n = 1").drop("_n")
    wanted = urls.select("url").distinct()
    fresh = wanted.join(newest, "url", "left_anti").select(F.sha2("url", 256).alias("id"), "url", F.lit("pending").alias("status"), F.lit(None).cast("timestamp").alias("created_at"))
    return newest.join(wanted, "url", "left_semi").select("id", "url", "status", "created_at").unionByName(fresh)


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """One row a case of a golden-set file."""
    return spark.read.schema(GOLDEN).option("multiLine", True).json(path).select("repo_url", F.explode("cases").alias("c")).select("repo_url", "c.*")


def health(spark: SparkSession) -> dict[str, object]:
    return {"version": spark.version, "vectors": spark.catalog.functionExists("zip_with"), "stemming": stem("relational") == stem("relate")}
