"""Reads over stored text: grep, file reconstruction, name search, skeleton, neighbour lists."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.text import lines
from lodegraph.session import checkpointed
from lodegraph.sources.tables import TASK_ROWS

MAX_CHARS, MAX_HITS = 16_000, 40


def numbered(files: DataFrame, path: str, text: str) -> DataFrame:
    """path, line (from 1) and text of each line."""
    return files.select(F.col(path).alias("path"), F.posexplode(lines(F.col(text))).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


def grep(rows: DataFrame, pattern: str, limit: int | None = MAX_HITS) -> DataFrame:
    """Lines that match, first by path and line; a pattern that is none gives one row that says so."""
    try:
        re.compile(pattern)
    except re.error as error:
        return rows.sparkSession.createDataFrame([(None, None, f"invalid pattern: {error}")], "path string, line int, text string")
    hits = rows.where(F.col("text").rlike(pattern)).select("path", "line", F.left(F.trim("text"), F.lit(200)).alias("text"))
    return hits.orderBy("path", "line").limit(limit) if limit else hits


def read_file(chunks: DataFrame, max_chars: int = MAX_CHARS, maximal: bool = False) -> DataFrame:
    """path, text, start_line, end_line of each file out of its chunks, equal ranges once; with maximal, chunks inside
    another one are left out too."""
    rows = chunks.groupBy("path", "start_line", "end_line").agg(F.min("text").alias("text"))
    if maximal:
        before = Window.partitionBy("path").orderBy("start_line", F.col("end_line").desc()).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("reach", F.max("end_line").over(before)).where("reach is null or end_line > reach").drop("reach")
    each = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "text"))).alias("parts"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    return each.select("path", F.left(F.array_join(F.transform("parts", lambda x: x["text"]), "\n"), F.lit(max_chars)).alias("text"), "start_line", "end_line")


def search_names(nodes: DataFrame, name: str, query: str, degree: str, limit: int = 8) -> DataFrame:
    return nodes.where(F.lower(F.col(name)).contains(query.strip().lower())).orderBy(F.col(degree).desc(), name).limit(limit)


def edges_by_kind(edges: DataFrame, nodes: DataFrame, limit: int = MAX_HITS) -> DataFrame:
    """id, direction, kind and the names at the other ends, at most limit a direction, in order of kind and name. Tasks grow in
    number with the edges, so that none sorts more than about TASK_ROWS rows."""
    edges = checkpointed(edges.select("src", "dst", "kind"))
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * edges.count() // TASK_ROWS))
    names = nodes.select(F.col("id").alias("other"), F.col("fqname"))
    out = edges.select(F.col("src").alias("id"), F.lit("out").alias("direction"), "kind", F.col("dst").alias("other"))
    into = edges.select(F.col("dst").alias("id"), F.lit("in").alias("direction"), "kind", F.col("src").alias("other"))
    w = Window.partitionBy("id", "direction").orderBy("kind", "fqname")
    named = out.unionByName(into).repartition(parts, "other").join(names, "other").repartition(parts, "id", "direction")
    rows = named.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    return rows.groupBy("id", "direction", "kind").agg(F.array_sort(F.collect_list("fqname")).alias("names"))


def central(nodes: DataFrame, kinds: list[str], limit: int = 40) -> DataFrame:
    """The nodes of these kinds with the largest fan_in + fan_out (columns of their metrics, null as 0)."""
    fan = F.coalesce("metrics.fan_in", F.lit(0)) + F.coalesce("metrics.fan_out", F.lit(0))
    return nodes.where(F.col("kind").isin(kinds)).withColumn("fan", fan).orderBy(F.col("fan").desc(), "fqname").limit(limit)


def skeleton(files: DataFrame, symbols: DataFrame, docs: DataFrame, n_files: int = 80, n_symbols: int = 40, n_docs: int = 20) -> DataFrame:
    """part, name, n: the first files and documents by name and the symbols of the greatest n. All have name and n."""
    part = lambda df, what: df.select(F.lit(what).alias("part"), "name", "n")
    top = symbols.orderBy(F.col("n").desc(), "name").limit(n_symbols)
    return part(files.orderBy("name").limit(n_files), "file").unionByName(part(top, "symbol")).unionByName(part(docs.orderBy("name").limit(n_docs), "doc"))
