"""The driver's tables, and the graph's concepts as views of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.text import lines

TASK_ROWS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, line (from 1), text."""
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.posexplode(lines(F.col("text"))).alias("at", "text"))
    return rows.select("doc_id", "path", (F.col("at") + 1).alias("line"), "text")


def doc_chunks(spark: SparkSession, sf_dir: str, size: int = 5) -> DataFrame:
    """doc_id, path, start_line, end_line, text: each document in chunks of some lines, cut inside its row."""
    d = table(spark, sf_dir, "documents")
    ls = lines(F.col("text"))
    begins = F.explode(F.sequence(F.lit(0), F.size(ls) - 1, F.lit(size)))
    rows = d.select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), ls.alias("ls"), begins.alias("b"))
    part = F.slice("ls", F.col("b") + 1, F.lit(size))
    return rows.select("doc_id", "path", (F.col("b") + 1).alias("start_line"), (F.col("b") + F.size(part)).alias("end_line"), F.array_join(part, "\n").alias("text"))


def dimension_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fqname, kind, parent, ord: regions, nations, customers and suppliers as a tree of names."""
    t = lambda n: table(spark, sf_dir, n)
    region = t("region").select("r_regionkey", F.lower("r_name").alias("r"))
    nation = t("nation").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r", F.concat_ws(".", "r", F.lower(F.replace("n_name", F.lit(" "), F.lit("_")))).alias("n"))
    none = F.lit(None).cast("string")
    rows = region.select(F.col("r").alias("fqname"), F.lit("package").alias("kind"), none.alias("parent"), F.lit(0).alias("ord"))
    rows = rows.unionByName(nation.select(F.col("n").alias("fqname"), F.lit("file").alias("kind"), F.col("r").alias("parent"), F.lit(1).alias("ord")))
    near = F.broadcast(nation.select("n_nationkey", "n"))  # one row a nation
    for name, key, of, kind, at in (("customer", "c_name", "c_nationkey", "class", 2), ("supplier", "s_name", "s_nationkey", "function", 3)):
        own = t(name).join(near, F.col(of) == F.col("n_nationkey"))
        rows = rows.unionByName(own.select(F.concat_ws(".", "n", F.lower(key)).alias("fqname"), F.lit(kind).alias("kind"), F.col("n").alias("parent"), F.lit(at).alias("ord")))
    return rows


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src (customer), dst (1,000,000,000 + supplier), kind calls, confidence: each pair that traded, once; the confidence
    is 1.0 for a pair that did so in one way, else 0.5. Tasks grow in number with the lines (a count that files' footers
    give), and pairs are dealt before they are counted, so that no task holds many more than TASK_ROWS of them."""
    o, li = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-li.count() // TASK_ROWS))
    traded = o.join(li.repartition(parts, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1_000_000_000).alias("dst"))
    both = traded.repartition(parts, "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return both.select("src", "dst", F.lit("calls").alias("kind"), F.when(F.col("n") == 1, 1.0).otherwise(0.5).alias("confidence"))
