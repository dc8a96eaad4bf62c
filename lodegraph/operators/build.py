"""The index build in one call: extracts to nodes, edges, chunks, metrics and counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.paths import relative_module
from lodegraph.operators import graph
from lodegraph.schemas import METRICS
from lodegraph.session import checkpointed


@dataclass
class Build:
    """nodes (with metrics), edges, chunks, and stats: one row of n_files, n_nodes, n_edges, n_chunks."""

    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame
    stats: DataFrame


def _edge(rows: DataFrame, src: Column, dst: Column, kind: str, confidence: Column, turn: int) -> DataFrame:
    return rows.select(src.alias("src_name"), dst.alias("dst_name"), F.lit(kind).alias("kind"), confidence.alias("confidence"), F.lit(turn).alias("turn"))


def references(extracts: DataFrame, symbols: DataFrame) -> DataFrame:
    """src_name, dst_name, kind, confidence, turn: edges by name, not yet held to known ends. extracts: as sources.extract gives them."""
    index = graph.name_index(symbols, "path", "ord")
    contains = _edge(symbols.where("parent is not null"), F.col("parent"), F.col("fqname"), "contains", F.lit(1.0), 0)
    bases = symbols.select("fqname", F.explode("bases").alias("base"))
    inherits = _edge(graph.resolved(bases, index, "base", dotted=False), F.col("fqname"), F.col("target"), "inherits", F.col("confidence"), 1)
    found = extracts.selectExpr("symbols[0].fqname as importer", "endswith(path, '__init__.py') as is_package", "inline(imports)")
    own = F.when(F.col("is_package"), F.concat(F.col("importer"), F.lit(".__init__"))).otherwise(F.col("importer"))
    absolute = F.when(F.col("relative") & (F.col("level") > 0), relative_module(own, F.col("module"), F.col("level"))).otherwise(F.col("module"))
    modules = symbols.where("kind = 'file'").select(F.col("fqname").alias("module"))
    imports = _edge(graph.import_edges(found.select("importer", absolute.alias("module"), "imported"), modules), F.col("importer"), F.col("dst"), "imports", F.lit(1.0), 2)
    calls = _edge(graph.resolved(extracts.selectExpr("inline(calls)"), index, "callee", dotted=True), F.col("caller"), F.col("target"), "calls", F.col("confidence"), 3)
    return contains.unionByName(inherits).unionByName(imports).unionByName(calls)


def build_graph(extracts: DataFrame) -> Build:
    """Every table of the graph. Of symbols with one name the first by path and place is the node; each symbol with
    source, repeats too, is a chunk of the node of its name; metrics are written with the nodes."""
    extracts = checkpointed(extracts)
    symbols = checkpointed(extracts.selectExpr("path", "posexplode(symbols) as (ord, s)").select("path", "ord", "s.*"))
    nodes = graph.with_ids(graph.first_symbols(symbols, "path", "ord"), "path", "ord")
    edges = checkpointed(graph.guarded(references(extracts, symbols), nodes, "turn", "confidence"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int").alias(c)
    loc = (F.col("end_line") - F.col("start_line") + 1).cast("int").alias("loc")
    nodes = checkpointed(nodes.join(graph.fans(edges), "id", "left").withColumn("metrics", F.struct(loc, zero("fan_in"), zero("fan_out")).cast(METRICS)).drop("fan_in", "fan_out"))
    ids = nodes.select("fqname", F.col("id").alias("node_id"))
    chunks = symbols.where(F.trim(F.coalesce("source", F.lit(""))) != "").join(ids, "fqname", "left")
    chunks = checkpointed(chunks.select("node_id", "path", "ord", "start_line", "end_line", F.col("source").alias("text")))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    stats = n(extracts, "n_files").crossJoin(n(nodes, "n_nodes")).crossJoin(n(edges, "n_edges")).crossJoin(n(chunks, "n_chunks"))  # one row each
    return Build(nodes, edges, chunks, stats)
