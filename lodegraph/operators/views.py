"""What a reader of the graph asks for: a slice, one node, a search, a walkthrough, the enrichment block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators import enrich, graph

SNIPPET_CHARS, SEARCHED, SUBSYSTEMS, FLOWS = 600, 12, 8, 5


def graph_slice(nodes: DataFrame, edges: DataFrame, communities: DataFrame, max_nodes: int = 400) -> tuple[DataFrame, DataFrame]:
    """The nodes of the highest degree, each with its largest community's key and its number of verified annotations,
    and the edges among them. nodes: id, fqname, kind, annotations; communities: key, size, node_ids."""
    kept = graph.top_nodes(nodes, edges, max_nodes)
    member = communities.select("key", "size", F.explode("node_ids").alias("id")).join(kept.select("id"), "id", "left_semi")
    first = member.groupBy("id").agg(F.min_by("key", F.struct(-F.col("size"), "key")).alias("community"))
    shown = kept.join(first, "id", "left").withColumn("n_annotations", enrich.verified_count(F.col("annotations")))
    return shown.select("id", "fqname", "kind", "degree", "community", "n_annotations"), graph.induced(edges, kept)


def get_node(nodes: DataFrame, fqname: str) -> DataFrame:
    """The brief form of one node; no row if there is none."""
    brief = [c for c in ("id", "fqname", "kind", "path", "start_line", "end_line", "signature", "summary") if c in nodes.columns]
    return nodes.where(F.col("fqname") == fqname).select(*brief)


def search_graph(retrieved: DataFrame, limit: int = SEARCHED) -> DataFrame:
    """The first of the retrieved rows (key columns, score, snippet) with their snippet cut."""
    first = retrieved.columns[0]
    return retrieved.orderBy(F.col("score").desc(), first).limit(limit).withColumn("snippet", F.left(F.coalesce("snippet", F.lit("")), F.lit(SNIPPET_CHARS)))


def walkthrough(model: DataFrame, nodes: DataFrame) -> DataFrame:
    """step, title, fqname, path, text: a model's tour in order, with the place of each step's node, where it is known.
    model: tour array<struct<title, fqname, text>>."""
    steps = model.select(F.posexplode("tour").alias("step", "s")).select("step", "s.title", "s.fqname", "s.text")
    return steps.join(nodes.select("fqname", "path"), "fqname", "left").select("step", "title", "fqname", "path", "text")


def enrichment_block(model: DataFrame) -> DataFrame:
    """One row a model: its summary, first SUBSYSTEMS subsystems and first FLOWS flows as text. model: summary,
    subsystems array<struct<name, purpose>>, flows array<string>; parts that are null or empty leave no heading."""
    part = lambda head, items: F.when(F.size(items) > 0, F.concat(F.lit(head + "\n"), F.array_join(items, "\n")))
    subsystems = F.transform(F.slice("subsystems", 1, SUBSYSTEMS), lambda s: F.concat(F.lit("- "), s["name"], F.lit(": "), F.coalesce(s["purpose"], F.lit(""))))
    flows = F.transform(F.slice("flows", 1, FLOWS), lambda f: F.concat(F.lit("- "), f))
    text = F.concat_ws("\n\n", F.nullif(F.trim("summary"), F.lit("")), part("Subsystems:", subsystems), part("Flows:", flows))
    return model.withColumn("block", text)
