"""Symbol graph: names, edges with confidence, metrics, traversal, slices, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.text import last_segment
from lodegraph.session import checkpointed

CERTAIN, DOTTED, AMBIGUOUS = 1.0, 0.4, 0.5
WEIGHTS = {"calls": 1.0, "inherits": 0.9, "implements": 0.9, "imports": 0.6, "tests": 0.4}


def first_symbols(symbols: DataFrame, *order: str) -> DataFrame:
    """One row a fqname: the first in the given order."""
    return symbols.withColumn("_n", F.row_number().over(Window.partitionBy("fqname").orderBy(*order))).where("_n = 1").drop("_n")


def with_ids(nodes: DataFrame, *order: str | Column) -> DataFrame:
    """nodes with id: 1, 2, ... in the given order, by counts of sorted ranges, so no task orders all rows. The ranges are
    dealt once and kept, as both the counts and the numbers rest on them."""
    ranged = nodes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    ranged = checkpointed(ranged)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # one row a range, of which there are as many as shuffle partitions
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = ranged.join(F.broadcast(before), "_part").withColumn("id", F.col("_before") + F.col("_at") - F.col("_first") + 1)
    return numbered.drop("_part", "_at", "_first", "_before")


def name_index(symbols: DataFrame, *order: str) -> DataFrame:
    """short, n (occurrences, duplicates too) and first (the first fqname): one row a short name."""
    return symbols.withColumn("short", last_segment(F.col("fqname"))).groupBy("short").agg(F.count(F.lit(1)).alias("n"), F.min_by("fqname", F.struct(*order, "fqname")).alias("first"))


def resolved(refs: DataFrame, index: DataFrame, name: str, dotted: bool) -> DataFrame:
    """refs with target and confidence, unresolved ones gone. A single candidate is certain (or less so for a dotted
    call); of several, the first is taken as ambiguous."""
    few = F.when(F.col(name).contains("."), DOTTED).otherwise(CERTAIN) if dotted else F.lit(CERTAIN)
    found = refs.withColumn("short", last_segment(F.col(name))).join(index, "short")
    return found.withColumn("confidence", F.when(F.col("n") == 1, few).otherwise(AMBIGUOUS)).withColumnRenamed("first", "target").drop("short", "n")


def import_edges(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """importer and dst: the module itself if it is known, else module.imported if that is. imports: importer, module, imported."""
    known = modules.select(F.col("module").alias("known")).distinct()
    deeper = F.concat_ws(".", F.nullif(F.col("module"), F.lit("")), F.nullif(F.col("imported"), F.lit("")))
    exact = imports.join(known, F.col("module") == F.col("known"), "left").withColumnRenamed("known", "exact").withColumn("deeper", F.when(F.coalesce(F.col("imported"), F.lit("")) != "", deeper))
    both = exact.join(known, F.col("deeper") == F.col("known"), "left")
    return both.withColumn("dst", F.coalesce("exact", "known")).where("dst is not null").select("importer", "dst")


def guarded(edges: DataFrame, nodes: DataFrame, *order: str) -> DataFrame:
    """src, dst, kind, confidence by fqname to ids: both ends known, no self-loops, the first of equal ones."""
    ids = nodes.select("fqname", "id")
    out = edges.join(ids.select(F.col("fqname").alias("src_name"), F.col("id").alias("src")), "src_name").join(ids.select(F.col("fqname").alias("dst_name"), F.col("id").alias("dst")), "dst_name").where("src <> dst")
    return out.groupBy("src", "dst", "kind").agg(F.min_by("confidence", F.struct(*order)).alias("confidence"))


def fans(edges: DataFrame, kind: str = "calls") -> DataFrame:
    """id, fan_in, fan_out over the edges of one kind."""
    e = edges.where(F.col("kind") == kind)
    ends = e.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(e.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


MIN_NODES, MAX_NODES, MEMBERS = 10, 1500, 1000


def top_nodes(nodes: DataFrame, edges: DataFrame, limit: int = 400) -> DataFrame:
    """The nodes of the highest degree, isolated ones last, ties by id; limit is held to MIN_NODES..MAX_NODES."""
    limit = min(max(limit, MIN_NODES), MAX_NODES)
    return nodes.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).orderBy(F.col("degree").desc(), "id").limit(limit)


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends among the kept nodes."""
    ids = kept.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def hops(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """id and hops of all nodes within k edges of the seeds, either way."""
    both = checkpointed(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    seen = seeds.select("id").distinct().withColumn("hops", F.lit(0))
    front = seen
    for i in range(1, k + 1):
        front = front.join(both, front.id == both.src).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(i))
        front = checkpointed(front)
        seen = seen.unionByName(front)
    return seen


def weighted(edges: DataFrame) -> DataFrame:
    """Undirected weights for communities; containment does not count."""
    weight = F.coalesce(*[F.when(F.col("kind") == k, F.lit(w)) for k, w in WEIGHTS.items()])
    e = edges.withColumn("w", weight * F.col("confidence")).where("w is not null and src <> dst")
    return e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("w"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """id and component (its least id): least labels over edges, with a jump to the label's label each round."""
    both = checkpointed(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = both.select(F.col("src").alias("id")).distinct().withColumn("component", F.col("id"))
    before = None
    for _ in range(rounds):
        near = both.join(labels, both.dst == labels.id).groupBy("src").agg(F.min("component").alias("near"))
        least = labels.join(near, labels.id == near.src, "left").select("id", F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = least.select(F.col("id").alias("component"), F.col("component").alias("to"))
        labels = checkpointed(least.join(jump, "component").select("id", F.col("to").alias("component")))
        now = labels.agg(F.sum(F.xxhash64("id", "component").cast("decimal(38,0)"))).first()[0]  # ids of any size, in any order
        if now == before:
            return labels
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def modularity(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: modularity of a labelling (id, label) on weighted pairs (a, b, w)."""
    la, lb = labels.select(F.col("id").alias("a"), F.col("label").alias("la")), labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    m = pairs.agg(F.sum("w").alias("m"))
    inside = pairs.join(la, "a").join(lb, "b").where("la = lb").groupBy(F.col("la").alias("label")).agg(F.sum("w").alias("inside"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"), "w").join(labels, "id").groupBy("label").agg(F.sum("w").alias("total"))
    each = ends.join(inside, "label", "left").crossJoin(F.broadcast(m))
    return each.agg(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("total") / (2 * F.col("m")), 2)).alias("modularity"))


def membership(labels: DataFrame) -> DataFrame:
    """id and key of each node: c0, c1, ... largest community first (ties: least member)."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    keys = with_ids(sizes, F.col("size").desc(), F.col("label")).select("label", F.concat(F.lit("c"), F.col("id") - 1).alias("key"), "size")
    return labels.join(keys, "label").select("id", "key", "size")


def community_rows(labels: DataFrame, members: int = MEMBERS) -> DataFrame:
    """key (as in membership), size, and node_ids: the least ids, `members` at most; membership has them all. A community
    is picked down within hashed parts first, so a giant one is not one task's."""
    parted = membership(labels).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    some = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    few = parted.withColumn("n", some(["key", "part"])).where(F.col("n") <= members).withColumn("n", some(["key"])).where(F.col("n") <= members)
    return few.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("node_ids"), F.first("size").alias("size"))
