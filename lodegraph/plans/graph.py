"""Graph queries: nodes, edges with confidence, metrics, traversal, communities, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.text import last_segment, parent_name
from lodegraph.operators import communities, enrich, graph, spatial, views
from lodegraph.operators.build import build_graph
from lodegraph.operators.tools import central, edges_by_kind
from lodegraph.plans.registry import query
from lodegraph.plans.text import SYMBOLS, source_files
from lodegraph.session import checkpointed
from lodegraph.sources.files import extract
from lodegraph.sources.tables import dimension_nodes, order_edges, table

NODES = """rg AS (SELECT r_regionkey, lower(r_name) AS r FROM region), na AS (SELECT n_nationkey, r, r || '.' || lower(replace(n_name, ' ', '_')) AS n FROM nation JOIN rg ON n_regionkey = r_regionkey),
nd AS (SELECT r AS fqname, 'package' AS kind, NULL AS parent, 0 AS ord FROM rg UNION ALL SELECT n, 'file', r, 1 FROM na
 UNION ALL SELECT n || '.' || lower(c_name), 'class', n, 2 FROM customer JOIN na ON c_nationkey = n_nationkey UNION ALL SELECT n || '.' || lower(s_name), 'function', n, 3 FROM supplier JOIN na ON s_nationkey = n_nationkey),
ids AS (SELECT *, row_number() OVER (ORDER BY ord, fqname) AS id FROM nd)"""
CALLS = """ce AS (SELECT o_custkey AS src, l_suppkey + 1000000000 AS dst, 'calls' AS kind, CASE WHEN count(*) = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.with_ids(graph.first_symbols(dimension_nodes(spark, sf_dir), "ord"), "ord", "fqname")


@query(f"WITH {NODES} SELECT id, fqname, kind, regexp_extract(fqname, '[^.]*$') AS name FROM ids")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).select("id", "fqname", "kind", last_segment(F.col("fqname")).alias("name"))


@query(f"WITH {NODES} SELECT p.id AS src, c.id AS dst, 'contains' AS kind, 1.0::DOUBLE AS confidence FROM ids c JOIN ids p ON c.parent = p.fqname")
def edges_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _ids(spark, sf_dir)
    raw = nodes.where("parent is not null").select(F.col("parent").alias("src_name"), F.col("fqname").alias("dst_name"), F.lit("contains").alias("kind"), F.lit(1.0).alias("confidence"))
    return graph.guarded(raw, nodes.select("fqname", "id"), "src_name", "dst_name")


@query("""WITH sy AS (SELECT lower(replace(p_brand, '#', '')) || '.' || regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') AS fqname, p_partkey FROM part), ix AS (SELECT regexp_extract(fqname, '[^.]*$') AS short, count(*) AS n, arg_min(fqname, p_partkey) AS first FROM sy GROUP BY 1),
rf AS (SELECT p_partkey AS caller, CASE WHEN p_partkey % 2 = 0 THEN 'obj.' ELSE '' END || regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') AS callee FROM part)
SELECT caller, callee, first AS target, CASE WHEN n > 1 THEN 0.5::DOUBLE WHEN callee LIKE '%.%' THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM rf JOIN ix ON regexp_extract(callee, '[^.]*$') = short""")
def edges_calls_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "_")
    symbols = p.select(F.concat_ws(".", F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), name).alias("fqname"), "p_partkey")
    calls = p.select(F.col("p_partkey").alias("caller"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "obj.").otherwise(""), name).alias("callee"))
    return graph.resolved(calls, graph.name_index(symbols, "p_partkey"), "callee", dotted=True).select("caller", "callee", "target", "confidence")


@query("""WITH sy AS (SELECT lower(p_type) AS short, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1), b AS (SELECT p_partkey AS child, unnest([lower(p_type), lower(p_brand)]) AS base FROM part)
SELECT child, base, first AS target, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM b JOIN sy ON base = short""")
def edges_inherits_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    symbols = p.select(F.lower("p_type").alias("fqname"), "p_partkey")
    index = symbols.groupBy(F.col("fqname").alias("short")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))
    bases = p.select(F.col("p_partkey").alias("child"), F.explode(F.array(F.lower("p_type"), F.lower("p_brand"))).alias("base"))
    return graph.resolved(bases, index, "base", dotted=False).select("child", "base", "target", "confidence")


@query("""WITH n AS (SELECT n_nationkey, r_regionkey, lower(r_name) AS r, lower(replace(n_name, ' ', '_')) AS n FROM nation JOIN region ON n_regionkey = r_regionkey),
i AS (SELECT s_name AS importer, r_regionkey, s_suppkey, r, n FROM supplier JOIN n ON s_nationkey = n_nationkey)
SELECT importer, CASE WHEN s_suppkey % 3 = 1 OR r_regionkey % 2 = 1 THEN r || '.' || n ELSE r END AS dst FROM i WHERE s_suppkey % 3 <> 2""")
def import_edges_exact_or_deeper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers import their nation out of its region, the nation itself, or what nobody knows; only every other region is
    a module, so imports out of the others are of the nation below."""
    t = lambda n: table(spark, sf_dir, n)
    region = t("region").select("r_regionkey", F.lower("r_name").alias("r"))
    nation = t("nation").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_regionkey", "r", F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))).alias("n"))
    full = F.concat_ws(".", "r", "n")
    modules = nation.select(full.alias("module")).unionByName(region.where("r_regionkey % 2 = 0").select(F.col("r").alias("module")))
    rows = t("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey") % 3
    imports = rows.select(F.col("s_name").alias("importer"), F.when(k == 0, F.col("r")).when(k == 1, full).otherwise("os").alias("module"), F.when(k == 0, F.col("n")).when(k == 2, "path").alias("imported"))
    return graph.import_edges(imports, modules)


@query(f"WITH {CALLS}, e AS (SELECT dst AS id, 1 AS i, 0 AS o FROM ce UNION ALL SELECT src, 0, 1 FROM ce) SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM e GROUP BY id")
def fan_in_out_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fans(order_edges(spark, sf_dir))


TOP = f"{CALLS}, dg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM ce UNION ALL SELECT dst FROM ce) GROUP BY id), allids AS (SELECT c_custkey AS id FROM customer UNION ALL SELECT s_suppkey + 1000000000 FROM supplier), tp AS (SELECT id, coalesce(degree, 0) AS degree FROM allids LEFT JOIN dg USING (id) ORDER BY coalesce(degree, 0) DESC, id LIMIT 400)"


def _all_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).unionByName(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("id")))


@query(f"WITH {TOP} SELECT id, degree FROM tp")
def degree_top_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_nodes(_all_ids(spark, sf_dir), order_edges(spark, sf_dir)).select("id", "degree")


@query(f"WITH {TOP} SELECT src, dst, confidence FROM ce WHERE src IN (SELECT id FROM tp) AND dst IN (SELECT id FROM tp)")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = order_edges(spark, sf_dir)
    return graph.induced(e, graph.top_nodes(_all_ids(spark, sf_dir), e)).select("src", "dst", "confidence")


@query(f"WITH {CALLS} SELECT id FROM (SELECT dst AS id FROM ce WHERE src IN (1, 2, 3) UNION SELECT src FROM ce WHERE dst IN (1, 2, 3)) WHERE id NOT IN (1, 2, 3)")
def neighbors_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodegraph.operators.retrieval import neighbours

    seeds = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    return neighbours(order_edges(spark, sf_dir), seeds, "id", ["calls", "contains", "imports", "inherits"])


@query(f"WITH {NODES}, b AS (SELECT fqname AS a, parent AS b FROM ids WHERE parent IS NOT NULL UNION ALL SELECT parent, fqname FROM ids WHERE parent IS NOT NULL), s0 AS (SELECT 'asia' AS n, 0 AS h), s1 AS (SELECT n, 0 AS h FROM s0 UNION ALL SELECT DISTINCT b, 1 FROM s0 JOIN b ON n = a WHERE b NOT IN (SELECT n FROM s0)), s2 AS (SELECT * FROM s1 UNION ALL SELECT DISTINCT b, 2 FROM s1 JOIN b ON n = a WHERE b NOT IN (SELECT n FROM s1)) SELECT i.id, CAST(h AS INTEGER) AS hops FROM s2 JOIN ids i ON i.fqname = n")
def khop_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _ids(spark, sf_dir)
    names = nodes.select(F.col("fqname").alias("parent"), F.col("id").alias("src"))
    edges = nodes.where("parent is not null").join(names, "parent").select("src", F.col("id").alias("dst"))
    return graph.hops(edges, nodes.where("fqname = 'asia'").select("id"), 2)


@query(f"WITH {NODES}, {CALLS}, f AS (SELECT id, count(*) AS fan FROM (SELECT src AS id FROM ce UNION ALL SELECT dst FROM ce) GROUP BY id), n AS (SELECT c_name AS fqname, 'class' AS kind, c_custkey AS id FROM customer UNION ALL SELECT s_name, 'function', s_suppkey + 1000000000 FROM supplier) SELECT fqname, kind, CAST(coalesce(fan, 0) AS BIGINT) AS fan FROM n LEFT JOIN f USING (id) ORDER BY coalesce(fan, 0) DESC, fqname LIMIT 40")
def central_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    nodes = c.select(F.col("c_name").alias("fqname"), F.lit("class").alias("kind"), F.col("c_custkey").alias("id")).unionByName(s.select(F.col("s_name").alias("fqname"), F.lit("function").alias("kind"), (F.col("s_suppkey") + 1_000_000_000).alias("id")))
    measured = nodes.join(graph.fans(order_edges(spark, sf_dir)), "id", "left").withColumn("metrics", F.struct("fan_in", "fan_out"))
    return central(measured, ["class", "function", "method"]).select("fqname", "kind", "fan")


#: Embeddings whose id is divisible by 100 are queries, against all others.
PAIRS = """pr AS (SELECT a.vec_id AS id, b.vec_id AS other, round(1 - list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS distance
 FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
kn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM pr QUALIFY rank <= 2)"""


def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return spatial.nearest(e, e.where("id % 100 = 0"), 2)


@query(f"WITH {PAIRS} SELECT id, other, distance, CAST(rank AS INTEGER) AS rank FROM kn")
def knn2_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir).select("id", "other", "distance", "rank")


def _knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir).select(F.col("id").alias("src"), F.col("other").alias("dst"), F.lit("calls").alias("kind"), (1 - F.col("distance") / 2).alias("confidence"))


CUTOFF = 0.05


@query(f"""WITH p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)
SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance FROM p a JOIN p b ON a.id < b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {CUTOFF}::DOUBLE * {CUTOFF}::DOUBLE""")
def pairs_within_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the first two coordinates of embeddings that lie within the cutoff of each other."""
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.element_at("embedding", 1).alias("x"), F.element_at("embedding", 2).alias("y"))
    return spatial.within(p, CUTOFF).select("a", "b", F.round(F.sqrt("d2"), 6).alias("distance"))


COMPONENTS = f"""{PAIRS}, be AS (SELECT id AS a, other AS b FROM kn UNION SELECT other, id FROM kn), reach(a, b) AS (SELECT a, b FROM be UNION SELECT r.a, e.b FROM reach r JOIN be e ON r.b = e.a), co AS (SELECT a AS id, least(a, min(b)) AS component FROM reach GROUP BY a)"""


@query(f"WITH RECURSIVE {COMPONENTS} SELECT id, component FROM co")
def communities_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_knn_edges(spark, sf_dir))


def _labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pairs = checkpointed(graph.weighted(_knn_edges(spark, sf_dir)))
    return pairs, checkpointed(communities.communities(pairs))


@query()
def communities_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities with the modularity of the whole; labels have no SQL form, so tests hold them to bounds."""
    pairs, labels = _labels(spark, sf_dir)
    return graph.community_rows(labels).crossJoin(F.broadcast(graph.modularity(pairs, labels)))


@query(f"WITH RECURSIVE {COMPONENTS}, gr AS (SELECT component, count(*) AS size, array_to_string(list_transform(list_sort(list(id))[1:3], lambda i: CAST(i AS VARCHAR)), ', ') AS summary FROM co GROUP BY component), ky AS (SELECT *, 'c' || (row_number() OVER (ORDER BY size DESC, component) - 1) AS key FROM gr) SELECT key, size, '- ' || key || ' (' || size || '): ' || summary AS line FROM ky ORDER BY size DESC, key LIMIT 12")
def community_summaries_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = graph.components(_knn_edges(spark, sf_dir)).select("id", F.col("component").alias("label"))
    rows = graph.community_rows(labels).withColumn("summary", F.array_join(F.transform(F.slice("node_ids", 1, 3), lambda i: i.cast("string")), ", "))
    return enrich.community_lines(rows)


@query(f"WITH RECURSIVE {COMPONENTS}, gr AS (SELECT component, count(*) AS size FROM co GROUP BY component), ky AS (SELECT component, 'c' || (row_number() OVER (ORDER BY size DESC, component) - 1) AS key FROM gr) SELECT e.vec_id AS id, key FROM embeddings e LEFT JOIN co ON e.vec_id = co.id LEFT JOIN ky USING (component)")
def node_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's largest community, or null."""
    labels = graph.components(_knn_edges(spark, sf_dir)).select("id", F.col("component").alias("label"))
    first = graph.membership(labels).groupBy("id").agg(F.min_by("key", F.struct(-F.col("size"), "key")).alias("key"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")).join(first, "id", "left")


def _annotation(kind: Column, text: Column, verified: Column) -> Column:
    return F.struct(text.alias("text"), kind.alias("kind"), F.array().cast("array<string>").alias("evidence"), F.lit("explorer").alias("source"), verified.alias("verified"), F.lit("run").alias("run_id"), F.lit(None).cast("timestamp").alias("created_at"))


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nodes with two annotations each: a role, verified by quality, and on some a model of the repository."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    role = _annotation(F.lit("role"), F.concat(F.lit("in "), F.col("lang")), F.coalesce(F.col("quality") == 1, F.lit(False)))
    model = _annotation(F.lit("repo_model"), F.concat(F.lit("model "), F.col("doc_id").cast("string")), F.lit(True))
    return d.select(F.col("doc_id").alias("id"), F.concat_ws(".", "source", F.col("doc_id").cast("string")).alias("fqname"), F.when(F.col("doc_id") % 3 == 0, F.array(role, model)).otherwise(F.array(role)).alias("annotations"))


@query("SELECT d.doc_id AS id, CAST(CAST(coalesce(quality = 1, false) AS INTEGER) + CAST(d.doc_id % 3 = 0 AS INTEGER) AS INTEGER) AS verified FROM documents d LEFT JOIN labels l USING (doc_id)")
def annotations_verified_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotated(spark, sf_dir).select("id", enrich.verified_count(F.col("annotations")).alias("verified"))


@query("SELECT d.doc_id AS id, CAST(0 AS INTEGER) AS at, '- ' || source || '.' || d.doc_id || ': in ' || lang AS line FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1 ORDER BY d.doc_id LIMIT 20")
def annotation_lines_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.annotation_lines(_annotated(spark, sf_dir))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'model ' || doc_id END AS model FROM documents")
def repo_model_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotated(spark, sf_dir).select("id", enrich.latest_model(F.col("annotations")).alias("model"))


@query("""WITH f AS (SELECT doc_id, unnest(range(0, CAST(1 + doc_id % 3 AS BIGINT))) AS k FROM labels), a AS (SELECT source || '.' || doc_id AS t, count(*) AS n, string_agg('finding ' || k, '|' ORDER BY k) AS texts FROM f JOIN labels USING (doc_id) JOIN documents USING (doc_id) WHERE quality = 1 GROUP BY ALL)
SELECT d.doc_id AS id, CAST(1 + CAST(d.doc_id % 3 = 0 AS INTEGER) + coalesce(n, 0) AS INTEGER) AS n_annotations, coalesce(texts, '') AS texts FROM documents d LEFT JOIN a ON a.t = d.source || '.' || d.doc_id""")
def writeback_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _annotated(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    names = nodes.select(F.col("id").alias("doc_id"), F.col("fqname").alias("target"))
    findings = labels.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("doc_id") % 3)).alias("ord")).join(names, "doc_id").withColumn("text", F.concat(F.lit("finding "), F.col("ord").cast("string")))
    verdicts = labels.where("quality = 1").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("doc_id") % 3)).alias("k")).join(names, "doc_id").select("target", F.concat(F.lit("finding "), F.col("k").cast("string")).alias("text"))
    accepted = enrich.judged(findings, verdicts).select("target", "ord", _annotation(F.lit("behaviour"), F.col("text"), F.lit(True)).alias("a"))
    out = enrich.write_back(nodes, accepted)
    new = F.filter("annotations", lambda a: a["kind"] == "behaviour")
    return out.select("id", F.size("annotations").alias("n_annotations"), F.array_join(F.transform(new, lambda a: a["text"]), "|").alias("texts"))


@query(f"""WITH {NODES}, w0 AS (SELECT fqname, parent, fqname || '()' AS s FROM ids WHERE ord >= 2), k0 AS (SELECT parent, fqname, s, row_number() OVER (PARTITION BY parent ORDER BY fqname) AS n FROM w0), a0 AS (SELECT parent, string_agg(s, ',' ORDER BY n) AS c FROM k0 WHERE n <= 30 GROUP BY parent),
w1 AS (SELECT fqname, i.parent, fqname || '(' || coalesce(c, '') || ')' AS s FROM ids i LEFT JOIN a0 ON a0.parent = i.fqname WHERE ord = 1), k1 AS (SELECT parent, fqname, s, row_number() OVER (PARTITION BY parent ORDER BY fqname) AS n FROM w1), a1 AS (SELECT parent, string_agg(s, ',' ORDER BY n) AS c FROM k1 WHERE n <= 30 GROUP BY parent),
w2 AS (SELECT fqname, fqname || '(' || coalesce(c, '') || ')' AS s FROM ids i LEFT JOIN a1 ON a1.parent = i.fqname WHERE ord = 0)
SELECT fqname, 0 AS wave, sha256(s) AS summary FROM w0 UNION ALL SELECT fqname, 1, sha256(s) FROM w1 UNION ALL SELECT fqname, 2, sha256(s) FROM w2""")
def summary_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _ids(spark, sf_dir).select("id", "fqname", "parent", F.greatest(2 - F.col("ord"), F.lit(0)).alias("wave"))
    out = enrich.summary_waves(nodes, 3, lambda name, children: F.concat(name, F.lit("("), F.array_join(children, ","), F.lit(")")))
    return out.select("fqname", "wave", F.sha2("summary", 256).alias("summary"))


@query(f"WITH {NODES}, {CALLS}, nm AS (SELECT c_custkey AS id, c_name AS fqname FROM customer UNION ALL SELECT s_suppkey + 1000000000, s_name FROM supplier), x AS (SELECT src AS id, 'out' AS direction, kind, dst AS other FROM ce UNION ALL SELECT dst, 'in', kind, src FROM ce), r AS (SELECT x.id, direction, kind, fqname, row_number() OVER (PARTITION BY x.id, direction ORDER BY kind, fqname) AS n FROM x JOIN nm ON other = nm.id) SELECT id, direction, kind, string_agg(fqname, ',' ORDER BY fqname) AS names FROM r WHERE n <= 40 GROUP BY ALL")
def neighbor_edges_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    nodes = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("fqname")).unionByName(s.select((F.col("s_suppkey") + 1_000_000_000).alias("id"), F.col("s_name").alias("fqname")))
    return edges_by_kind(order_edges(spark, sf_dir), nodes).select("id", "direction", "kind", F.array_join("names", ",").alias("names"))


@query(f"WITH {NODES} SELECT fqname, CASE WHEN fqname LIKE '%.%' THEN regexp_replace(fqname, '\\.[^.]*$', '') END AS parent, count(*) OVER (PARTITION BY CASE WHEN fqname LIKE '%.%' THEN regexp_replace(fqname, '\\.[^.]*$', '') END) AS siblings FROM ids")
def parent_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parent's children by name prefix; counts are joined on, so that no parent's children meet in a window."""
    nodes = _ids(spark, sf_dir).select("fqname", parent_name(F.col("fqname")).alias("parent"))
    n = nodes.groupBy("parent").agg(F.count(F.lit(1)).alias("siblings"))
    return nodes.join(n.withColumnRenamed("parent", "p"), F.col("parent").eqNullSafe(F.col("p"))).select("fqname", "parent", "siblings")




@query(f"""WITH {TOP}, vs AS (SELECT c_custkey AS id, c_name AS fqname, 'class' AS kind, 'n' || c_nationkey AS key FROM customer UNION ALL SELECT s_suppkey + 1000000000, s_name, 'function', 'n' || s_nationkey FROM supplier)
SELECT id, fqname, kind, degree, key AS community, CAST(id % 3 AS INTEGER) AS n_annotations FROM tp JOIN vs USING (id)""")
def graph_slice_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top of the trade graph, nations as communities, with counts of verified annotations."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    nodes = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("fqname"), F.lit("class").alias("kind"), F.col("c_nationkey").alias("n")).unionByName(s.select((F.col("s_suppkey") + 1_000_000_000).alias("id"), F.col("s_name").alias("fqname"), F.lit("function").alias("kind"), F.col("s_nationkey").alias("n")))
    marks = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: _annotation(F.lit("role"), F.lit("x"), i < F.col("id") % 3))
    found = nodes.groupBy(F.concat(F.lit("n"), F.col("n").cast("string")).alias("key")).agg(F.count(F.lit(1)).alias("size"), F.collect_list("id").alias("node_ids"))
    return views.graph_slice(nodes.withColumn("annotations", marks), order_edges(spark, sf_dir), found)[0]


@query("SELECT c_custkey AS id, c_name AS fqname, 'class' AS kind FROM customer WHERE c_name = 'Customer#000000042'")
def node_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.get_node(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("fqname"), F.lit("class").alias("kind")), "Customer#000000042")


@query("""WITH m AS (SELECT r_regionkey, r_name, list(n_name ORDER BY n_nationkey) AS ns, list(n_nationkey ORDER BY n_nationkey) AS ks FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT r_regionkey, r_name || chr(10) || chr(10) || 'Subsystems:' || chr(10) || array_to_string(list_transform(ns[1:8], lambda x: '- ' || x || ': nation'), chr(10)) || chr(10) || chr(10) || 'Flows:' || chr(10) || array_to_string(list_transform(ks[1:5], lambda x: '- to ' || x), chr(10)) AS block FROM m""")
def enrichment_block_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    each = n.groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns"))
    model = each.select("r_regionkey", F.col("r_name").alias("summary"), F.transform("ns", lambda x: F.struct(x["n_name"].alias("name"), F.lit("nation").alias("purpose"))).alias("subsystems"), F.transform("ns", lambda x: F.concat(F.lit("to "), x["n_nationkey"].cast("string"))).alias("flows"))
    return views.enrichment_block(model).select("r_regionkey", "block")


@query(f"WITH {SYMBOLS} SELECT fqname, kind, CAST(end_line - start_line + 1 AS INTEGER) AS loc, CAST(fan_in AS INTEGER) AS fan_in, CAST(fan_out AS INTEGER) AS fan_out FROM sy")
def build_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build over Python files of nations and suppliers: nodes with their metrics."""
    return build_graph(extract(source_files(spark, sf_dir, python_only=True))).nodes.select("fqname", "kind", "metrics.loc", "metrics.fan_in", "metrics.fan_out")


@query("""WITH c AS (SELECT (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM supplier) AS s)
SELECT n + s AS n_files, 3 * n + 4 * s AS n_nodes, 2 * n + 6 * s AS n_edges, 3 * n + 4 * s AS n_chunks FROM c""")
def build_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's file has three contained symbols, one base, one import and one call; each nation's two contained ones."""
    return build_graph(extract(source_files(spark, sf_dir, python_only=True))).stats
