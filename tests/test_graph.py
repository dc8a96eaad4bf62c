"""Graph resolution, metrics, traversal and communities (FIXTURES.md A4, A8, A9)."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodegraph.operators import graph, spatial
from lodegraph.operators.communities import communities, xxhash64
from lodegraph.sources.files import extract

FILES = {
    "app/service.py": "from app.base import Base\n\n\nclass Service(Base):\n    def run(self):\n        return compute(1)\n\n\ndef compute(x):\n    return x\n",
    "app/base.py": "class Base:\n    def describe(self):\n        return 'base'\n",
}


def build(spark):
    files = spark.createDataFrame([(p, bytearray(s.encode())) for p, s in FILES.items()], "path string, content binary")
    found = extract(files)
    symbols = found.selectExpr("path", "posexplode(symbols) as (ord, s)").select("path", "ord", "s.*")
    nodes = graph.with_ids(graph.first_symbols(symbols, "path", "ord"), "path", "ord")
    index = graph.name_index(symbols, "path", "ord")
    contains = symbols.where("parent is not null").select(F.col("parent").alias("src_name"), F.col("fqname").alias("dst_name"), F.lit("contains").alias("kind"), F.lit(1.0).alias("confidence"))
    inherits = graph.resolved(symbols.select(F.col("fqname").alias("src_name"), F.explode("bases").alias("base")), index, "base", dotted=False).select("src_name", F.col("target").alias("dst_name"), F.lit("inherits").alias("kind"), "confidence")
    calls = graph.resolved(found.selectExpr("inline(calls)"), index, "callee", dotted=True).select(F.col("caller").alias("src_name"), F.col("target").alias("dst_name"), F.lit("calls").alias("kind"), "confidence")
    modules = symbols.where("kind = 'file'").select(F.col("fqname").alias("module"))
    imports = found.selectExpr("symbols[0].fqname as importer", "inline(imports)")
    imported = graph.import_edges(imports, modules).select(F.col("importer").alias("src_name"), F.col("dst").alias("dst_name"), F.lit("imports").alias("kind"), F.lit(1.0).alias("confidence"))
    raw = contains.unionByName(inherits).unionByName(imported).unionByName(calls)
    return nodes, graph.guarded(raw, nodes, "src_name", "dst_name")


def test_two_files(spark):
    nodes, edges = build(spark)
    names = {r.id: r.fqname for r in nodes.collect()}
    assert len(names) == 7 and sorted(names) == list(range(1, 8))
    got = {(names[e.src], names[e.dst], e.kind, e.confidence) for e in edges.collect()}
    assert got == {
        ("app.service.Service", "app.service.Service.run", "contains", 1.0), ("app.service", "app.service.Service", "contains", 1.0), ("app.service", "app.service.compute", "contains", 1.0),
        ("app.base", "app.base.Base", "contains", 1.0), ("app.base.Base", "app.base.Base.describe", "contains", 1.0), ("app.service.Service", "app.base.Base", "inherits", 1.0),
        ("app.service", "app.base", "imports", 1.0), ("app.service.Service.run", "app.service.compute", "calls", 1.0),
    }
    fans = {names[r.id]: (r.fan_in, r.fan_out) for r in graph.fans(edges).collect()}
    assert fans == {"app.service.compute": (1, 0), "app.service.Service.run": (0, 1)}


def test_names_of_several_candidates(spark):
    symbols = spark.createDataFrame([("a.run", 1), ("b.run", 2), ("c.only", 3)], "fqname string, ord int")
    index = graph.name_index(symbols, "ord")
    calls = spark.createDataFrame([("x", "run"), ("x", "obj.run"), ("x", "only"), ("x", "obj.only"), ("x", "none")], "caller string, callee string")
    got = {(r.callee, r.target, r.confidence) for r in graph.resolved(calls, index, "callee", dotted=True).collect()}
    assert got == {("run", "a.run", 0.5), ("obj.run", "a.run", 0.5), ("only", "c.only", 1.0), ("obj.only", "c.only", 0.4)}


def test_guard_drops_loops_repeats_and_strangers(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 2)], "fqname string, id long")
    raw = spark.createDataFrame([("a", "b", "calls", 1.0, 0), ("a", "b", "calls", 0.5, 1), ("a", "a", "calls", 1.0, 2), ("a", "zz", "calls", 1.0, 3)], "src_name string, dst_name string, kind string, confidence double, ord int")
    once = graph.guarded(raw, nodes, "ord")
    assert [tuple(r) for r in once.collect()] == [(1, 2, "calls", 1.0)]


def test_communities_of_two_pairs(spark):
    edges = spark.createDataFrame([(1, 2, "calls", 1.0), (2, 1, "imports", 1.0), (3, 4, "calls", 1.0), (4, 3, "imports", 1.0), (1, 3, "contains", 1.0)], "src long, dst long, kind string, confidence double")
    pairs = graph.weighted(edges)
    assert {(r.a, r.b, r.w) for r in pairs.collect()} == {(1, 2, 1.6), (3, 4, 1.6)}
    labels = communities(pairs)
    rows = {r.key: r.node_ids for r in graph.community_rows(labels).collect()}
    assert rows == {"c0": [1, 2], "c1": [3, 4]}
    assert abs(graph.modularity(pairs, labels).first()[0] - 0.5) < 1e-9


def test_communities_split_a_barbell(spark):
    ring = [(i, j) for base in (0, 10) for i in range(base, base + 5) for j in range(i + 1, base + 5)] + [(4, 10)]
    pairs = spark.createDataFrame([(a, b, 1.0) for a, b in ring], "a long, b long, w double")
    labels = communities(pairs)
    assert {tuple(r.node_ids) for r in graph.community_rows(labels).collect()} == {tuple(range(5)), tuple(range(10, 15))}
    whole = labels.withColumn("label", F.lit(0))
    assert graph.modularity(pairs, labels).first()[0] > graph.modularity(pairs, whole).first()[0]


def test_slice_and_hops(spark):
    edges = spark.createDataFrame([(1, 2, "calls", 1.0), (2, 3, "calls", 1.0), (3, 4, "calls", 1.0)], "src long, dst long, kind string, confidence double")
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    top = graph.top_nodes(nodes, edges, 3)
    assert [r.id for r in top.collect()] == [2, 3, 1, 4, 5]
    top = top.limit(3)
    assert {(r.src, r.dst) for r in graph.induced(edges, top).collect()} == {(1, 2), (2, 3)}
    assert {(r.id, r.hops) for r in graph.hops(edges, nodes.where("id = 1"), 2).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert {(r.id, r.component) for r in graph.components(edges).collect()} == {(i, 1) for i in range(1, 5)}


def test_components_of_large_ids_and_long_chains(spark):
    top = 9_223_372_036_854_775_807
    edges = spark.createDataFrame([(top - i, top - i - 1) for i in range(60)] + [(1, 2)], "src long, dst long")
    got = {r.id: r.component for r in graph.components(edges).collect()}
    assert got == {**{top - i: top - 60 for i in range(61)}, 1: 1, 2: 1}
    with pytest.raises(RuntimeError):
        graph.components(edges, rounds=2)


def split_by_hand(pairs, label):
    """Modularity by its formula, and whether each community is connected."""
    m, inside = sum(pairs.values()), {}
    for (a, b), w in pairs.items():
        inside[label[a]] = inside.get(label[a], 0) + (w if label[a] == label[b] else 0)
    connected = True
    for c in set(label.values()):
        members = {i for i in label if label[i] == c}
        reached, front = set(), {c}
        while front:
            reached |= front
            front = {y for x in front for p in pairs if x in p for y in p if y in members} - reached
        connected &= reached == members
    totals = {}
    for (a, b), w in pairs.items():
        for x in (a, b):
            totals[label[x]] = totals.get(label[x], 0) + w
    return sum(inside.get(c, 0) / m - (t / (2 * m)) ** 2 for c, t in totals.items()), connected


def table_of(spark, pairs):
    return spark.createDataFrame([(a, b, float(w)) for (a, b), w in pairs.items()], "a long, b long, w double")


# The friendships of a karate club, a published graph whose best modularity is known to be 0.4198.
CLUB = """1 2 1 3 1 4 1 5 1 6 1 7 1 8 1 9 1 11 1 12 1 13 1 14 1 18 1 20 1 22 1 32 2 3 2 4 2 8 2 14 2 18 2 20 2 22 2 31 3 4 3 8 3 9 3 10 3 14 3 28 3 29 3 33 4 8 4 13 4 14 5 7 5 11 6 7 6 11 6 17 7 17 9 31 9 33 9 34 10 34 14 34
15 33 15 34 16 33 16 34 19 33 19 34 20 34 21 33 21 34 23 33 23 34 24 26 24 28 24 30 24 33 24 34 25 26 25 28 25 32 26 32 27 30 27 34 28 34 29 32 29 34 30 33 30 34 31 33 31 34 32 33 32 34 33 34""".split()


def test_communities_of_the_club_in_a_task_and_by_joins(spark):
    pairs = {(int(a), int(b)): 1.0 for a, b in zip(CLUB[::2], CLUB[1::2])}
    found = [{r.id: r.label for r in communities(table_of(spark, pairs), local_pairs=n).collect()} for n in (10_000, 0)]
    assert found[0] == found[1]
    value, connected = split_by_hand(pairs, found[0])
    assert connected and abs(value - 0.4198) < 1e-4


def test_communities_are_the_same_below_and_above_the_bound(spark):
    rng = random.Random(1)
    pairs = {}
    for _ in range(200):
        a = rng.randrange(40)
        b = a // 10 * 10 + rng.randrange(10) if rng.random() < 0.9 else rng.randrange(40)
        if a != b:
            pairs[min(a, b), max(a, b)] = pairs.get((min(a, b), max(a, b)), 0) + rng.choice([0.4, 0.6, 1.0])
    found = [{r.id: r.label for r in communities(table_of(spark, pairs), local_pairs=n).collect()} for n in (10_000, 0)]
    assert found[0] == found[1]
    value, connected = split_by_hand(pairs, found[0])
    planted, _ = split_by_hand(pairs, {i: i // 10 * 10 for i in found[0]})
    assert connected and value >= planted - 1e-9


def test_hash_is_that_of_spark(spark):
    ids = [0, 1, -1, 5, 1 << 62, -(1 << 63)]
    rows = spark.createDataFrame([(i,) for i in ids], "id long").select(F.xxhash64("id", F.lit(7).cast("long")).alias("h")).collect()
    assert [r.h for r in rows] == xxhash64(np.array(ids), 7).tolist()


def test_community_rows_name_some_members_and_membership_all(spark):
    labels = spark.createDataFrame([(i, 0 if i < 300 else 300) for i in range(350)], "id long, label long").repartition(4)
    rows = {r.key: (r.size, r.node_ids) for r in graph.community_rows(labels, members=5).collect()}
    assert rows == {"c0": (300, [0, 1, 2, 3, 4]), "c1": (50, [300, 301, 302, 303, 304])}
    assert {(r.id, r.key) for r in graph.membership(labels).collect()} == {(i, "c0" if i < 300 else "c1") for i in range(350)}


def test_nearest_by_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8)).round(1)
    v[7] = v[9]
    v[11] = 0
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)] + [(500, None)]
    e = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    got = {}
    for r in spatial.nearest(e, e.where("id % 7 = 0"), 3, block=10, round_bytes=900).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.other)
    f = v.astype(np.float32).astype(float)
    for i in range(0, 300, 7):
        d = [(round(float(1 - f[i] @ f[j] / (np.linalg.norm(f[i]) * np.linalg.norm(f[j]))), 6), j) for j in range(300) if j != i and f[j].any()]
        assert got[i] == [j for _, j in sorted(d)[:3]]


def test_nearest_of_many_queries_holds_a_bounded_part(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(100_000, 16)).astype(np.float32)
    e = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(v)), "embedding": v.tolist()}), "id long, embedding array<float>").repartition(8)
    got = {(r.id, r.rank): r.other for r in spatial.nearest(e, e.where("id % 100 = 0"), 3).collect()}
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    for q in range(0, 100_000, 9900):
        d = np.round(1 - unit[q] @ unit.T, 6)
        d[q] = np.inf
        assert [got[q, r] for r in (1, 2, 3)] == np.lexsort((np.arange(len(d)), d))[:3].tolist()
    assert len(got) == 3000


def test_pairs_within_a_cutoff_by_brute_force(spark):
    rng = random.Random(4)
    points = [(i, rng.choice([rng.uniform(-3, 3), round(rng.uniform(-3, 3), 1), 0.5]), round(rng.uniform(-3, 3), 1)) for i in range(400)]
    points += [(1000 + i, 0.25, 0.25) for i in range(60)] + [(2000, None, 1.0), (2001, float("nan"), 1.0), (2002, float("inf"), 1.0), (-5, 0.25, 0.35)]
    df = spark.createDataFrame(points, "id long, x double, y double").repartition(6)
    for cutoff in (0.1, 0.7, 0.0):
        want = {(min(a, b), max(a, b)) for i, (a, x, y) in enumerate(points) for b, u, v in points[:i] if x is not None and u is not None and x == x and u == u and abs(x) < 9 and abs(u) < 9 and (x - u) * (x - u) + (y - v) * (y - v) <= cutoff * cutoff}
        got = [(r.a, r.b) for r in spatial.within(df, cutoff, hot=16).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_repulsion_by_brute_force(spark):
    rng = random.Random(6)
    points = [(i, rng.uniform(0, 4), rng.uniform(0, 4)) for i in range(80)] + [(80, 1.0, 1.0), (81, 1.0, 1.0), (99, 50.0, 50.0)]
    push, k = {}, 0.5
    for i, (a, x, y) in enumerate(points):
        for b, u, v in points[i + 1 :]:
            ex, ey = x - u, y - v
            d2 = ex * ex + ey * ey
            if d2 <= (2.5 * k) ** 2:
                ex, ey, d2 = (0.1, 0.1, 0.02) if d2 < 0.01 else (ex, ey, d2)
                for n, sign in ((a, 1), (b, -1)):
                    p = push.setdefault(n, [0.0, 0.0])
                    p[0] += sign * ex * k * k / d2
                    p[1] += sign * ey * k * k / d2
    got = {r.id: (r.dx, r.dy) for r in spatial.repulsion(spark.createDataFrame(points, "id long, x double, y double"), k).collect()}
    assert got.keys() == push.keys() and all(abs(got[n][0] - p[0]) < 1e-9 and abs(got[n][1] - p[1]) < 1e-9 for n, p in push.items())


def test_ranges_meet_once_over_bins(spark):
    rng = random.Random(8)
    left = [(i, rng.choice("ab"), s, s + rng.randint(-3, 200)) for i in range(60) for s in [rng.randint(-50, 900)]] + [(900, "a", -(10**12), 10**12), (901, "c", 1, 5)]
    right = [(i, rng.choice("abd"), s, s + rng.randint(-1, 90)) for i in range(200) for s in [rng.randint(0, 900)]]
    l = spark.createDataFrame(left, "cid long, path string, s long, e long")
    r = spark.createDataFrame(right, "rid long, path string, f long, t long")
    got = [(x.cid, x.rid) for x in spatial.meeting(l, r, "path", F.col("s"), F.col("e"), F.col("f"), F.col("t"), width=16).collect()]
    want = {(i, j) for i, p, s, e in left for j, q, f, t in right if p == q and s <= e and f <= t and s <= t and f <= e}
    assert len(got) == len(set(got)) and set(got) == want
