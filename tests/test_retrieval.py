"""Fusion, keyword and vector signals, expansion, verification (FIXTURES.md A6, A7)."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodegraph.operators import retrieval as R
from lodegraph.operators.verify import verify


def ranks(spark, ids):
    return spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id long, rank0 int")


def test_fusion(spark):
    rows = R.fuse({"a": ranks(spark, [5, 1, 2]), "b": ranks(spark, [5, 3, 4])}, "id").orderBy(F.col("score").desc(), "id").collect()
    assert rows[0].id == 5 and rows[0].signals == ["a", "b"] and rows[0].score == round(2 / 61, 9)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.permutations([1, 2, 3, 4]), st.permutations([3, 4, 5, 6]))
def test_fusion_scores_do_not_depend_on_the_order_of_signals(spark, a, b):
    score = lambda signals: {r.id: r.score for r in R.fuse(signals, "id").collect()}
    one = score({"a": ranks(spark, a), "b": ranks(spark, b)})
    assert one == score({"b": ranks(spark, b), "a": ranks(spark, a)})
    assert one == {i: round(sum(1 / (61 + x.index(i)) for x in (a, b) if i in x), 9) for i in set(a) | set(b)}


def test_bm25_by_formula(spark):
    docs = spark.createDataFrame([(1, "red red fox"), (2, "Red dog"), (3, "a b c d"), (4, None)], "id long, text string")
    got = {r.id: r.score for r in R.bm25(docs, "id", "text", ["red", "fox"]).collect()}
    n, mean = 4, 9 / 4
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda tf, size, df: idf(df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))
    assert got == {1: round(part(2, 3, 2) + part(1, 3, 1), 6), 2: round(part(1, 2, 2), 6)}
    assert [r.id for r in R.bm25(docs, "id", "text", ["red", "fox"], all_terms=True).collect()] == [1]


def test_dense_expand_hydrate(spark):
    nodes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "id long, v array<float>")
    top = R.ranked(R.dense(nodes, "id", "v", [0.0, 1.0]), "id", "distance", ascending=True)
    assert [(r.id, r.rank0) for r in top.collect()] == [(2, 0), (1, 1)]
    fused = R.fuse({"dense": top.limit(1)}, "id")
    edges = spark.createDataFrame([(2, 9, "calls"), (8, 2, "imports"), (8, 7, "calls")], "src long, dst long, kind string")
    out = R.expand(fused, edges, "id", 10)
    assert [(r.id, r.signals) for r in out.collect()] == [(2, ["dense"]), (8, ["graph"]), (9, ["graph"])]
    names = spark.createDataFrame([(2, "two"), (8, "eight")], "id long, name string")
    chunks = spark.createDataFrame([(2, 9, 12, "late"), (2, 1, 3, "first")], "id long, start_line int, end_line int, text string")
    got = {r.id: (r.name, r.snippet) for r in R.hydrate(out, names, chunks, "id").collect()}
    assert got == {2: ("two", "first"), 8: ("eight", None)}


def test_verifier(spark):
    chunks = spark.createDataFrame([("app/m.py", 1, 3, 'def compute(x):\n    """Add."""\n    return x + 1'), ("app/m.py", 4, 5, "def\n  after(): pass")], "path string, start_line int, end_line int, text string")
    cites = [(1, "app/m.py", 1, 3, "def compute(x):"), (2, "does/not/exist.py", 1, 3, "whatever"), (3, "app/m.py", 1, 3, "def totally_made_up_function():"), (4, "app/m.py", 9000, 9010, None), (5, "app/m.py", 2, 3, "return x + 1 def after():"), (6, "app/m.py", 1, 1, " ")]
    got = {r.cid: (r.verified, r.reason) for r in verify(spark.createDataFrame(cites, "cid long, path string, start_line int, end_line int, quote string"), chunks).collect()}
    assert got == {1: (True, "ok"), 2: (False, "path 'does/not/exist.py' not in repo"), 3: (False, "quoted snippet not found near cited lines"), 4: (False, "no source at app/m.py:9000-9010"), 5: (True, "ok"), 6: (True, "ok")}
