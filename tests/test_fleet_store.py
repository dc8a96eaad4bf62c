"""Fleet phases and stored tables (FIXTURES.md A10, A13)."""

import json

from pyspark.sql import functions as F

from lodegraph.operators import fleet
from lodegraph.sources import store

ANN = "array<struct<text:string,kind:string,evidence:array<string>,source:string,verified:boolean,run_id:string,created_at:timestamp>>"


def graph(spark):
    nodes = spark.createDataFrame([(1, "core.add", []), (2, "core.mul", []), (3, "api.handle", [])], f"id long, fqname string, annotations {ANN}")
    chunks = spark.createDataFrame([(1, 1, "def add"), (2, 1, "def mul"), (3, 1, "def handle")], "node_id long, start_line int, text string")
    communities = spark.createDataFrame([("c0", 2, [1, 2]), ("c1", 1, [3])], "key string, size int, node_ids array<long>")
    return communities, nodes, chunks


def steps():
    def step(material, seen):
        if material["subsystem"] == "c1":
            raise RuntimeError("no")
        if not seen:
            return {"tool": "source", "arg": "core.add"}
        return {"findings": [{"target": "core.add", "kind": "role", "text": f"read {seen[0]}"}, {"target": "missing", "text": "x"}, {"target": "core.mul", "text": "bad"}]}

    return step  # made here, so that workers get it by value


def test_fleet(spark):
    nodes, verdicts, phases = fleet.supervise(*graph(spark), steps(), lambda text, source: text.startswith("read") and source == "def add", "run1")
    assert phases == ["planning", "exploring", "critique", "writing"]
    assert {(r.target, r.verdict, r.reason) for r in verdicts.collect()} == {("core.add", "accepted", "judged"), ("missing", "rejected", "target not in graph"), ("core.mul", "rejected", "judged")}
    got = {r.fqname: [(a.text, a.source, a.verified, a.run_id) for a in r.annotations] for r in nodes.collect()}
    assert got == {"core.add": [("read def add", "explorer:c0", True, "run1")], "core.mul": [], "api.handle": []}
    assert fleet.supervise(*graph(spark), steps(), lambda t, s: True, "r", token_budget=1, spent=lambda: 2)[2] == ["planning"]


def test_explorers_use_every_tool(spark):
    nodes = spark.createDataFrame([(1, "core.add", "function", "core.py", 1), (2, "core.mul", "function", "core.py", 4), (3, "api.handle", "function", "api.py", 1), (4, "lone.x", "class", None, None)], "id long, fqname string, kind string, path string, start_line int")
    chunks = spark.createDataFrame([(1, "core.py", 1, "def add(a, b):\n    return a + b"), (2, "core.py", 4, "def mul(a, b):\n    # adding many times\n    return a * b"), (3, "api.py", 1, "def handle(): add(1, 2)")], "node_id long, path string, start_line int, text string")
    edges = spark.createDataFrame([(3, 1, "calls"), (3, 2, "calls"), (1, 2, "imports")], "src long, dst long, kind string")
    subsystems = spark.createDataFrame([("c0", [1, 2]), ("c1", [3, 4])], "subsystem string, node_ids array<long>")
    calls = [("read_file", "core.py"), ("get_node", "core.mul"), ("get_neighbors", "core.add"), ("search_graph", "time"), ("grep", r"return a \*"), ("read_file", "nowhere"), ("fly", "x"), ("grep", "(")]

    def step(material, seen):
        if material["subsystem"] == "c1" or len(seen) == len(calls):
            return {"findings": [{"target": material["names"][0], "text": text} for text in seen or ["nothing"]]}
        return dict(zip(("tool", "arg"), calls[len(seen)]))

    rows = fleet.explore(fleet.bundle(subsystems, nodes, chunks, edges), step, max_steps=20).collect()
    got = [r.text for r in rows if r.subsystem == "c0"]
    assert got[0] == "def add(a, b):\n    return a + b\ndef mul(a, b):\n    # adding many times\n    return a * b"
    assert got[1] == str({"name": "core.mul", "kind": "function", "path": "core.py", "line": 4})
    assert got[2] == str({"in:calls": ["api.handle"], "out:imports": ["core.mul"]})
    assert got[3] == str(["core.mul"]) and got[4] == str(["core.py:6: return a * b"])
    assert all(x.startswith("error") for x in got[5:]) and len(got) == 8
    assert [r.text for r in rows if r.subsystem == "c1"] == ["nothing"]
    assert fleet.explore(fleet.bundle(subsystems, nodes, chunks, edges), step, max_steps=3).where("subsystem = 'c0'").count() == 0
    assert fleet.explore(fleet.bundle(subsystems, nodes, chunks), step, seconds=-1).count() == 0


def test_fleet_with_synthesis_and_limits(spark):
    communities, nodes, chunks = graph(spark)
    nodes = nodes.withColumn("kind", F.lit("function")).unionByName(spark.createDataFrame([(9, "repo", None, "repo")], f"id long, fqname string, annotations {ANN}, kind string"))
    heard, prompts = [], []

    def complete(text):
        prompts.append(text)
        return {"summary": "adds numbers", "subsystems": [{"name": "core", "purpose": "sums"}], "flows": ["in to out"]}

    out, _, phases = fleet.supervise(communities, nodes, chunks, steps(), lambda text, source: text.startswith("read"), "run1", complete=complete, emit=lambda agent, phase: heard.append(phase))
    assert phases == heard == ["planning", "exploring", "synthesis", "critique", "writing"]
    assert "- [role] core.add: read def add" in prompts[0] and "## c1\n(no findings)" in prompts[0]
    assert {r.fqname: [(a.kind, a.text) for a in r.annotations or []] for r in out.collect()}["repo"] == [("repo_model", "adds numbers")]
    assert fleet.supervise(communities, nodes, chunks, steps(), lambda t, s: True, "r", seconds=-1)[2] == ["planning"]


def test_tools_embedding_and_summaries(spark):
    tools = {"echo": lambda x: x * 2000, "bad": lambda x: 1 / 0}
    assert fleet.dispatch(tools, "echo", "a")["result"] == "a" * 1500 and not fleet.dispatch(tools, "bad", "")["ok"] and "unknown tool" in fleet.dispatch(tools, "x", "")["result"]
    rows = spark.createDataFrame([(i, "t" * i * 50 if i != 3 else None) for i in range(1, 140)], "id long, text string").coalesce(1)

    def model(texts):
        assert len(texts) <= 100
        return [[float(len(t))] for t in texts]

    got = {r.id: r.embedding for r in fleet.embed(rows, "text", model).collect()}
    assert got[2] == [100.0] and got[3] is None and got[139] == [4000.0]
    communities, nodes, _ = graph(spark)
    assert [tuple(r) for r in fleet.summarise_communities(communities, nodes, lambda p: p.replace("\n", "+")).collect()] == [("c0", "core.add+core.mul"), ("c1", "api.handle")]
    assert fleet.summarise_communities(communities, nodes, lambda p: 1 / 0).count() == 0


def test_escalation(spark):
    _, nodes, chunks = graph(spark)
    found = spark.createDataFrame([(1, 0.9), (2, 0.5)], "id long, score double")
    out, n = fleet.escalate("what adds?", found, nodes, chunks, steps(), lambda text, source: text.startswith("read"), "e1")
    assert n == 1 and {r.fqname: len(r.annotations) for r in out.collect()} == {"core.add": 1, "core.mul": 0, "api.handle": 0}
    assert fleet.escalate("q", spark.createDataFrame([(1,)], "id long"), nodes, chunks, steps(), lambda t, s: True, "e2")[1] == 0


def test_structured_replies(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ("not json",), (None,)], "reply string")
    assert [(r.is_valid, r.parsed.a if r.parsed else None) for r in fleet.structured(rows, "reply", "a int").collect()] == [(True, 1), (False, None), (False, None)]


def test_store(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("r1", 1, "a"), ("r2", 2, "b")], "repo_id string, id long, summary string")
    store.append(rows, path)
    for _ in range(2):
        store.replace(rows.where("repo_id = 'r1'").withColumn("summary", F.lit("new")), path)
    assert {(r.id, r.summary) for r in store.read(spark, path).collect()} == {(1, "new"), (2, "b")}
    store.update(spark.createDataFrame([(2, "z"), (9, "y")], "id long, summary string"), path, "id")
    assert {(r.id, r.summary) for r in store.read(spark, path).collect()} == {(1, "new"), (2, "z")}
    assert [r.id for r in store.read(spark, path, values=["r2"]).collect()] == [2]
    repos = spark.createDataFrame([("x", "u", "indexed", None), ("y", "u", "failed", None)], "id string, url string, status string, created_at timestamp").withColumn("created_at", F.when(F.col("id") == "x", F.lit("2024-01-02").cast("timestamp")).otherwise(F.lit("2024-01-01").cast("timestamp")))
    got = {(r.url, r.status) for r in store.get_or_create(repos, spark.createDataFrame([("u",), ("v",)], "url string")).collect()}
    assert got == {("u", "indexed"), ("v", "pending")}
    (tmp_path / "g.json").write_text(json.dumps({"repo_url": "r", "cases": [{"id": "q", "question": "?", "expected_paths": ["a"], "expected_keywords": []}]}))
    assert [(r.id, r.expected_paths, r.optional_paths) for r in store.golden_cases(spark, str(tmp_path / "g.json")).collect()] == [("q", ["a"], None)]
    assert store.health(spark)["vectors"] and store.health(spark)["stemming"]
