"""The agent fleet as dataflow: plan, explore in parallel, criticise, synthesise, write back; models are plain functions."""

from __future__ import annotations

import math
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.stemming import stem
from lodegraph.operators.enrich import write_back
from lodegraph.operators.tools import MAX_HITS
from lodegraph.operators.views import SEARCHED
from lodegraph.session import checkpointed

MAX_SUBSYSTEMS, MAX_STEPS, MAX_CALLS, RESULT_CHARS, SOURCE_CHARS = 8, 8, 10, 1500, 3500
EMBED_BATCH, EMBED_CHARS, MAX_SECONDS = 100, 4000, 900
FINDINGS = "subsystem string, target string, kind string, text string, evidence array<string>"
Step = Callable[[dict, list[str]], dict]


def plan(communities: DataFrame, limit: int = MAX_SUBSYSTEMS) -> DataFrame:
    """Subsystems: the largest communities. communities: key, size, node_ids."""
    return communities.orderBy(F.col("size").desc(), "key").limit(limit).select(F.col("key").alias("subsystem"), "node_ids")


def tool_results(subsystems: DataFrame, nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """What a critic may read of each subsystem: fqname and source, cut, joined once for all of them."""
    members = subsystems.select("subsystem", F.explode("node_ids").alias("id"))
    text = chunks.groupBy(F.col("node_id").alias("id")).agg(F.min_by("text", "start_line").alias("source"))
    return members.join(nodes.select("id", "fqname"), "id").join(text, "id", "left").select("subsystem", "fqname", F.left("source", F.lit(RESULT_CHARS)).alias("source"))


def bundle(subsystems: DataFrame, nodes: DataFrame, chunks: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """All that an explorer's tools read, as rows of one subsystem: its nodes, their chunks, and the edges that touch them,
    in one table that is dealt by subsystem once. nodes: id, fqname, and kind, path, start_line where they have them;
    chunks: node_id, start_line, text, and path; edges: src, dst, kind."""
    members = subsystems.select("subsystem", F.explode("node_ids").alias("id"))
    given = lambda df, c, kind="string": F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
    columns = lambda part, name, other, kind, path, line, text: [F.lit(part).alias("part"), name.alias("name"), other.alias("other"), kind.alias("kind"), path.alias("path"), line.alias("line"), text.alias("text")]
    none = F.lit(None).cast("string")
    own = members.join(nodes, "id")
    rows = own.select("subsystem", *columns("node", F.col("fqname"), none, given(nodes, "kind"), given(nodes, "path"), given(nodes, "start_line", "int"), none))
    c = chunks.select(F.col("node_id").alias("id"), given(chunks, "path").alias("c_path"), F.col("start_line").cast("int").alias("c_line"), "text")
    rows = rows.unionByName(own.select("subsystem", "id", "fqname", given(nodes, "path").alias("n_path")).join(c, "id").select("subsystem", *columns("chunk", F.col("fqname"), none, none, F.coalesce("c_path", "n_path"), F.col("c_line"), F.col("text"))))
    if edges is not None:
        names = nodes.select(F.col("id").alias("at"), F.col("fqname").alias("there"))
        ends = lambda a, b: edges.select(F.col(a).alias("id"), F.col(b).alias("at"), F.col("kind").alias("e_kind"))
        for way, e in (("out", ends("src", "dst")), ("in", ends("dst", "src"))):
            met = own.select("subsystem", "id", "fqname").join(e, "id").join(names, "at")
            rows = rows.unionByName(met.select("subsystem", *columns(way, F.col("fqname"), F.col("there"), F.col("e_kind"), none, F.lit(None).cast("int"), none)))
    return rows


def toolkit(pdf: pd.DataFrame) -> dict[str, Callable[[str], object]]:
    """The tools of one subsystem over its rows of a bundle: read_file, get_node, get_neighbors, search_graph, grep, and
    source (a node's first chunk). An argument that names nothing raises, which the dispatch turns into an error."""
    pdf = pdf.astype(object).where(pdf.notna(), None)
    of = {part: rows.to_dict("records") for part, rows in pdf.groupby("part", sort=False)}
    nodes = {r["name"]: r for r in of.get("node", [])}
    chunks = sorted(of.get("chunk", []), key=lambda r: (r["path"] or "", r["line"] or 0, r["name"]))
    files: dict[str, list[dict]] = {}
    sources: dict[str, str] = {}
    index: dict[str, Counter] = {}
    for r in chunks:
        files.setdefault(r["path"] or "", []).append(r)
        sources.setdefault(r["name"], r["text"] or "")
        for w in re.findall(r"[^\W_]+", f"{r['name']} {r['text']}".lower()):
            index.setdefault(stem(w), Counter())[r["name"]] += 1
    for name in nodes:
        for w in re.findall(r"[^\W_]+", name.lower()):
            index.setdefault(stem(w), Counter())[name] += 1

    def read_file(path: str) -> str:
        return "\n".join(dict.fromkeys(r["text"] or "" for r in files[path]))

    def get_node(name: str) -> dict:
        r = nodes[name]
        return {"name": name, "kind": r["kind"], "path": r["path"], "line": r["line"] if r["line"] is None else int(r["line"])}

    def get_neighbors(name: str) -> dict[str, list[str]]:
        if name not in nodes:
            raise KeyError(name)
        found: dict[str, set[str]] = {}
        for way in ("out", "in"):
            for r in of.get(way, []):
                if r["name"] == name:
                    found.setdefault(f"{way}:{r['kind']}", set()).add(r["other"])
        return {k: sorted(v)[:MAX_HITS] for k, v in sorted(found.items())}

    def search_graph(query: str) -> list[str]:
        hits: Counter = Counter()
        for term in {stem(w) for w in re.findall(r"[^\W_]+", query.lower())}:
            for name, n in index.get(term, {}).items():
                hits[name] += math.log1p(len(nodes) / len(index[term])) * n / (n + 1.2)
        return [name for name, _ in sorted(hits.items(), key=lambda x: (-x[1], x[0]))[:SEARCHED]]

    def grep(pattern: str) -> list[str]:
        wanted = re.compile(pattern)
        rows = {(r["path"] or r["name"], int(r["line"] or 1) + i, text.strip()[:200]) for r in chunks for i, text in enumerate((r["text"] or "").split("\n")) if wanted.search(text)}
        return [f"{path}:{line}: {text}" for path, line, text in sorted(rows)[:MAX_HITS]]

    return {"read_file": read_file, "get_node": get_node, "get_neighbors": get_neighbors, "search_graph": search_graph, "grep": grep, "source": lambda name: sources[name]}


def explore(materials: DataFrame, step: Step, max_steps: int = MAX_STEPS, max_calls: int = MAX_CALLS, seconds: float = MAX_SECONDS) -> DataFrame:
    """Findings of every subsystem: a bounded loop of steps, each a call of one tool or the findings. materials: a bundle.
    step takes the subsystem with its names and the results so far, each cut to RESULT_CHARS, and gives {"tool", "arg"} or
    {"findings": [...]}. A tool that is unknown or fails gives an error to read on with; a step that raises, or one that
    never finishes within the steps, calls and seconds, leaves no findings. A subsystem's rows are those of one community
    of the plan, whose members are bounded."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        subsystem, began = pdf["subsystem"].iloc[0], time.monotonic()
        tools = toolkit(pdf)
        names = sorted(pdf.loc[pdf["part"] == "node", "name"])
        seen: list[str] = []
        found: list[dict] = []
        try:
            for _ in range(max_steps):
                if time.monotonic() - began > seconds:
                    break
                decision = step({"subsystem": subsystem, "names": names}, seen)
                if "findings" in decision:
                    found = decision["findings"]
                    break
                if len(seen) >= max_calls:
                    break
                seen.append(dispatch(tools, decision.get("tool", ""), decision.get("arg", ""))["result"])
        except Exception:  # an explorer that fails reports nothing
            found = []
        rows = [(subsystem, f["target"], f.get("kind", "role"), f["text"], list(f.get("evidence", []))) for f in found]
        return pd.DataFrame(rows, columns=["subsystem", "target", "kind", "text", "evidence"])

    return materials.groupBy("subsystem").applyInPandas(run, FINDINGS)


def criticise(findings: DataFrame, nodes: DataFrame, sources: DataFrame, judge: Callable[[str, str], bool]) -> DataFrame:
    """findings with verdict and reason. A missing target is rejected before any judge is asked; the judge sees at most
    SOURCE_CHARS of the target's source. sources: fqname, source."""
    known = findings.join(nodes.select(F.col("fqname").alias("target")), "target", "left_semi").join(sources.select(F.col("fqname").alias("target"), F.left("source", F.lit(SOURCE_CHARS)).alias("source")), "target", "left")
    missing = findings.join(nodes.select(F.col("fqname").alias("target")), "target", "left_anti").withColumns({"verdict": F.lit("rejected"), "reason": F.lit("target not in graph")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [judge(t, s or "") for t, s in zip(pdf["text"], pdf["source"], strict=True)]
            yield pdf.drop(columns="source").assign(verdict=["accepted" if x else "rejected" for x in ok], reason=["judged" for _ in ok])

    columns = ["target", "subsystem", "kind", "text", "evidence"]
    judged = known.select(*columns, "source").mapInPandas(run, "target string, subsystem string, kind string, text string, evidence array<string>, verdict string, reason string")
    return judged.unionByName(missing.select(*columns, "verdict", "reason"))


def persist(nodes: DataFrame, verdicts: DataFrame, run_id: str) -> DataFrame:
    """nodes with the accepted findings as verified annotations that say where they are from."""
    a = F.struct("text", "kind", "evidence", F.concat(F.lit("explorer:"), "subsystem").alias("source"), F.lit(True).alias("verified"), F.lit(run_id).alias("run_id"), F.lit(None).cast("timestamp").alias("created_at"))
    accepted = verdicts.where("verdict = 'accepted'").select("target", F.struct("subsystem", "kind", "text").alias("ord"), a.alias("a"))
    return write_back(nodes, accepted)


def structured(replies: DataFrame, reply: str, schema: str) -> DataFrame:
    """replies with parsed (null if a reply does not fit) and is_valid."""
    parsed = F.from_json(reply, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = replies.withColumn("_parsed", parsed)
    valid = F.col("_parsed").isNotNull() & F.col("_parsed._bad").isNull()
    return rows.withColumn("is_valid", valid).withColumn("parsed", F.when(F.col("is_valid"), F.col("_parsed").dropFields("_bad"))).drop("_parsed")


def dispatch(tools: dict[str, Callable[[str], object]], action: str, argument: str) -> dict:
    """One tool call; a tool that is unknown or raises gives an error row."""
    if action not in tools:
        return {"tool": action, "ok": False, "result": f"error: unknown tool {action}"}
    try:
        return {"tool": action, "ok": True, "result": str(tools[action](argument))[:RESULT_CHARS]}
    except Exception as error:
        return {"tool": action, "ok": False, "result": f"error: {error}"}


def reports(subsystems: DataFrame, findings: DataFrame) -> DataFrame:
    """subsystem and report: what the synthesizer reads, each subsystem's findings as lines; none says so."""
    line = F.format_string("- [%s] %s: %s", "kind", "target", "text")
    each = findings.groupBy("subsystem").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    rows = subsystems.select("subsystem").join(each, "subsystem", "left")
    return rows.select("subsystem", F.concat(F.lit("## "), "subsystem", F.lit("\n"), F.coalesce("lines", F.lit("(no findings)"))).alias("report"))


def synthesise(reports: DataFrame, complete: Callable[[str], dict]) -> DataFrame:
    """One row: summary, subsystems, flows of the model made of all reports, of which there are MAX_SUBSYSTEMS at most."""
    text = "\n\n".join(r.report for r in reports.orderBy("subsystem").limit(MAX_SUBSYSTEMS).collect())
    model = complete(text)
    row = (model.get("summary", ""), [(s["name"], s.get("purpose")) for s in model.get("subsystems", [])], list(model.get("flows", [])))
    return reports.sparkSession.createDataFrame([row], "summary string, subsystems array<struct<name:string,purpose:string>>, flows array<string>")


def embed(rows: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]], name: str = "embedding", batch: int = EMBED_BATCH, chars: int = EMBED_CHARS) -> DataFrame:
    """rows with a vector of their text, whose first chars count, asked for in batches; a null text has none."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        known = [(i, t[:chars]) for i, t in enumerate(texts) if t is not None]
        out: list[list[float] | None] = [None] * len(texts)
        for at in range(0, len(known), batch):
            part = known[at : at + batch]
            for (i, _), v in zip(part, model([t for _, t in part]), strict=True):
                out[i] = v
        return pd.Series(out)

    return rows.withColumn(name, vectors(F.col(text)))


def summarise_communities(communities: DataFrame, nodes: DataFrame, complete: Callable[[str], str], limit: int = 20, members: int = 25) -> DataFrame:
    """key and summary of the largest communities, from their first members' names; the first failure ends it."""
    top = communities.orderBy(F.col("size").desc(), "key").limit(limit)
    named = top.select("key", "size", F.explode(F.slice("node_ids", 1, members)).alias("id")).join(nodes.select("id", "fqname"), "id")
    prompts = named.groupBy("key", "size").agg(F.array_join(F.array_sort(F.collect_list("fqname")), "\n").alias("prompt")).orderBy(F.col("size").desc(), "key").collect()  # limit rows
    done = []
    for r in prompts:
        try:
            done.append((r.key, complete(r.prompt)))
        except Exception:
            break
    return nodes.sparkSession.createDataFrame(done, "key string, summary string")


def escalate(question: str, retrieved: DataFrame, nodes: DataFrame, chunks: DataFrame, step: Step, judge: Callable[[str, str], bool], run_id: str, seeds: int = 6, edges: DataFrame | None = None) -> tuple[DataFrame, int]:
    """nodes with what one explorer found around the best seeds and a critic let pass, and how many findings were
    written; any failure leaves nodes as they were. retrieved: id, score."""
    try:
        top = retrieved.orderBy(F.col("score").desc(), "id").limit(seeds)
        subsystem = top.agg(F.collect_list("id").alias("node_ids")).select(F.lit(question).alias("subsystem"), "node_ids")
        materials = tool_results(subsystem, nodes, chunks)
        verdicts = checkpointed(criticise(explore(bundle(subsystem, nodes, chunks, edges), step), nodes, materials.groupBy("fqname").agg(F.min("source").alias("source")), judge))
        return persist(nodes, verdicts, run_id), verdicts.where("verdict = 'accepted'").count()
    except Exception:  # an escalation never fails its question
        return nodes, 0


def supervise(communities: DataFrame, nodes: DataFrame, chunks: DataFrame, step: Step, judge: Callable[[str, str], bool], run_id: str, token_budget: int | None = None, spent: Callable[[], int] = lambda: 0, complete: Callable[[str], dict] | None = None, seconds: float = MAX_SECONDS, emit: Callable[[str, str], None] = lambda agent, phase: None, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """The phases in order, checks of budget and time between them: nodes with annotations, verdicts, and the phases that
    ran, each of which emit hears of. Rejected findings of known targets are judged once more. With complete, a model
    of the whole is made of the reports and written to the repository's node."""
    began, phases = time.monotonic(), []

    def enter(phase: str) -> None:
        phases.append(phase)
        emit("supervisor", phase)

    over = lambda: (token_budget is not None and spent() >= token_budget) or time.monotonic() - began > seconds
    enter("planning")
    subsystems = checkpointed(plan(communities))
    materials = checkpointed(tool_results(subsystems, nodes, chunks))
    verdicts = nodes.sparkSession.createDataFrame([], "target string, subsystem string, kind string, text string, evidence array<string>, verdict string, reason string")
    if over():
        return nodes, verdicts, phases
    enter("exploring")
    findings = checkpointed(explore(bundle(subsystems, nodes, chunks, edges), step, seconds=max(0.0, seconds - (time.monotonic() - began))))
    if over():
        return nodes, verdicts, phases
    model = None
    if complete:
        enter("synthesis")
        model = synthesise(reports(subsystems, findings), complete)
        if over():
            return nodes, verdicts, phases
    enter("critique")
    sources = materials.groupBy("fqname").agg(F.min("source").alias("source"))
    first = checkpointed(criticise(findings, nodes, sources, judge))
    again = criticise(first.where("verdict = 'rejected' and reason = 'judged'").select("subsystem", "target", "kind", "text", "evidence"), nodes, sources, judge)
    verdicts = checkpointed(first.where("not (verdict = 'rejected' and reason = 'judged')").unionByName(again))
    enter("writing")
    out = persist(nodes, verdicts, run_id)
    if model is not None:
        a = F.struct(F.col("summary").alias("text"), F.lit("repo_model").alias("kind"), F.array().cast("array<string>").alias("evidence"), F.lit("synthesizer").alias("source"), F.lit(True).alias("verified"), F.lit(run_id).alias("run_id"), F.lit(None).cast("timestamp").alias("created_at"))
        repo = nodes.where("kind = 'repo'").select(F.col("fqname").alias("target"))
        out = write_back(out, repo.crossJoin(F.broadcast(model.select(a.alias("a")))).select("target", F.lit(0).alias("ord"), "a"))  # one model, one node
    return out, verdicts, phases
