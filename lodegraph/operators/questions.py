"""Question types, routes and budgets; answering as a pipeline of pluggable steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.verify import verify
from lodegraph.session import checkpointed

CITED = "array<struct<path:string,start_line:int,end_line:int,quote:string>>"
CHECKED = "array<struct<path:string,start_line:int,end_line:int,quote:string,verified:boolean,reason:string>>"

# How many items each type of question retrieves.
TOP_K = {"architecture": 15, "onboarding": 15, "specific_symbol": 8, "how_to": 10, "comparison": 12, "general": 10}
GLOBAL = ("architecture", "onboarding")
RULES = [
    ("comparison", r"\b(differ|versus|vs|compare[ds]?|than)\b"),
    ("architecture", r"\b(architecture|structure|design|overview|components?)\b"),
    ("onboarding", r"\b(start|begin|onboard\w*|new here|learn)\b"),
    ("how_to", r"\b(how (do|to|can)|use|usage|example)\b"),
    ("specific_symbol", r"\b(what does|where is|function|class|method)\b|\w+\(\)|\w+_\w+"),
]


def question_type(text: Column) -> Column:
    """The first rule that a question meets; general if none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(low.rlike(rule), F.lit(kind)) for kind, rule in RULES], F.lit("general"))


def top_k(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(n)) for k, n in TOP_K.items()], F.lit(TOP_K["general"]))


def route(kind: Column, has_model: Column, n_communities: Column) -> Column:
    """global for broad questions if there is a model of the repository or a community to ground them, else local."""
    return F.when(kind.isin(*GLOBAL) & (has_model | (n_communities > 0)), "global").otherwise("local")


def final_route(first: Column, answerable: Column, n_written: Column) -> Column:
    """escalate only if the first answer was none and write-back kept a finding."""
    return F.when(~answerable & (n_written > 0), "escalate").otherwise(first)


def answer(question: str, retrieve: Callable[[str], list], synthesize: Callable[[str, list, list[str]], tuple[str, list]], check: Callable[[list], list[tuple[bool, str]]]) -> dict:
    """One question on the driver: retrieve, stop if nothing is found, synthesize, verify, and once more with the
    reasons if a citation fails; what still fails is flagged, not removed."""
    items = retrieve(question)
    if not items:
        return {"text": "", "answerable": False, "citations": [], "fully_verified": True}
    text, citations = synthesize(question, items, [])
    verdicts = check(citations)
    if not all(ok for ok, _ in verdicts):
        text, citations = synthesize(question, items, [why for ok, why in verdicts if not ok])
        verdicts = check(citations)
    return {"text": text, "answerable": True, "citations": [{"citation": c, "verified": ok, "reason": why} for c, (ok, why) in zip(citations, verdicts, strict=True)], "fully_verified": all(ok for ok, _ in verdicts)}


def answer_all(questions: DataFrame, items: DataFrame, chunks: DataFrame, synthesize: Callable[[str, list[dict], list[str]], tuple[str, list[tuple]]]) -> DataFrame:
    """answer() for all questions at once: question, answer, answerable, citations (with verified and reason) and
    fully_verified. Every question is synthesized in a task, all citations of all drafts are verified by one join, and
    only questions with a failed citation are synthesized and verified again, with the reasons.

    questions: question (an id), text; items: question, rank0 and what was retrieved for it (a bounded top-k); chunks: as
    verify takes them; synthesize gives a text and citations (path, start_line, end_line, quote)."""
    kind = questions.schema["question"].dataType.simpleString()
    found = [c for c in items.columns if c not in ("question", "rank0")]
    each = items.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("rank0", F.struct(*found).alias("item")))).alias("items"))
    asked = checkpointed(questions.select("question", "text").join(each, "question", "left"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for question, text, held, reasons in zip(pdf["question"], pdf["text"], pdf["items"], pdf["reasons"], strict=True):
                answer, citations = synthesize(text, [x["item"] for x in held], list(reasons))
                rows.append((question, answer, [dict(zip(("path", "start_line", "end_line", "quote"), c, strict=True)) for c in citations]))
            yield pd.DataFrame(rows, columns=["question", "answer", "citations"])

    def written(rows: DataFrame) -> DataFrame:
        return checkpointed(rows.select("question", "text", "items", "reasons").mapInPandas(run, f"question {kind}, answer string, citations {CITED}"))

    first = _checked(written(asked.where("items is not null").withColumn("reasons", F.array().cast("array<string>"))), chunks)
    failed = first.where("not fully_verified").select("question", F.transform(F.filter("citations", lambda c: ~c["verified"]), lambda c: c["reason"]).alias("reasons"))
    again = _checked(written(asked.join(failed, "question")), chunks)
    none = asked.where("items is null").select("question", F.lit("").alias("answer"), F.array().cast(CHECKED).alias("citations"), F.lit(True).alias("fully_verified"), F.lit(False).alias("answerable"))
    done = first.where("fully_verified").unionByName(again).withColumn("answerable", F.lit(True))
    return done.unionByName(none).select("question", "answer", "answerable", "citations", "fully_verified")


def _checked(drafts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Drafts with each citation's verdict, in the order given."""
    each = drafts.select("question", F.posexplode("citations").alias("at", "c")).select(F.struct("question", "at").alias("cid"), "c.*")
    quotes = not each.where(F.trim("quote") != "").isEmpty()
    # the chunks of cited paths, cut once for all steps of the verification
    cited = checkpointed(chunks.select("path", "start_line", "end_line", *["text"] * quotes).join(each.select("path").distinct(), "path", "left_semi"))
    verdicts = verify(each, cited, quotes=quotes).select("cid", "verified", "reason")
    held = each.join(verdicts, "cid").select("cid.question", F.struct("cid.at", "path", "start_line", "end_line", "quote", "verified", "reason").alias("c"))
    per = held.groupBy("question").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.dropFields("at")).alias("checked"))
    out = drafts.select("question", "answer").join(per, "question", "left")
    checked = F.coalesce("checked", F.array().cast(CHECKED))
    return checkpointed(out.select("question", "answer", checked.alias("citations"), F.forall(checked, lambda c: c["verified"]).alias("fully_verified")))
