"""Deterministic scoring of answers, macro averages, cost ledger, scoreboard."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.text import cited_path


def score(cases: DataFrame) -> DataFrame:
    """cases with precision, recall, coverage and missing.

    cases: id, expected, optional, keywords (arrays of strings), citations (array of path, verified), answer. Precision
    is over verified citations with repeats, 0 without any; recall over distinct expected paths, 1 if none is expected;
    coverage over keywords, 1 without any, in any letter case.
    """
    norm = lambda paths: F.array_distinct(F.transform(paths, cited_path))
    expected, allowed = norm(F.col("expected")), norm(F.array_union("expected", "optional"))
    cited = F.transform(F.filter("citations", lambda c: c["verified"]), lambda c: cited_path(c["path"]))
    hits = F.size(F.filter(cited, lambda p: F.array_contains(allowed, p)))
    present = F.filter("keywords", lambda k: F.lower("answer").contains(F.lower(k)))
    ratio = lambda a, b, empty: F.when(b == 0, F.lit(empty)).otherwise(F.try_divide(a.cast("double"), b))
    return cases.withColumns({
        "precision": F.round(ratio(hits, F.size(cited), 0.0), 6), "recall": F.round(ratio(F.size(F.array_intersect(expected, F.array_distinct(cited))), F.size(expected), 1.0), 6),
        "coverage": F.round(ratio(F.size(present), F.size("keywords"), 1.0), 6), "missing": F.filter("keywords", lambda k: ~F.lower("answer").contains(F.lower(k))),
    })


def macro(scored: DataFrame) -> DataFrame:
    """Averages over the rows without an error; 0 if there is none."""
    ok = F.col("error").isNull()
    avg = lambda c: F.round(F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(0.0)), 6).alias(c)
    return scored.agg(avg("precision"), avg("recall"), avg("coverage"), F.count_if(ok).alias("n_scored"), F.count_if(~ok).alias("n_errors"))


def ledger(calls: DataFrame, *by: str) -> DataFrame:
    """calls, input_tokens, output_tokens, usd (null if no call has a price)."""
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("usd"), 6).alias("usd"))


def scoreboard(scored: DataFrame) -> str:
    """A Markdown table; one row a case of the golden set, which is small."""
    pct = lambda x: f"{100 * x:.0f}%"
    rows = scored.orderBy("id").select("id", "precision", "recall", "coverage").collect()
    return "\n".join(["| case | precision | recall | coverage |", "|---|---|---|---|", *[f"| {r.id} | {pct(r.precision)} | {pct(r.recall)} | {pct(r.coverage)} |" for r in rows]])


def run_eval(cases: DataFrame, answer: Callable[[str], dict]) -> DataFrame:
    """cases with what answer gave for their question, scored; a case that raises is a row with its error, scored as no
    answer. cases: id, question, expected, optional, keywords. answer gives {"text", "citations": [(path, verified)]}."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for case, question in zip(pdf["id"], pdf["question"], strict=True):
                try:
                    got = answer(question)
                    rows.append((case, got["text"], [{"path": p, "verified": v} for p, v in got["citations"]], None))
                except Exception as error:  # one case does not end the run
                    rows.append((case, "", [], f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["id", "answer", "citations", "error"])

    kind = cases.schema["id"].dataType.simpleString()
    answered = cases.select("id", "question").mapInPandas(run, f"id {kind}, answer string, citations array<struct<path:string,verified:boolean>>, error string")
    return score(cases.join(answered, "id"))


def evaluate(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """cases scored by what retrieval found for all of them: the paths cited are those of its hits, and the answer is their
    snippets in order of rank. A case without hits is scored as no answer. cases: id, expected, optional, keywords; hits:
    id, rank0, path, verified, snippet, some of each id."""
    each = hits.groupBy("id").agg(
        F.collect_list(F.struct("path", "verified")).alias("citations"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank0", "snippet"))), lambda x: x["snippet"]), " ").alias("answer"),
    )
    none = F.array().cast("array<struct<path:string,verified:boolean>>")
    return score(cases.join(each, "id", "left").withColumns({"citations": F.coalesce("citations", none), "answer": F.coalesce("answer", F.lit(""))}))
