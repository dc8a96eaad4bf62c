"""Annotations, write-back, summaries in waves, context blocks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodegraph.session import checkpointed

MAX_CHILDREN, MAX_LINES, MAX_COMMUNITIES, DOCSTRING_CHARS = 30, 20, 12, 500


def shown(annotations: Column) -> Column:
    """The verified annotations that have a text and are not the repository's model."""
    return F.filter(annotations, lambda a: a["verified"] & (a["kind"] != "repo_model") & (F.coalesce(a["text"], F.lit("")) != ""))


def verified_count(annotations: Column) -> Column:
    return F.coalesce(F.size(F.filter(annotations, lambda a: a["verified"])), F.lit(0))


def latest_model(annotations: Column) -> Column:
    """Text of the last repository model, or null."""
    return F.try_element_at(F.filter(annotations, lambda a: a["kind"] == "repo_model"), F.lit(-1))["text"]


def annotation_lines(nodes: DataFrame, limit: int = MAX_LINES) -> DataFrame:
    rows = nodes.select("id", "fqname", F.posexplode(shown(F.col("annotations"))).alias("at", "a"))
    return rows.orderBy("id", "at").limit(limit).select("id", "at", F.format_string("- %s: %s", "fqname", "a.text").alias("line"))


def judged(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings with a verdict on the same target and text."""
    return findings.join(verdicts, ["target", "text"])


def write_back(nodes: DataFrame, accepted: DataFrame) -> DataFrame:
    """nodes with the accepted findings appended to annotations, in order (null annotations are none); missing targets are skipped.
    accepted: target, ord and an annotation struct a."""
    new = accepted.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "a"))), lambda x: x["a"]).alias("new"))
    both = nodes.join(new, F.col("fqname") == F.col("target"), "left")
    return both.withColumn("annotations", F.when(F.col("new").isNull(), F.col("annotations")).otherwise(F.concat(F.coalesce("annotations", F.array().cast(nodes.schema["annotations"].dataType)), "new"))).drop("target", "new")


def summary_waves(nodes: DataFrame, waves: int, summarize: Callable[..., Column]) -> DataFrame:
    """id, fqname, wave, summary from the leaves (wave 0) up. nodes: id, fqname, parent, wave, and docstring if there are
    any. A node's summary is made of its name, the first MAX_CHILDREN child summaries by name, and, if nodes have them, the
    first DOCSTRING_CHARS of its docstring; summarize makes a column of these. A null summary is that of a node that
    failed: it is skipped, and its parents are summarised without it. Each wave is written, so the next one reads it."""
    done = None
    documented = "docstring" in nodes.columns
    for wave in range(waves):
        own = nodes.where(F.col("wave") == wave)
        if done is None:
            rows = own.withColumn("children", F.array().cast("array<string>"))
        else:
            children = done.join(nodes.select(F.col("id"), F.col("parent").alias("of")), "id").withColumn("n", F.row_number().over(Window.partitionBy("of").orderBy("fqname")))
            kids = children.where(F.col("n") <= MAX_CHILDREN).groupBy("of").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "summary"))), lambda x: x["summary"]).alias("children"))
            rows = own.join(kids, own.fqname == kids.of, "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>"))).drop("of")
        doc = [F.left(F.coalesce("docstring", F.lit("")), F.lit(DOCSTRING_CHARS))] if documented else []
        part = rows.select("id", "fqname", "wave", summarize(F.col("fqname"), F.col("children"), *doc).alias("summary"))
        part = checkpointed(part.where("summary is not null"))
        done = part if done is None else done.unionByName(part)
    return done


def failing_to_null(summarize: Callable[..., str]) -> Callable[..., Column]:
    """A function of one node's values as a column of summaries, null where it raises: one node's failure ends no wave."""

    def safe(*values) -> str | None:
        try:
            return summarize(*values)
        except Exception:
            return None

    @F.pandas_udf(StringType())
    def column(*columns: pd.Series) -> pd.Series:
        return pd.Series([safe(*row) for row in zip(*columns, strict=True)], dtype=object)

    return lambda *columns: column(*columns)


def community_lines(communities: DataFrame, limit: int = MAX_COMMUNITIES) -> DataFrame:
    top = communities.where(F.col("summary").isNotNull()).orderBy(F.col("size").desc(), "key").limit(limit)
    return top.select("key", "size", F.format_string("- %s (%d): %s", "key", "size", "summary").alias("line"))


def context_block(items: DataFrame) -> DataFrame:
    """One row: the items as numbered blocks in rank order. items: rank, fqname, kind, path, start_line, end_line, snippet, summary."""
    body = F.coalesce(F.nullif("snippet", F.lit("")), F.nullif("summary", F.lit("")), F.lit(""))
    block = F.concat(F.format_string("[%d] %s (%s) — %s:%d-%d\n", F.col("rank") + 1, "fqname", "kind", "path", "start_line", "end_line"), body)
    return items.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))
