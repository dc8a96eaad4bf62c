"""Batch verification of line-range citations against stored chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.text import collapsed
from lodegraph.operators.spatial import meeting

TOLERANCE = 5


def verify(citations: DataFrame, chunks: DataFrame, key: str = "cid", tolerance: int = TOLERANCE, quotes: bool = True) -> DataFrame:
    """All citations in one plan: key, n_path, n_overlap, verified, reason.

    Chunks of cited paths alone are joined. A quotation may run over two chunks, so the chunk texts near the cited lines
    are put together, in order, before the containment test. citations: key, path, start_line, end_line, quote. quotes:
    False if no citation has a quote, so that chunks need no text.
    """
    c = citations.select(key, "path", F.col("start_line").alias("s"), F.col("end_line").alias("e"), "quote")
    over = (F.col("start_line") <= F.col("e")) & (F.col("end_line") >= F.col("s"))
    has_quote = collapsed(F.col("quote")) != "" if quotes else F.lit(False)
    parts = chunks.select("path", "start_line", "end_line", (F.col("text") if quotes else F.lit("")).alias("text"))
    in_path = parts.join(c.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.count(F.lit(1)).alias("n_path"))
    # only chunks near the cited lines meet a citation, whatever else the path has, and a large file is spread over its lines
    low, high = F.col("s") - tolerance, F.col("e") + tolerance
    near = (F.col("start_line") <= high) & (F.col("end_line") >= low)
    close = meeting(c, parts, "path", F.least(low, high), F.greatest(low, high), F.col("start_line"), F.col("end_line")).where(near).groupBy(key).agg(F.count_if(over).alias("n_overlap"), F.array_sort(F.collect_list(F.when(has_quote, F.struct("start_line", "end_line", "text")))).alias("near"))
    zero = F.lit(0).cast("long")
    found = c.join(in_path, "path", "left").join(close, key, "left").withColumns({"n_path": F.coalesce("n_path", zero), "n_overlap": F.coalesce("n_overlap", zero), "near": F.coalesce("near", F.array().cast("array<struct<start_line:int,end_line:int,text:string>>"))})
    hay = collapsed(F.array_join(F.transform("near", lambda x: x["text"]), "\n"))
    inside = ~has_quote | hay.contains(collapsed(F.col("quote")))
    reason = (
        F.when(F.col("n_path") == 0, F.format_string("path '%s' not in repo", "path"))
        .when(F.col("n_overlap") == 0, F.format_string("no source at %s:%d-%d", "path", "s", "e"))
        .when(~inside, F.lit("quoted snippet not found near cited lines"))
        .otherwise(F.lit("ok"))
    )
    return found.select(key, "n_path", "n_overlap", (reason == "ok").alias("verified"), reason.alias("reason"))
