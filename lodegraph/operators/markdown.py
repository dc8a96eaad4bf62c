"""Markdown sections as plain columns: lines, fences, headings, parents, ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.text import slug


def sections(lines: DataFrame) -> DataFrame:
    """path, level, title, slug, parent, start_line, end_line: one row a file (level 0) and one a heading of level 1-3.

    lines: path, line (from 1), text. Fences of either kind toggle; a section ends before the next heading of any level
    1-3; the nth repeat of a slug in a file gets -n; a level-2 heading's parent is the latest level-1 one (or the file),
    a level-3 heading's is the latest level-2 one since the latest level-1 one, else that one, else the file.
    """
    by_path = Window.partitionBy("path").orderBy("line")
    past = by_path.rowsBetween(Window.unboundedPreceding, -1)
    bare = F.trim("text")
    fenced = lines.withColumn("fence", bare.startswith("```") | bare.startswith("~~~")).withColumn("open", F.sum(F.col("fence").cast("int")).over(by_path.rowsBetween(Window.unboundedPreceding, 0)) % 2)
    last = fenced.withColumn("n_lines", F.max("line").over(Window.partitionBy("path")))
    found = last.where((F.col("open") == 0) & ~F.col("fence") & bare.rlike(r"^#{1,3}[ \t]+\S"))
    heads = found.select("path", "line", "n_lines", F.length(F.regexp_extract(bare, r"^(#{1,3})", 1)).alias("level"), F.trim(F.regexp_replace(F.regexp_replace(bare, r"^#{1,3}[ \t]+", ""), r"[ \t]+#+$", "")).alias("title"))
    repeat = F.row_number().over(Window.partitionBy("path", "base").orderBy("line")) - 1
    named = heads.withColumn("base", slug(F.col("title"))).withColumn("slug", F.when(repeat == 0, F.col("base")).otherwise(F.concat_ws("-", "base", repeat)))
    h1 = F.last(F.when(F.col("level") == 1, F.col("slug")), ignorenulls=True)
    tops = named.withColumn("h1", h1.over(past)).withColumn("part", F.sum((F.col("level") == 1).cast("int")).over(by_path.rowsBetween(Window.unboundedPreceding, 0)))
    in_part = Window.partitionBy("path", "part").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    h2 = F.last(F.when(F.col("level") == 2, F.col("slug")), ignorenulls=True)
    parent = F.when(F.col("level") == 1, F.lit(None)).when(F.col("level") == 2, F.col("h1")).otherwise(F.coalesce("h2", "h1"))
    rows = tops.withColumn("h2", h2.over(in_part)).withColumn("end_line", F.coalesce(F.lead("line").over(by_path) - 1, "n_lines"))
    rows = rows.select("path", F.col("level").cast("int").alias("level"), "title", "slug", parent.alias("parent"), F.col("line").alias("start_line"), "end_line")
    none = F.lit(None).cast("string")
    files = lines.groupBy("path").agg(F.max("line").alias("end_line")).select("path", F.lit(0).alias("level"), none.alias("title"), none.alias("slug"), none.alias("parent"), F.lit(1).cast("long").alias("start_line"), "end_line")
    return files.unionByName(rows.withColumns({"start_line": F.col("start_line").cast("long"), "end_line": F.col("end_line").cast("long")}).select(files.columns))


def first_paragraph(lines: DataFrame) -> DataFrame:
    """path and the first run of lines that are neither blank nor headings, joined by spaces."""
    w = Window.partitionBy("path").orderBy("line")
    text = F.trim("text")
    body = lines.withColumn("is_text", (text != "") & ~text.startswith("#"))
    started = body.withColumn("seen", F.max(F.col("is_text").cast("int")).over(w)).where("seen = 1")
    first = started.withColumn("stops", F.sum((~F.col("is_text")).cast("int")).over(w)).where("stops = 0")
    return first.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", text.alias("t")))), lambda x: x["t"]), " ").alias("paragraph"))
