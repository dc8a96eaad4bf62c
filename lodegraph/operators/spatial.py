"""Pairs of rows that lie near each other: nearest vectors by cosine, points within a cutoff, line ranges that meet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.session import checkpointed

BLOCK, ROUND_BYTES, BATCH_ROWS, HOT_CELL, BIN_LINES = 256, 8 << 20, 2048, 4096, 64


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """id, other, distance, rank: the k nearest vectors of each query by cosine distance (6 decimals), ties by other.

    vectors and queries: id, embedding (all of one length). Queries go to the tasks once, not with each row: in rounds of
    round_bytes, each a broadcast of that size and a scan of the vectors. A task matches batches of its vectors with
    blocks of queries, keeps the k best of each query as it goes, and gives those out at its end; they are merged by
    query. What a task holds is a round's queries, k rows for each, and one batch. Null vectors and those of no length
    have no distance."""
    asked = checkpointed(queries.where("embedding is not null").select("id", "embedding"))
    sized = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width")).first()
    rounds = max(1, -(-sized.n * 8 * (sized.width or 1) // round_bytes))
    dealt = asked.withColumn("round", F.pmod(F.xxhash64("id"), F.lit(rounds)))
    rows = vectors.where("embedding is not null").select("id", "embedding")
    found = None
    for at in range(rounds):
        part = dealt.where(F.col("round") == at).select("id", "embedding").toPandas()  # of round_bytes, give or take
        each = rows.mapInPandas(_matcher(vectors.sparkSession.sparkContext.broadcast(_unit(part)), k, block), "id long, other long, distance double")
        found = each if found is None else found.unionByName(each)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))).where(F.col("rank") <= k)


def _unit(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, vectors and their lengths."""
    v = np.stack(pdf["embedding"].to_list()).astype(float) if len(pdf) else np.zeros((0, 1))
    return pdf["id"].to_numpy(np.int64), v, np.linalg.norm(v, axis=1)


def _matcher(shipped, k: int, block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q, q_norm = shipped.value
        best, best_id = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        for whole in batches:
            for first in range(0, len(whole), BATCH_ROWS):
                other, v, v_norm = _unit(whole.iloc[first : first + BATCH_ROWS])
                for at in range(0, len(ids), block):
                    s = slice(at, at + block)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        d = np.round(1 - (q[s] @ v.T) / (q_norm[s, None] * v_norm[None]), 6)
                    d[~np.isfinite(d) | (ids[s, None] == other[None])] = np.inf
                    d = np.concatenate([best[s], d], axis=1)
                    i = np.concatenate([best_id[s], np.broadcast_to(other, (len(d), len(other)))], axis=1)
                    kept = np.lexsort((i, d))[:, :k]
                    best[s], best_id[s] = np.take_along_axis(d, kept, 1), np.take_along_axis(i, kept, 1)
        ok = np.isfinite(best)
        yield pd.DataFrame({"id": np.broadcast_to(ids[:, None], best.shape)[ok], "other": best_id[ok], "distance": best[ok]})

    return run


def within(points: DataFrame, cutoff: float, hot: int = HOT_CELL) -> DataFrame:
    """a, b, d2: the pairs of points (a < b) at most cutoff apart, with the square of their distance, each once.

    points: id, x, y. Points fall into cells a little wider than the cutoff, so a partner lies in the same cell or one of
    the eight around it; a point stays in its cell and goes, as a visitor, to its own and the four cells ahead, which
    meets every pair in one cell. Cells of more than `hot` points are split: residents are dealt by hash into parts, and
    visitors go to each part. Null or infinite coordinates have no partners; a cutoff below zero gives no pairs."""
    width = cutoff * (1 + 1e-9) or 1.0  # so that rounding cannot put a partner two cells off
    cell = lambda c: F.floor(F.col(c) / F.lit(width))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    home = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(finite("x") & finite("y"))
    home = home.withColumns({"cx": cell("x"), "cy": cell("y")})
    parts = home.groupBy("cx", "cy").agg(F.ceil(F.count(F.lit(1)) / F.lit(hot)).alias("parts")).where("parts > 1")
    parts = checkpointed(parts)  # hot cells only
    salted = home.join(parts, ["cx", "cy"], "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))))
    ahead = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))])
    there = home.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cx", "cy", F.explode(ahead).alias("s"))
    there = there.select("id2", "x2", "y2", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"), ((F.col("s.i") == 0) & (F.col("s.j") == 0)).alias("same"))
    there = there.join(parts, ["cx", "cy"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
    d2 = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2"))
    met = salted.join(there.drop("parts"), ["cx", "cy", "part"]).withColumn("d2", d2)
    met = met.where((F.col("d2") <= cutoff * cutoff) & F.when(F.col("same"), F.col("id") < F.col("id2")).otherwise(F.col("id") != F.col("id2")))
    return met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), "d2")


def repulsion(points: DataFrame, k: float, reach: float = 2.5) -> DataFrame:
    """id, dx, dy: the sum of pushes k^2 / d along the line from each point within reach * k; points without a partner have
    none. Points closer than 0.1 push as if 0.1 apart on either axis."""
    at = lambda c, n: points.select(F.col("id").alias(c), F.col("x").cast("double").alias(f"x{n}"), F.col("y").cast("double").alias(f"y{n}"))
    pairs = within(points, reach * k).join(at("a", 1), "a").join(at("b", 2), "b")
    tight = F.col("d2") < 0.01
    ex, ey, d2 = (F.when(tight, F.lit(v)).otherwise(c) for v, c in ((0.1, F.col("x1") - F.col("x2")), (0.1, F.col("y1") - F.col("y2")), (0.02, F.col("d2"))))
    push = pairs.select("a", "b", (ex * (k * k) / d2).alias("fx"), (ey * (k * k) / d2).alias("fy"))
    both = push.select(F.col("a").alias("id"), "fx", "fy").unionByName(push.select(F.col("b").alias("id"), -F.col("fx"), -F.col("fy")).toDF("id", "fx", "fy"))
    return both.groupBy("id").agg(F.sum("fx").alias("dx"), F.sum("fy").alias("dy"))


def meeting(left: DataFrame, right: DataFrame, key: str, start: Column, end: Column, other_start: Column, other_end: Column, width: int = BIN_LINES) -> DataFrame:
    """left joined to the rows of right with the same key whose range [other_start, other_end] meets [start, end], each
    pair once. Ranges are cut into bins of width lines, and a pair is taken in the first bin that both have, so that a
    key with very many ranges is spread over its bins. Ranges that end before they begin meet nothing; those of left are
    held to the span of right's ranges of that key first, so a range of any length has no more bins than those have."""
    right = right.withColumns({"_s2": other_start.cast("long"), "_e2": other_end.cast("long")}).where("_s2 <= _e2")
    span = right.groupBy(key).agg(F.min("_s2").alias("_from"), F.max("_e2").alias("_to"))
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    held = left.withColumns({"_s1": start.cast("long"), "_e1": end.cast("long")}).join(span, key)
    held = held.withColumns({"_s1": F.greatest("_s1", "_from"), "_e1": F.least("_e1", "_to")}).drop("_from", "_to").where("_s1 <= _e1")
    met = held.withColumn("_bin", bins("_s1", "_e1")).join(right.withColumn("_bin", bins("_s2", "_e2")), [key, "_bin"])
    first = F.greatest(F.floor(F.col("_s1") / width), F.floor(F.col("_s2") / width))
    return met.where((F.col("_s1") <= F.col("_e2")) & (F.col("_s2") <= F.col("_e1")) & (F.col("_bin") == first)).drop("_s1", "_e1", "_s2", "_e2", "_bin")
