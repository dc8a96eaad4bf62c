"""Hybrid retrieval: keyword and vector signals, reciprocal-rank fusion, one-hop expansion, hydration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.stemming import stemmed
from lodegraph.functions.text import words
from lodegraph.functions.vectors import cosine_distance

K1, B, RRF_K, PER_SIGNAL, EXPANDED = 1.2, 0.75, 60, 20, 1 / 240


def postings(chunks: DataFrame, key: str, text: str, terms: list[str], english: bool = False) -> DataFrame:
    """key, n_words, term, tf of the given terms, picked inside each row; english: terms are stems."""
    found = words(F.col(text))
    each = F.filter(stemmed(found) if english else found, lambda w: w.isin(terms))
    return chunks.select(F.col(key), F.size(found).alias("n_words"), F.explode(each).alias("term")).groupBy(key, "n_words", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(chunks: DataFrame, key: str, text: str, terms: list[str], all_terms: bool = False, english: bool = False) -> DataFrame:
    """key and score of each chunk that has any (or all) of the terms, by a scan of all; index.py searches without one."""
    sizes = chunks.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(words(F.col(text)))).alias("mean"))
    tf = postings(chunks, key, text, terms, english)
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_words") / F.col("mean")))
    # one row for each query term, and one of totals: their size is the query's
    scored = tf.join(F.broadcast(df.crossJoin(sizes)), "term").groupBy(key).agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("n_terms"))
    return (scored.where(F.col("n_terms") == len(set(terms))) if all_terms else scored).select(key, F.round("score", 6).alias("score"))


def dense(nodes: DataFrame, key: str, vector: str, query: list[float]) -> DataFrame:
    """key and distance to the query vector."""
    return nodes.where(F.col(vector).isNotNull()).select(key, F.round(cosine_distance(F.col(vector), F.array(*[F.lit(float(x)) for x in query])), 6).alias("distance"))


def ranked(scored: DataFrame, key: str, score: str, limit: int = PER_SIGNAL, ascending: bool = False) -> DataFrame:
    """The first rows by score, ties by key, with rank0 from 0."""
    order = [F.col(score).asc() if ascending else F.col(score).desc(), F.col(key)]
    top = scored.orderBy(*order).limit(limit)
    return top.withColumn("rank0", F.row_number().over(Window.orderBy(*order)) - 1)


def fuse(signals: dict[str, DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """key, score and signals (in the order given) out of ranked lists."""
    rows = None
    for at, (name, df) in enumerate(signals.items()):
        part = df.select(F.col(key), F.lit(at).alias("at"), F.lit(name).alias("signal"), (1 / (F.lit(k) + F.col("rank0") + 1)).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.round(F.sum("part"), 9).alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("at", "signal"))), lambda s: s["signal"]).alias("signals"))


def neighbours(edges: DataFrame, seeds: DataFrame, key: str, kinds: list[str] | None = None) -> DataFrame:
    """Distinct ids one edge from a seed, either way, seeds left out."""
    e = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    out = e.join(seeds.select(F.col(key).alias("src")), "src", "left_semi").select(F.col("dst").alias(key))
    into = e.join(seeds.select(F.col(key).alias("dst")), "dst", "left_semi").select(F.col("src").alias(key))
    return out.unionByName(into).distinct().join(seeds.select(key), key, "left_anti")


def expand(fused: DataFrame, edges: DataFrame, key: str, top_k: int) -> DataFrame:
    """The fused top, filled up by neighbours at a fixed low score; cut to top_k again."""
    seeds = fused.orderBy(F.col("score").desc(), key).limit(top_k)
    new = neighbours(edges, seeds, key).join(fused.select(key), key, "left_anti")
    new = new.select(key, F.round(F.lit(EXPANDED), 9).alias("score"), F.array(F.lit("graph")).alias("signals"))
    return fused.unionByName(new).orderBy(F.col("score").desc(), key).limit(top_k)


def hydrate(top: DataFrame, nodes: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Ranked ids with their node and the text of their first chunk; ids without a node go."""
    few = F.broadcast(top)
    first = chunks.join(few.select(key), key, "left_semi").groupBy(key).agg(F.min_by("text", F.struct("start_line", "end_line")).alias("snippet"))
    return nodes.join(few, key).join(first, key, "left")


def best_rank(ranked_chunks: DataFrame, owner: str) -> DataFrame:
    """One row an owner: its best rank."""
    return ranked_chunks.groupBy(owner).agg(F.min("rank0").cast("long").alias("best_rank"), F.count(F.lit(1)).alias("hits"))


def retrieve(found: DataFrame, vector: list[float], nodes: DataFrame, chunks: DataFrame, edges: DataFrame, key: str, embedding: str, top_k: int = 10, per_signal: int = PER_SIGNAL, expand_graph: bool = True) -> DataFrame:
    """Hybrid retrieval in one plan: the per_signal best chunks by keyword, as nodes by their best chunk, and the
    per_signal nearest nodes by vector; fused, filled up by neighbours, and given node and first chunk.

    found: chunk_id and score, as an index or bm25 gives them; nodes: key, the embedding, and what shall come out;
    chunks: chunk_id, key, start_line, end_line, text."""
    hits = ranked(found, "chunk_id", "score", per_signal)
    owners = best_rank(chunks.select("chunk_id", key).join(F.broadcast(hits), "chunk_id"), key)
    keyword = ranked(owners, key, "best_rank", per_signal, ascending=True)
    near = ranked(dense(nodes, key, embedding, vector), key, "distance", per_signal, ascending=True)
    fused = fuse({"bm25": keyword, "dense": near}, key)
    top = expand(fused, edges, key, top_k) if expand_graph else fused.orderBy(F.col("score").desc(), key).limit(top_k)
    return hydrate(top, nodes.drop(embedding), chunks, key)
