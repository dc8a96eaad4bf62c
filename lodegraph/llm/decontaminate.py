"""Benchmark decontamination by a prefix-filtered set join.

An item's windows (13 consecutive words; a shorter item is one window) are sets of word shingles. Exact containment
needs every shingle of a window, so the prefix of each window is its single rarest shingle, by count over all
documents. Documents are probed with the prefixes only; the prefix's place in the window then fixes where the window
would have to begin (positional bound) and end (length bound), and the words there are compared one by one.

The windows are broadcast only if their measured size is within BROADCAST_BYTES; beyond that, shingles are shuffled
and the windows are compared after joins on the row key and the window id.

Defined cases: a null or empty text has no words and no hits; a null or empty item has no window; equal windows of
several items count for each of them; windows that overlap hit their words once; very long texts are read to their
end; rows repeated with the same id and text give the same result once per row;
other columns of the tables are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import ascii_lower, row_key, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 13, 5
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _shingle(ws: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(ws, at + i) for i in range(k)])


def _windows(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """wid, ws, len, k and item of each window of each item."""
    items = benchmark.select(F.col(item).alias("item"), words(F.col(text)).alias("iw")).where((F.size("iw") > 0) & F.col("item").isNotNull())
    last = F.greatest(F.size("iw") - window, F.lit(0))
    each = items.select("item", "iw", F.explode(F.sequence(F.lit(0), last)).alias("at")).select("item", F.slice("iw", F.col("at") + 1, F.lit(window)).alias("ws"))
    return each.select(F.xxhash64(F.array_join("ws", " ")).alias("wid"), "ws", F.size("ws").alias("len"), F.least(F.size("ws"), F.lit(SHINGLE)).alias("k"), F.col("item").cast("string").alias("item"))


def _positions(docs: DataFrame, k: int) -> DataFrame:
    """key, dw, n, at and h of every shingle of k words."""
    return docs.where(F.col("n") >= k).select("key", "dw", "n", F.explode(F.sequence(F.lit(0), F.col("n") - k)).alias("at")).withColumn("h", _shingle(F.col("dw"), F.col("at"), k))


def decontaminate(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = 20, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: doc_id, key (of the row: its id and text), n_words, n_hit, n_items, item_ids, contaminated (hit words are at least 1/share of all)."""
    base = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    keyed = base.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), words(F.col("text")).alias("dw")).withColumn("n", F.size("dw"))
    each = written(_windows(benchmark, item_id, item_text, window), "decontaminate-windows")
    wins = each.select("wid", "ws", "len", "k").distinct()
    sized = wins.agg(F.sum(F.octet_length(F.array_join("ws", " ")) + 64).alias("b"), F.collect_set("k").alias("ks")).first()
    small = (sized.b or 0) <= broadcast_bytes
    near = F.broadcast if small else (lambda df: df)
    ks = sorted(sized.ks or [])

    inside = wins.select("wid", "ws", "k", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("k"))).alias("off"))
    inside = inside.select("wid", "k", "off", F.coalesce(*[F.when(F.col("k") == k, _shingle(F.col("ws"), F.col("off"), k)) for k in ks] or [F.lit(0).cast("long")]).alias("h"))
    wanted = inside.select("h").distinct()
    counts = None
    for k in ks:
        found = _positions(keyed, k).select("h").join(near(wanted), "h").groupBy("h").agg(F.count(F.lit(1)).alias("df"))
        counts = found if counts is None else counts.unionByName(found)
    if counts is None:
        hits = keyed.limit(0).select("key", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).cast("long").alias("wid"))
    else:
        rarity = written(counts, "decontaminate-rarity")
        prefix = inside.join(rarity, "h", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "off", "h")).alias("p"))
        prefix = written(prefix.select("wid", "p.df", "p.off", "p.h").where("df > 0").join(wins, "wid"), "decontaminate-prefix")
        hits = None
        start, begin = F.col("at") - F.col("off"), F.col("start")
        for k in ks:
            probes, own = _positions(keyed, k), prefix.where(F.col("k") == k)
            if small:
                same = (probes.h == own.h) & (start >= 0) & (start + F.col("len") <= F.col("n")) & F.expr("slice(dw, at - off + 1, len) = ws")
                part = probes.join(F.broadcast(own), same).select("key", start.alias("start"), F.col("len"), "wid")
            else:
                places = probes.select("key", "n", "at", "h").join(own.select("h", "wid", "off", "len"), "h").where((start >= 0) & (start + F.col("len") <= F.col("n"))).select("key", "wid", "len", start.alias("start"))
                part = places.join(keyed.select("key", "dw").dropDuplicates(["key"]), "key").select("key", "wid", "len", "start", F.slice("dw", begin + 1, F.col("len")).alias("seen"))
                part = part.join(own.select("wid", "ws"), "wid").where("seen = ws").select("key", "start", "len", "wid")
            hits = part if hits is None else hits.unionByName(part)
        hits = written(hits.select("key", "start", (begin + F.col("len")).alias("end"), "wid"), "decontaminate-hits")
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["to"]))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")),
        lambda a: a["n"],
    )
    spans = hits.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans")).select("key", covered.cast("long").alias("n_hit"))
    # items by window are joined and not carried, so that a window of many items is not one long row for each hit
    found = hits.select("key", "wid").distinct().join(each.select("wid", "item").distinct(), "wid").select("key", "item").distinct()
    per_doc = spans.join(found.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("item_ids")), "key")
    out = keyed.select("doc_id", "key", F.col("n").cast("long").alias("n_words")).join(per_doc, "key", "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("doc_id", "key", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"))


def without_contaminated(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of documents, with all their columns, that are not contaminated."""
    gone = decontaminate(documents, benchmark, doc_id, text, item_id, item_text).where("contaminated").select(F.col("key").alias("_gone")).distinct()
    # the row as one column, so that no name of documents meets one of these
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), row_key(F.col(doc_id), F.col(text)).alias("_key"))
    return rows.join(gone, rows._key == gone._gone, "left_anti").select("row.*")
