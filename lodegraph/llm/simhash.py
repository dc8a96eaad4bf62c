"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is cut into SEGMENTS consecutive segments on a ring. If two fingerprints differ in at most D bits, there
is a segment from which on every chain of l segments differs in at most floor(l * D / SEGMENTS) bits. The chains whose
budget is 0 (CHAIN segments long) must be equal, which makes an equi-join; longer chains are tested in the join, and
only pairs that pass all of them reach the full Hamming check.

The more fingerprints there are, the more segments are cut (segments_for): chains of budget 0 are then longer, up to
31 of 64 bits, so that few fingerprints meet by chance.

A chain value shared by more than BUCKET fingerprints (a large group of near copies) is not paired out: each of its
fingerprints is dealt to itself and its 64 one-bit neighbours instead. Two fingerprints link at two bits or fewer
exactly if they meet at such a neighbour, and at most 65 distinct fingerprints can meet there. Both ways are exact.

Defined cases: null, empty and wordless texts have fingerprint zero and link like any other; equal fingerprints are one
node, so copies are never paired; a null doc_id never names a component unless all ids in it are null; very long texts
are read to their end; ties go to the smaller id, then row key; rows repeated get the same result and count as copies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegraph.llm.common import row_key, written
from lodegraph.llm.components import components

BITS, DISTANCE, SEGMENTS, BUCKET, SHINGLE, SEED = 64, 2, 5, 64, 3, 42


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint: bit set if set in over half the XXH64 of the shingles."""
    ws = text.encode().lower().split() if text else []
    if not ws:
        return 0
    buf = b" ".join(ws)
    k = min(k, len(ws))
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    votes = np.zeros(BITS, np.int64)
    spans = list(zip(starts[: len(ws) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True))
    for at in range(0, len(spans), 200):  # a byte holds the sum of 200 bits
        part = b"".join([digest(buf[s:e], SEED) for s, e in spans[at : at + 200]])
        votes += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * votes > len(spans)).tobytes(), "big", signed=True)


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def segments(n: int = SEGMENTS) -> list[tuple[int, int]]:
    """Lowest bit and width of each segment."""
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _chain_mask(first: int, length: int, n: int) -> int:
    mask = 0
    for at, width in (segments(n)[(first + i) % n] for i in range(length)):
        mask |= ((1 << width) - 1) << at
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def segments_for(prints: int, distance: int = DISTANCE) -> int:
    """The least odd number of segments, from SEGMENTS on, at which a chain's value is shared by four of so many
    fingerprints at most, if they are spread evenly; 31 at most."""
    n = SEGMENTS
    while n < 31 and prints > 4 << BITS * ((n - 1) // distance) // n:
        n += 2
    return n


def links(prints: DataFrame, distance: int = DISTANCE, n: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """a, b: fingerprints whose links reach the same components as all pairs within distance; prints: distinct fp."""
    n = n or segments_for(prints.count(), distance)
    length = max(l for l in range(1, n + 1) if l * distance // n == 0)
    chains = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_chain_mask(i, length, n))) for i in range(n)])).alias("chain", "part"))
    sizes = written(chains.groupBy("chain", "part").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "simhash-chains")
    shared = written(chains.join(sizes, ["chain", "part"]), "simhash-shared")
    few, many = shared.where(F.col("size") <= bucket), shared.where(F.col("size") > bucket)
    a, b = few.select("chain", "part", F.col("fp").alias("a")), few.select("chain", "part", F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    near = F.lit(True)
    for l in range(length + 1, n + 1):
        in_chain = F.element_at(F.array(*[F.bit_count(differ.bitwiseAND(F.lit(_chain_mask(i, l, n)))) for i in range(n)]), F.col("chain") + 1)
        near = near & (in_chain <= l * distance // n)
    pairs = a.join(b, ["chain", "part"]).where((F.col("a") < F.col("b")) & near & (F.bit_count(differ) <= distance)).select("a", "b")
    if distance != 2:
        raise ValueError("large buckets are exact at distance 2 only")
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - ((1 << BITS) if i == BITS - 1 else 0)).cast("long") for i in range(BITS)])
    met = many.select("fp").distinct().select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("z"))
    met = met.groupBy("z").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def _grouped(documents: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, key and fp of each row, and fp, node of the fingerprints with links (node: the component's least one)."""
    key = row_key(F.col(doc_id), F.col(text))
    docs = written(documents.select(F.col(doc_id).alias("doc_id"), key.alias("key"), _fingerprints(F.col(text)).alias("fp")), "simhash-prints")
    found = components(links(docs.select("fp").distinct()))
    return docs, found.select(F.col("node").alias("fp"), F.col("component").alias("node"))


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    docs, nodes = _grouped(documents, doc_id, text)
    prints = docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).join(nodes, "fp", "left")
    prints = written(prints.where("n > 1 or node is not null"), "simhash-classes")  # the others are their own component
    least = prints.where("node is not null").groupBy("node").agg(F.min("least").alias("of_node"))
    named = prints.join(least, "node", "left").select("fp", F.coalesce("of_node", "least").alias("component_id"))
    out = docs.join(named, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def without_near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id (null last), then row key."""
    docs, nodes = _grouped(documents, doc_id, text)
    first = docs.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("row"))
    kept = first.join(nodes, "fp", "left").groupBy(F.coalesce("node", "fp").alias("node")).agg(F.min("row").alias("row")).select(F.col("row.key").alias("_kept"))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), row_key(F.col(doc_id), F.col(text)).alias("_key"))
    rows = rows.join(kept, rows._key == kept._kept, "left_semi").dropDuplicates(["_key"])
    return rows.select("row.*")
