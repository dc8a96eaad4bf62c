"""Best-fit packing into bins of several permitted lengths.

Lengths are those of token ids, the end id with them, if a tokenizer is named, else words. Documents longer than the largest length are cut into pieces of it and a remainder. Pieces are dealt by a hash of their
document into groups of about GROUP_TOKENS tokens, and each group is packed by itself, so no group grows with the
table and no bin crosses groups. Inside a group, pieces go longest first into the open bin they leave the least room
in; if none has room, a bin opens at the permitted length that costs least: the one whose length, as the pieces still
to come would fill it, wastes the smallest share. At the end each bin is downsized to the smallest permitted length
that holds its contents.

Defined cases: a null or empty text has its end token alone; repeated rows are packed once each; an empty table gives
no bins; very long texts are cut into pieces to their end; ties go to the smaller id, then text; other columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import written
from lodegraph.llm.token_store import BATCH_CHARS, encoded, encoder_of

CAPACITIES, GROUP_TOKENS = (512, 1024, 2048, 4096), 4 << 20


def word_tokens(text: Column) -> Column:
    """Words between white space, and one token for the end."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(trimmed == "", F.lit(1)).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 2)


def token_counts(tokenizer: str, text: Column) -> Column:
    """How many ids a text has, with the end id."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encoder, rows, out, at = encoder_of(tokenizer), texts.tolist(), [], 0
        while at < len(rows):
            to, chars = at, 0
            while to < len(rows) and (to == at or chars < BATCH_CHARS):
                chars, to = chars + len(rows[to] or ""), to + 1
            out += [len(ids) // encoder.width + 1 for ids in encoder.encode(rows[at:to])]
            at = to
        return pd.Series(out, dtype="int64")

    return count(text)


def opening_size(length: int, shorter: list[int], capacities: tuple[int, ...]) -> int:
    """The capacity to open for a piece: least expected waste a token, if it is filled with the longest pieces to come
    that fit. shorter: the lengths still to come, ascending. Ties go to the smaller capacity."""
    best, cost = capacities[-1], None
    for size in capacities:
        if size < length:
            continue
        room, at = size - length, len(shorter)
        while room and (at := bisect_left(shorter, room + 1, 0, at)):  # until no room or no piece is left
            n = shorter[at - 1]
            least = bisect_left(shorter, n, 0, at)  # equal lengths in one step
            room -= n * min(room // n, at - least)
            at = least
        if cost is None or room / size < cost:
            best, cost = size, room / size
    return best


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and each bin's length. lengths in any order, none above the largest capacity."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    to_come = sorted(lengths)
    bins, offsets, filled = [0] * len(lengths), [0] * len(lengths), []
    room: list[tuple[int, int]] = []  # free space and bin, ascending
    for i in order:
        n = lengths[i]
        to_come.pop()
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            b, free = len(filled), opening_size(n, to_come, capacities)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += n
        if free > n:
            insort(room, (free - n, b))
    return bins, offsets, [capacities[bisect_left(capacities, f)] for f in filled]


def pack(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokens: Column | None = None, tokenizer: str | None = None, capacities: tuple[int, ...] = CAPACITIES, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """doc_id, piece, token_start, n_tokens, bin_id, bin_length, bin_offset: one row a piece."""
    sizes = tuple(sorted(capacities))
    if tokens is None:
        tokens = token_counts(tokenizer, F.col(text)) if tokenizer else word_tokens(F.col(text))
    docs = documents.select(F.col(doc_id).alias("doc_id"), tokens.cast("long").alias("tokens"), F.xxhash64(F.col(doc_id), F.col(text)).alias("h"))
    docs = written(docs, "packing-lengths")
    total = docs.agg(F.sum("tokens")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "h"], kind="stable")
        n = pdf["tokens"].to_numpy(np.int64)
        whole, rest = np.divmod(n, sizes[-1])
        pieces = whole + (rest > 0)
        of = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(n[of] - piece * sizes[-1], sizes[-1])
        bins, offsets, filled = best_fit(length.tolist(), sizes)
        group = int(pdf["grp"].iloc[0])
        return pd.DataFrame({
            "doc_id": pdf["doc_id"].astype("Int64").to_numpy()[of], "piece": piece, "token_start": piece * sizes[-1], "n_tokens": length,
            "bin_id": (group << 32) + np.array(bins, np.int64), "bin_length": np.array(filled, np.int64)[bins], "bin_offset": offsets,
        })

    schema = "doc_id long, piece long, token_start long, n_tokens long, bin_id long, bin_length long, bin_offset long"
    # the row hash joins in, so that rows that share an id, or have none, spread too
    return docs.withColumn("grp", F.pmod(F.xxhash64("doc_id", "h"), F.lit(groups))).groupBy("grp").applyInPandas(run, schema)


def bins(documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacities: tuple[int, ...] = CAPACITIES, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """bin_id, bin_length, n_tokens, doc_ids and ids (array, in order, without padding): the packed sequences."""
    width = encoder_of(tokenizer).width
    rows = written(encoded(documents, tokenizer, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "packing-ids")
    pieces = pack(rows, "row", "ids", tokens=F.octet_length("ids") / width, capacities=capacities, group_tokens=group_tokens).withColumnRenamed("doc_id", "row")
    cut = F.substring(F.col("ids"), (F.col("token_start") * width + 1).cast("int"), (F.col("n_tokens") * width).cast("int"))
    each = pieces.join(rows, "row").select("bin_id", "bin_length", F.struct("bin_offset", "doc_id", "n_tokens", F.hex(cut).alias("part")).alias("p"))
    whole = each.groupBy("bin_id", "bin_length").agg(F.array_sort(F.collect_list("p")).alias("ps"), F.sum("p.n_tokens").alias("n_tokens"))  # a bin's length at most
    size = 2 * width  # hex digits of an id, little-endian
    number = lambda data, i: F.conv(F.concat(*[F.substring(data, i * size + 2 * b + 1, F.lit(2)) for b in range(width - 1, -1, -1)]), 16, 10).cast("int")
    once = F.array(F.struct(F.array_join(F.transform("ps", lambda p: p["part"]), "").alias("data"), F.col("n_tokens").cast("int").alias("n")))
    ids = F.transform(once, lambda x: F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda i: number(x["data"], i)))[0]
    return whole.select("bin_id", "bin_length", "n_tokens", F.transform("ps", lambda p: p["doc_id"]).alias("doc_ids"), ids.alias("ids"))
