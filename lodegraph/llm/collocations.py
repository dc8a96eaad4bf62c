"""Phrase collocations from word-id suffix arrays.

Each task reads its texts as shards of about SHARD_CHARS letters: words become ids, prefix doubling in numpy sorts the suffixes
of the id sequence, and the intervals of their longest common prefixes are its n-grams with their counts, which Spark
sums by language and phrase. An n-gram can only reach min_count if its words and its pairs of words do, so there are three
rounds: words; keys of pairs of words that reached it; phrases within runs of such pairs. What reached it is looked up in
sorted files of 64-bit keys (sorted_counts.py): a chance equality there only lets an n-gram be counted in vain, as the
counts that are used are summed by the phrase itself. Nothing is pruned otherwise, so every one of them is exact.

A candidate's score is that of its weakest cut, floor(1000 * a * n / (l * r)), in whole decimals of 38 digits. Candidates
within a longer one that is as common go. The best `top` of a language are found by hashed parts of it first, so that no
task orders a whole language.

Words are cut out of UTF-8 bytes by numpy. A shard identifies words by 64-bit hashes of language and bytes (chance
equality within a shard of a million words: 3 in 10^8). Defined cases: a null or empty text has no words; a null language
is `und` (and shares its counts); rows repeated count each time; very long texts and words are read to their end; ties
are ordered by count and phrase; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.llm import sorted_counts
from lodegraph.llm.common import written

LONGEST, MIN_COUNT, TOP, SHARD_CHARS, SLICE_ROWS, PARTS = 5, 100, 2000, 6 << 20, 1 << 17, 64
UNKNOWN = "und"

_BREAK, _SPACE = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = _BREAK
_KIND[np.frombuffer(b" \t", np.uint8)] = _SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: sums of its mixed eight-byte parts, each with its place."""
    n = ends - starts
    out = _mix(n.astype(np.uint64))
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(buf) + 1, 8), (1, 1))
    live = np.arange(len(n))
    for k in range(0, int(n.max(initial=0)), 8):
        live = live[n[live] > k]
        part = np.ascontiguousarray(eight[starts[live] + k]).view("<u8").ravel()
        left = (n[live] - k).clip(max=8).astype(np.uint64)
        part = np.where(left == 8, part, part & ((np.uint64(1) << (left % np.uint64(8) * np.uint64(8))) - np.uint64(1)))
        out[live] += _mix(part + np.uint64((k + 1) * _ODD & 2**64 - 1))
    return _mix(out)


def _joined(lang: np.ndarray, first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """Keys of words, or of pairs of words, within their languages, as signed 64-bit numbers."""
    h = _mix(first ^ _mix(lang + np.uint64(_ODD)))
    return (h if second is None else _mix(h * np.uint64(3) + second)).view(np.int64)


def text_hash(text: str) -> np.uint64:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return _hash_words(raw, np.array([0]), np.array([len(raw)]))[0]


class Shard:
    """Texts with languages as one sequence of word ids (from 1), a 0 behind each piece."""

    def __init__(self, texts: list[str], langs: list[str]) -> None:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.array([len(x) + 1 for x in raw], np.int64)
        self.buf = _LOWER[np.frombuffer(b"\n".join([*raw, b""]), np.uint8)]
        kind = _KIND[self.buf]
        edge = np.flatnonzero(np.diff((kind == 0).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        starts, ends = edge[::2], edge[1::2]
        self.names = sorted(set(langs))
        number = {x: i for i, x in enumerate(self.names)}
        of = np.array([number[x] for x in langs], np.int64)
        lang = np.repeat(of, sizes)[starts] if len(starts) else np.zeros(0, np.int64)
        hashes = _hash_words(self.buf, starts, ends)
        self.lang_hash = np.array([text_hash(x) for x in self.names], np.uint64)
        keys = _joined(self.lang_hash[lang], hashes)
        distinct, at, same = np.unique(keys, return_index=True, return_inverse=True)
        self.starts, self.ends, self.lang = starts[at], ends[at], lang[at]  # of each distinct word
        self.keys, self.hashes = distinct, hashes[at]
        self.n_lang = np.bincount(lang, minlength=len(self.names))
        breaks = np.concatenate(([0], np.cumsum(kind == _BREAK)))
        last = np.flatnonzero(np.diff(breaks[starts], append=-1))  # words that end a piece
        self.seq = np.insert(same.astype(np.int64) + 1, last + 1, 0)

    def phrases(self, ids: np.ndarray) -> pa.Array:
        """Phrases by the ids (less one) of their words, a row a phrase, as UTF-8 with one space between words."""
        n, k = ids.shape
        begin, size = self.starts[ids].ravel(), (self.ends - self.starts)[ids].ravel()
        inner = np.tile(np.arange(k) < k - 1, n)  # words with a space behind them
        taken = size + inner
        ends = np.cumsum(taken)
        data = self.buf[np.arange(ends[-1] if n else 0) - np.repeat(ends - taken - begin, taken)]
        data[(ends - 1)[inner]] = 32
        offsets = np.concatenate(([0], ends[k - 1 :: k])).astype(np.int32)
        return pa.StringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))

    def without(self, known: np.ndarray) -> np.ndarray:
        """The sequence with a 0 for each word of which known (by id less one) is false."""
        return np.where(np.concatenate(([False], known))[self.seq], self.seq, 0)

    def pair_keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _joined(self.lang_hash[self.lang[a]], self.hashes[a], self.hashes[b])

    def cut(self, seq: np.ndarray, pairs: sorted_counts.Counts) -> np.ndarray:
        """seq with a 0 put in between words that are not a known pair."""
        at = np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0))
        distinct, same = np.unique(self.pair_keys(seq[at] - 1, seq[at + 1] - 1), return_inverse=True)
        return np.insert(seq, at[(pairs(distinct) == 0)[same]] + 1, 0)


def suffixes(seq: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes of seq, ordered by their first depth ids at least, by prefix doubling."""
    _, rank = np.unique(seq, return_inverse=True)
    rank = rank.astype(np.int64)
    done = 1
    while done < depth:
        beyond = np.zeros(len(rank), np.int64)
        beyond[:-done] = rank[done:] + 1  # 0 behind the end
        key = rank * (len(rank) + 2) + beyond
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank[order] = new
        done *= 2
    return np.argsort(rank, kind="stable")


def grams(seq: np.ndarray, least: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length k: one place of every n-gram without a 0, and its count, from intervals of longest common prefixes."""
    if not len(seq):
        return
    order = suffixes(seq, most)
    padded = np.concatenate([seq, np.zeros(most, np.int64)])
    whole = np.ones(len(order), bool)  # the suffix goes on for k ids before a 0
    common = np.ones(len(order) - 1, bool)  # two neighbours begin with the same k ids
    for k in range(1, most + 1):
        ids = padded[order + k - 1]
        whole &= ids > 0
        common &= ids[1:] == ids[:-1]
        if k < least:
            continue
        begins = np.flatnonzero(np.concatenate(([True], ~common)))
        n = np.diff(np.append(begins, len(order)))
        kept = whole[begins]
        yield k, order[begins[kept]], n[kept]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[str]]]:
    """Texts and languages of about SHARD_CHARS letters."""
    texts, langs, size = [], [], 0
    for batch in batches:
        for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not t:
                continue
            texts.append(t)
            langs.append(UNKNOWN if lang is None else lang)
            size += len(t)
            if size >= SHARD_CHARS:
                yield texts, langs
                texts, langs, size = [], [], 0
    if texts:
        yield texts, langs


def _count(docs: DataFrame, least: int, most: int, words: sorted_counts.Counts | None, pairs: sorted_counts.Counts | None) -> DataFrame:
    """lang, k, phrase, n: counts of phrases of least to most words, summed; those made of known words and pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in _slices(batches):
            shard = Shard(texts, langs)
            seq = shard.seq if words is None else shard.without(words(shard.keys) > 0)
            seq = seq if pairs is None else shard.cut(seq, pairs)
            names = pa.array(shard.names, pa.string())
            for k, at, n in grams(seq, least, most):
                for i in range(0, len(at), SLICE_ROWS):
                    ids = seq[at[i : i + SLICE_ROWS, None] + np.arange(k)] - 1
                    columns = [names.take(pa.array(shard.lang[ids[:, 0]])), pa.array(np.full(len(ids), k, np.int32)), shard.phrases(ids), pa.array(n[i : i + SLICE_ROWS])]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "k", "phrase", "n"])

    return docs.mapInArrow(run, "lang string, k int, phrase string, n long").groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))


def _known_words(words: DataFrame) -> sorted_counts.Counts:
    """Words as sorted keys that tasks look up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lang, word = (np.array([text_hash(x) for x in pdf[c]], np.uint64) for c in ("lang", "phrase"))
            yield pd.DataFrame({"key": _joined(lang, word), "n": pdf["n"]})

    return sorted_counts.write(words.select("lang", "phrase", "n").mapInPandas(run, "key long, n long"), "collocation-known-words")


def _known_pairs(docs: DataFrame, words: sorted_counts.Counts, min_count: int) -> sorted_counts.Counts:
    """The keys of pairs of known words that are found min_count times, summed by key alone: of two pairs with one key the
    counts are added up, so no pair is missed; those let through in vain fall out when phrases are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in _slices(batches):
            shard = Shard(texts, langs)
            seq = shard.without(words(shard.keys) > 0)
            for _, at, n in grams(seq, 2, 2):
                keys = shard.pair_keys(seq[at] - 1, seq[at + 1] - 1)
                for i in range(0, len(at), SLICE_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + SLICE_ROWS]), pa.array(n[i : i + SLICE_ROWS])], ["key", "n"])

    sums = docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return sorted_counts.write(sums.where(F.col("n") >= min_count), "collocation-known-pairs")


def frequent(documents: DataFrame, lang: str = "lang", text: str = "text", min_count: int = MIN_COUNT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """lang, k, phrase, n of all phrases of 1 to longest words found min_count times, and lang, total of each language."""
    docs = documents.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    often = F.col("n") >= min_count
    every = written(_count(docs, 1, 1, None, None), "collocation-words")
    totals = every.groupBy("lang").agg(F.sum("n").alias("total"))
    words = every.where(often)
    known = _known_words(words)
    pairs = _known_pairs(docs, known, min_count)
    return words.unionByName(written(_count(docs, 2, longest, known, pairs).where(often), "collocation-phrases")), totals


def _part(first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice("w", first, n), " ")


def scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score of all phrases of two words or more, by their weakest cut."""
    every = found.select("lang", "phrase", "k", F.col("n").alias("a"))
    cuts = every.where("k > 1").withColumn("w", F.split("phrase", " ")).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", _part(F.lit(1), F.col("cut")).alias("left"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    side = lambda part, n: every.select("lang", F.col("phrase").alias(part), F.col("a").alias(n))
    n = totals.withColumnRenamed("total", "n")
    met = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(F.broadcast(n) if _few(n) else n, "lang")
    score = F.expr("cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(18,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = met.groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct(score.alias("score"), F.col("cut"), F.col("l"), F.col("r"))).alias("b"))
    return best.select("lang", "phrase", "k", "a", "b.l", "b.r", "n", "b.score")


def _few(totals: DataFrame, most: int = 10_000) -> bool:
    """Whether there are few enough languages to send them everywhere."""
    return len(totals.limit(most + 1).collect()) <= most


def collocations(documents: DataFrame, lang: str = "lang", text: str = "text", min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, share: int = 100) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score. A candidate goes if a longer one that holds it
    has share hundredths of its count."""
    found, totals = frequent(documents, lang, text, min_count, longest)
    all_scored = written(scored(found, written(totals, "collocation-totals")), "collocation-scores")
    inner = all_scored.where("k > 2").withColumn("w", F.split("phrase", " "))
    spans = F.array([F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for n in range(2, longest) for i in range(1, longest - n + 2)])
    inner = inner.withColumn("s", F.explode(F.filter(spans, lambda s: (s["n"] < F.col("k")) & (s["i"] + s["n"] <= F.col("k") + 1)))) if longest > 2 else inner.withColumn("s", F.lit(None).cast("struct<i:int,n:int>"))
    held = inner.select("lang", _part(F.col("s.i"), F.col("s.n")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = all_scored.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # a language's best are among the best of each hashed part of it
    part = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
