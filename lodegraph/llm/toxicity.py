"""Toxicity by class-conditional Kneser-Ney models.

The models read words letter by letter: a letter (code point) or a word's end, given the ORDER - 1 letters before it in
its word, the word's beginning among them. A model's probability is absolute discounting of its class's counts,
interpolated with the shared model, and the shared model is Kneser-Ney over all documents: discounted counts, backed off
to how many different contexts a letter follows the one before it in. An expression that one class has hardly seen thus
costs about as much under either class. A word's evidence is the difference of its log-likelihoods, and a text's are
means over its words and over its one and three most toxic ones, so length does not count by itself.

Counts are gathered from every document (shared) and every labelled training row (classes): each task merges the grams
of its texts, and Spark sums them by gram. The tables grow with the corpus; a gram is known by a 64-bit hash beside that
of its context. Evidence of grams is held in whole numbers, so that it does not depend on partitions, and is written as
sorted shards in the shared folder, which scoring looks words up in; the driver holds no counts. A logistic curve over
the length-normalised differences is fitted to at most FIT_ROWS labelled rows of one training fold, scored by models
that have not counted that fold's labels; the final models count all folds. Scripts written without spaces are read as
overlapping pairs of letters.

Defined cases: null, empty and wordless texts score by the curve at no evidence; null labels and ids without a label
train nothing; a label repeated with both values counts in both classes; without both classes every score is 0; very
long texts and words are read to their end; equal texts have equal scores; rows repeated count and are scored each; among
rows of equal hash the curve's sample takes the smaller id; other columns pass through or are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.llm.common import filesystem, shared_dir, written

ORDER, DISCOUNT, FIT_ROWS, CHUNK, HELD_GRAMS, SHARD_GRAMS, HELD_BYTES = 6, 0.75, 20_000, 1 << 19, 1 << 20, 1 << 20, 128 << 20
BROADCAST_BYTES, UNIT = 64 << 20, 1 << 32  # evidence is held in whole parts of 1 / UNIT
COUNTS = ("n_all", "n_0", "n_1", "n_2", "n_3")  # all documents; labels 0 and 1 of fold 0, then of fold 1, which the curve is fitted to
GRAM = "gram long, context long, pair long"
THRESHOLD = 0.3
FEATURES = ("mean", "top1", "top3", "share", "long")

UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")


def _pairs(run: re.Match) -> str:
    letters = run[0]
    return " " + " ".join(letters[i : i + 2] for i in range(max(1, len(letters) - 1))) + " "


def _points(text: str | None) -> np.ndarray:
    low = (text or "").lower()
    return np.frombuffer((low if low.isascii() else UNSPACED.sub(_pairs, low)).encode("utf-32-le", "surrogatepass"), np.uint32)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of texts of about CHUNK letters: first, last (exclusive), code points with a 0 after each text."""
    at, held, size, end = 0, [], 0, np.zeros(1, np.uint32)
    for i, t in enumerate(texts):
        held += [_points(t), end]
        size += len(held[-2])
        if size >= CHUNK or i == len(texts) - 1:
            yield at, i + 1, np.concatenate(held)
            at, held, size = i + 1, [], 0


#: Letters of words: all code points from U+0080 on but the Latin-1 and general punctuation, and these.
ASCII_LETTERS = np.zeros(128, bool)
ASCII_LETTERS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789'", np.uint8)] = True


def _words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end (exclusive)."""
    letter = ASCII_LETTERS[np.minimum(buf, 127)]
    high = buf > 127
    if high.any():
        b = buf[high]
        letter[high] = (b >= 0xAA) & (b != 0xAB) & (b != 0xBB) & (b != 0xBF) & ((b < 0x2000) | (b > 0x206F)) & ((b < 0x3000) | (b > 0x3004))
    edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    return edge[::2], edge[1::2]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _within(lengths: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each length n, end to end."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _distinct(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words as 0 word 0 word 0 ..., the place of each one's first letter there, and each word's number among them."""
    lengths = ends - starts
    place = _within(lengths)
    points = buf[np.repeat(starts, lengths) + place].astype(np.uint64)
    powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
    keys = _mix(np.add.reduceat(_mix(points + np.uint64(0xA5A5)) * powers[place], np.cumsum(lengths) - lengths))
    _, at, same = np.unique(keys, return_index=True, return_inverse=True)
    n = lengths[at]
    begin = 1 + np.cumsum(n + 1) - (n + 1)
    words = np.zeros(int((n + 1).sum()) + 1, np.uint64)
    step = _within(n)
    words[np.repeat(begin, n) + step] = buf[np.repeat(starts[at], n) + step]
    return words, begin, same


def _grams(words: np.ndarray, begin: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram, context and pair of each letter and each end of words laid out by _distinct, and where each word's first one is."""
    n = np.diff(np.append(begin, len(words)))  # letters and the end
    behind = _within(n) + 1  # how far back the word's beginning is
    letter = words[1:]
    h = np.full(len(letter), 0x2545F4914F6CDD1D, np.uint64)
    for k in range(order - 1, 0, -1):
        far = np.flatnonzero(behind >= k)
        h[far] = _mix(h[far] ^ (words[far + 1 - k] + np.uint64(1)))
    gram = _mix(h ^ ((letter + np.uint64(1)) << np.uint64(24)))
    return gram.view(np.int64), h.view(np.int64), (words[:-1] << np.uint64(32) | letter).view(np.int64), np.cumsum(n) - n


def _merged(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    joined = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    gram, at, same = np.unique(joined["gram"], return_index=True, return_inverse=True)
    sums = {c: np.bincount(same, joined[c], len(gram)).astype(np.int64) for c in COUNTS}
    return {"gram": gram, "context": joined["context"][at], "pair": joined["pair"][at], **sums}


def _gather(order: int):
    """From texts to grams with counts, merged as far as HELD_GRAMS."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict[str, np.ndarray]] = []
        size = 0
        for pdf in batches:
            texts, labels = pdf["text"].tolist(), pdf["part"].to_numpy(dtype=float, na_value=np.nan)
            for first, last, buf in _chunks(texts):
                starts, ends = _words(buf)
                if not len(starts):
                    continue
                words, begin, same = _distinct(buf, starts, ends)
                part = labels[first:last][np.searchsorted(np.flatnonzero(buf == 0), starts)]
                gram, context, pair, _ = _grams(words, begin, order)
                of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(words))))
                counts = {"n_all": np.bincount(same, minlength=len(begin)), **{f"n_{c}": np.bincount(same[part == c], minlength=len(begin)) for c in range(4)}}
                held.append(_merged([{"gram": gram, "context": context, "pair": pair, **{c: n[of] for c, n in counts.items()}}]))
                size += len(held[-1]["gram"])
                if size > HELD_GRAMS:
                    held = [_merged(held)]
                    size = len(held[0]["gram"])
                    if size > HELD_GRAMS // 2:
                        yield pd.DataFrame(held.pop())
                        size = 0
        if held:
            yield pd.DataFrame(_merged(held))

    return run


def counted(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, context, pair and COUNTS of all grams; texts: text, and part (label + 2 * fold, or null)."""
    parts = texts.select("text", "part").mapInPandas(_gather(order), GRAM + ", " + ", ".join(f"{c} long" for c in COUNTS))
    return written(parts.groupBy("gram", "context", "pair").agg(*[F.sum(c).alias(c) for c in COUNTS]), "toxicity-grams")


def evidence(grams: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """gram, and by how much likelier it is in a toxic text, in parts of 1 / UNIT: under the models without fold 1
    (first) and under those of all folds (final). Grams without evidence are left out."""
    # continuation counts: how many grams end in this pair of letters, of those that end in any pair with the same first one
    pairs = grams.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).withColumn("head", F.shiftright("pair", 32))
    heads = pairs.groupBy("head").agg(F.sum("n").alias("of"))
    tails = pairs.join(heads, "head").select("pair", ((F.col("n") + 0.5) / (F.col("of") + 128.0)).alias("p_pair"))
    marked = " + ".join(COUNTS[1:])
    beside = Window.partitionBy("context")  # what follows one context: the letters of its script at most

    def discounted(n: Column, back: Column) -> Column:
        total, kinds = F.sum(n).over(beside), F.sum((n > 0).cast("long")).over(beside)
        return F.when(total > 0, F.greatest(n - discount, F.lit(0.0)) / total + discount * kinds / total * back).otherwise(back)

    # a context no label has followed holds no evidence: it goes before the back-off is looked up
    known = grams.withColumn("marked", F.sum(F.expr(marked)).over(beside)).where("marked > 0")
    total, kinds = F.sum("n_all").over(beside), F.sum((F.col("n_all") > 0).cast("long")).over(beside)
    known = known.withColumns({"total": total, "kinds": kinds}).join(tails, "pair")
    known = known.withColumn("shared", F.greatest(F.col("n_all") - discount, F.lit(0.0)) / F.col("total") + discount * F.col("kinds") / F.col("total") * F.col("p_pair"))
    log = lambda n: F.log(F.greatest(discounted(n, F.col("shared")), F.lit(1e-12)))
    n = [F.col(c) for c in COUNTS[1:]]
    differ = {"first": log(n[1]) - log(n[0]), "final": log(n[1] + n[3]) - log(n[0] + n[2])}
    return known.select("gram", *[F.round(d * UNIT).cast("long").alias(k) for k, d in differ.items()]).where("first <> 0 or final <> 0")


class Lookup:
    """Evidence by gram from sorted shards in a folder that all executors read. sizes: the grams of each shard that was
    written; one that is missing or short raises, so a lost file never reads as no evidence. Local files are mapped;
    of others, HELD_BYTES at most are kept."""

    opened: OrderedDict[str, np.ndarray] = OrderedDict()

    def __init__(self, path: str, sizes: dict[int, int], shards: int, column: str) -> None:
        self.path, self.sizes, self.shards, self.column = path, sizes, shards, column

    def _shard(self, shard: int) -> np.ndarray:
        name, grams = f"{self.path}/{shard}.evidence", self.sizes.get(shard, 0)
        if not grams:
            return np.zeros((3, 0), np.int64)
        if name in self.opened:
            self.opened.move_to_end(name)
            return self.opened[name]
        disk, file = filesystem(name)
        held = disk.get_file_info(file).size
        if held != 24 * grams:
            raise OSError(f"{name} should hold {24 * grams} bytes and has {held}")
        if disk.type_name == "local":
            data = np.memmap(file, np.int64, "r").reshape(3, -1)
        else:
            with disk.open_input_file(file) as f:
                data = np.frombuffer(f.read(), np.int64).reshape(3, -1)
        self.opened[name] = data
        while len(self.opened) > 1 and sum(x.nbytes for x in self.opened.values() if not isinstance(x, np.memmap)) > HELD_BYTES:
            self.opened.popitem(last=False)
        return data

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        out, of = np.zeros(len(grams)), grams & (self.shards - 1)
        for shard in np.unique(of).tolist():
            held = self._shard(shard)
            if held.shape[1]:
                mine = np.flatnonzero(of == shard)
                at = np.minimum(np.searchsorted(held[0], grams[mine]), held.shape[1] - 1)
                out[mine] = np.where(held[0][at] == grams[mine], held[1 + ("first", "final").index(self.column)][at], 0)
        return out


def _sharded(found: DataFrame) -> tuple[str, dict[int, int], int]:
    """Folder, grams by shard and number (a power of two) of the shards of found, each of about SHARD_GRAMS grams; one row
    a shard passes the driver."""
    found = written(found, "toxicity-evidence")
    shards = 1 << max(0, (found.count() - 1) // SHARD_GRAMS).bit_length()
    path = f"{shared_dir(found.sparkSession)}/toxicity-shards-{uuid.uuid4().hex}"

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, rows = int(pdf["shard"].iloc[0]), pdf.sort_values("gram")
        disk, folder = filesystem(path)
        disk.create_dir(folder, recursive=True)
        part = f"{folder}/_attempt-{uuid.uuid4().hex}"
        with disk.open_output_stream(part) as out:
            out.write(rows[["gram", "first", "final"]].to_numpy(np.int64).T.tobytes())
        disk.move(part, f"{folder}/{shard}.evidence")
        return pd.DataFrame({"shard": [shard], "n": [len(rows)]})

    made = found.withColumn("shard", F.col("gram").bitwiseAND(F.lit(shards - 1))).groupBy("shard").applyInPandas(write, "shard long, n long").collect()
    return path, {r.shard: r.n for r in made}, shards


def features(texts: list[str | None], look: Callable[[np.ndarray], np.ndarray], order: int = ORDER) -> np.ndarray:
    """FEATURES of each text: the mean difference over its words, over its most toxic one and three words, the share of
    words that are far likelier as toxic ones, and whether it has words at all."""
    out = np.zeros((len(texts), len(FEATURES)))
    for first, last, buf in _chunks(texts):
        starts, ends = _words(buf)
        if not len(starts):
            continue
        words, begin, same = _distinct(buf, starts, ends)
        gram, _, _, at = _grams(words, begin, order)
        d = (np.add.reduceat(look(gram), at) / UNIT)[same]
        of = np.searchsorted(np.flatnonzero(buf == 0), starts)
        n = np.bincount(of, minlength=last - first).astype(float)
        some = n > 0
        sinking = np.lexsort((-d, of))
        rank = np.arange(len(d)) - np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64)[of[sinking]]
        best = np.where(rank < 3, d[sinking], 0.0)
        mean = lambda w: np.bincount(of, w, last - first) / np.maximum(n, 1)
        part = out[first:last]
        part[:, 0] = mean(d) * 10
        part[:, 1] = np.bincount(of[sinking], np.where(rank < 1, best, 0), last - first)
        part[:, 2] = np.bincount(of[sinking], best, last - first) / np.clip(n, 1, 3)
        part[:, 3] = np.log1p(100 * mean((d > 3).astype(float)))
        part[:, 4] = some
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the constant. Without both classes it is far below 0."""
    w = np.zeros(x.shape[1] + 1)
    if len(set(y.tolist())) < 2:
        w[-1] = -50.0
        return w
    a = np.hstack([x, np.ones((len(x), 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _split(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def scorer(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS, order: int = ORDER, broadcast_bytes: int = BROADCAST_BYTES) -> Callable[[Column], Column]:
    """Learns from documents and labels; the result makes a column of texts one of scores."""
    held_out, fold = _split(F.col("doc_id")) == 2, (_split(F.col("doc_id")) == 3).cast("int")
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(~held_out).distinct()
    n_marks = marks.agg(F.count(F.lit(1)).alias("n")).first().n
    marks = marks.select("doc_id", (F.col("toxic") + 2 * fold).cast("byte").alias("part"))
    train = docs.join(F.broadcast(marks) if n_marks * 24 <= broadcast_bytes else marks, "doc_id", "left")
    shards = _sharded(evidence(counted(train, order)))
    first, final = Lookup(*shards, "first"), Lookup(*shards, "final")

    def score_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = features(pdf["text"].tolist(), first, order)
            yield pd.DataFrame({**{c: pdf[c] for c in ("h", "h_text", "toxic")}, **{f: x[:, i] for i, f in enumerate(FEATURES)}})

    chosen = marks.where("part >= 2").orderBy(F.xxhash64("doc_id"), "doc_id", "part").limit(fit_rows)
    sample = docs.join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("h_text"), "text", (F.col("part") - 2).cast("int").alias("toxic"))
    measured = sample.mapInPandas(score_features, "h long, h_text long, toxic int, " + ", ".join(f"{f} double" for f in FEATURES))
    # ids may be repeated in documents: the bound is one of rows, so it is set behind the join
    rows = measured.orderBy("h", "toxic", "h_text").limit(fit_rows).drop("h", "h_text").toPandas()
    rows = rows.sort_values(["toxic", *FEATURES])  # sums in one order, however the rows came
    weights = fit(rows[list(FEATURES)].to_numpy(float), rows["toxic"].to_numpy(float))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = features(texts.tolist(), final, order)
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -60, 60))))

    return score


def toxicity(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    score = scorer(documents, labels, doc_id, text, label)
    out = documents.select(F.col(doc_id).alias("doc_id"), score(F.col(text)).alias("score"))
    return out.select("doc_id", F.coalesce(_split(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents, with all their columns, that score below the threshold."""
    return documents.where(scorer(documents, labels, doc_id, text, label)(F.col(text)) < threshold)
