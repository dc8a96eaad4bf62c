"""Token-ID output: shards of raw ids with a minimal perfect hash index from document keys to offsets.

A shard file is a header, the ids of its documents end to end (little-endian, 2 or 4 bytes each), of each document in file
order its key, offset and length, of each hash slot a fingerprint, a row and how many rows have that key, and the levels
of the hash with samples of their ranks. get() finds a key's rows by reads of fixed size: the store's bounds name its
part, the part's index its shard, and the hash its row.
Texts are encoded where they are read, and their ids, not they, are shuffled: dealt by ranges of doc_id, whose bounds are
quantiles; the rows of an id, or of null, that fills several ranges spread over them by a hash of their ids. The files, in order of their names, hold ascending
doc_ids; a file is written under an attempt's own name and then renamed, so a task may run again. Each task closes a
shard at SHARD_BYTES, so no file or read grows with the table; a key may have rows in several shards.

Texts are encoded piece by piece where that is exact: a lone space or line feed between two characters that are not
white space always ends a pre-token of a byte-level vocabulary, and so does a letter or digit before punctuation, so
pieces between them have ids of their own, which are kept for later texts, up to CACHE_BYTES a worker; pieces over
PIECE_CHARS are not kept. A batch looks each of its distinct pieces up once. Any text with other white space, or with an
added token's string, is encoded whole.

Defined cases: a null or empty text is the end id alone; a null doc_id sorts first and has a key of its own; rows with
the same doc_id stand side by side, in order of a hash of their ids, and lookups give them all; rows repeated are written each;
very long texts and lines without spaces are encoded whole; doc_ids have to be whole numbers, others raise; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.llm import perfect_hash
from lodegraph.llm.common import filesystem, shared_dir, written

MAGIC, HEADER = b"LGIDS002", struct.Struct("<8sIIQQQQ")
ROW, ENTRY = np.dtype([("id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("n", "<u4")]), np.dtype([("print", "<u4"), ("row", "<u4"), ("rows", "<u4")])
SHARD_BYTES, CACHE_BYTES, PIECE_CHARS, BATCH_CHARS, END_ID, NULL_KEY = 16 << 20, 128 << 20, 100, 1 << 20, 0, 0x5EED0F0A11
PIECE_COST = 190  # bytes that a piece takes in a table besides its own and its ids
RUN_PIECES = 2000
#: What stands before a piece that is at its text's start or continues a word, and what before any that follows no space.
JOIN, MARKS = "\r", "\r\n"
#: White space that bars cutting a text behind its JOIN: other than space and line feed, or not alone, or at an end.
UNCUT = r"[ \n]{2}|\A\r[ \n]|[ \n]\z|(?s:.)\r|[\t\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A letter or digit (those of Latin and Cyrillic, which every version of Unicode takes as such) before ASCII punctuation.
TAIL = r"([0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{2af}\x{400}-\x{481}\x{48a}-\x{52f}])([!-/:-@\[-`{-~])"


class Encoder:
    """encode(texts): the ids of each as little-endian bytes, without special tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        form = json.loads(self.tokenizer.to_str())
        before = form["pre_tokenizer"] or {}
        # cut at lone spaces only where the file says no more than that: truncation counts over the whole text
        self.bytewise = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and form["normalizer"] is None and form["truncation"] is None
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for piece, i in self.tokenizer.get_vocab().items():
            self.sizes[i] = len(piece)  # one letter stands for one byte
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, known: dict[str, bytes], new: list[str], sizes: np.ndarray, marked: bool) -> None:
        """Encodes new pieces (sizes: their bytes) in runs; the bytes that each id stands for tell the piece it is of. A piece that
        has no mark follows a space, which is part of it; JOIN stands for nothing, but a line feed keeps its place in a run."""
        w = self.width
        for at in range(0, len(new), RUN_PIECES):
            run = new[at : at + RUN_PIECES]
            text = "".join(run).replace(JOIN, "\n") if marked else " " + " ".join(run)
            ids = np.frombuffer(self._ids([text])[0], f"<u{w}")
            size = sizes[at : at + RUN_PIECES] + (not marked)
            cuts = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(size), "right")
            begins = np.concatenate(([0], cuts[:-1]))
            if marked:
                begins += [p[0] == JOIN for p in run]
            data = ids.tobytes()
            known.update(zip(run, [data[i:j] for i, j in zip((begins * w).tolist(), (cuts * w).tolist(), strict=True)], strict=True))
            self.held += len(data) + int(size.sum()) + PIECE_COST * len(run)

    def _forget(self, long: list[str]) -> None:
        """Drops long pieces, and all once the tables are full."""
        if self.held > CACHE_BYTES:
            self.first.clear()
            self.later.clear()
            self.held = 0
        for p in long:
            self.first.pop(p, None)
            self.later.pop(p, None)

    def _by_pieces(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts that may be cut, a JOIN before each: each piece that they have is looked up once."""
        cut = pc.replace_substring_regex(texts, TAIL, r"\1 " + JOIN + r"\2")
        words = pc.split_pattern(pc.replace_substring(cut, "\n", " \n"), " ")
        coded = words.values.dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        sizes = pc.binary_length(coded.dictionary).to_numpy()
        ids = list(map(self.later.get, pieces))
        new = [i for i, x in enumerate(ids) if x is None]
        for known, marked in ((self.first, True), (self.later, False)):
            learn = [i for i in new if (pieces[i][0] in MARKS) == marked and (not marked or pieces[i] not in known)]
            self._learn(known, [pieces[i] for i in learn], sizes[np.array(learn, np.int64)], marked)
        for i in new:
            ids[i] = (self.first if pieces[i][0] in MARKS else self.later)[pieces[i]]
        at = words.offsets.to_numpy()
        ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))[coded.indices.to_numpy()])))[at]
        data = memoryview(pa.array(ids, pa.large_binary()).take(coded.indices).buffers()[2])
        self._forget([p for p in pieces if len(p) > PIECE_CHARS])
        return [bytes(data[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = [b""] * len(texts)
        some = [i for i, t in enumerate(texts) if t]
        whole, pieced = some, []
        if self.bytewise and some:
            joined = pa.array([JOIN + texts[i] for i in some], pa.large_string())  # of copies: Arrow leaves its UTF-8 with a str
            odd = [x or any(a in texts[i] for a in self.added) for i, x in zip(some, pc.match_substring_regex(joined, UNCUT).to_pylist(), strict=True)]
            whole, pieced = [i for i, x in zip(some, odd, strict=True) if x], [i for i, x in zip(some, odd, strict=True) if not x]
        if whole:
            for i, x in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
                out[i] = x
        if pieced:
            for i, x in zip(pieced, self._by_pieces(joined.filter(pa.array([not x for x in odd]))), strict=True):
                out[i] = x
        return out


@lru_cache(2)
def encoder_of(path: str) -> Encoder:
    """One a Python worker, so that later tasks find its pieces."""
    return Encoder(path)


def _keys(ids: list[int | None]) -> np.ndarray:
    return np.array([(x & (1 << 64) - 1) if x is not None else NULL_KEY for x in ids], np.uint64)


def pack(ids: list[int | None], parts: list[bytes], width: int) -> bytes:
    """A shard's bytes; ids in order, equal ones side by side."""
    n = np.array([len(p) // width for p in parts], np.int64)
    offset = np.cumsum(n) - n
    null = np.array([x is None for x in ids], bool)
    keys = perfect_hash.mixed(_keys(ids), 7) ^ null.astype(np.uint64)
    new = np.concatenate(([True], (keys[1:] != keys[:-1]))) if len(ids) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    ranked = perfect_hash.Ranked.of(perfect_hash.build(keys[at]))
    slot = ranked.find(keys[at])
    table = np.zeros(len(at), ENTRY)
    table["print"][slot], table["row"][slot] = perfect_hash.fingerprints(keys[at]), at
    table["rows"][slot] = np.diff(np.concatenate((at, [len(ids)])))
    rows = np.zeros(len(ids), ROW)
    rows["id"], rows["null"], rows["offset"], rows["n"] = [x or 0 for x in ids], null, offset, n
    payload = b"".join(parts)
    head = HEADER.pack(MAGIC, width, len(ranked.directory), len(rows), len(payload), len(table), len(ranked.samples))
    return b"".join([head, payload, *[x.tobytes() for x in (rows, table, ranked.directory, ranked.samples, ranked.bits)]])


def _hashed(doc_id: int | None) -> np.ndarray:
    return perfect_hash.mixed(_keys([doc_id]), 7) ^ np.uint64(doc_id is None)


class Shard:
    """An open shard: rows() in file order, and get(doc_id) by the index."""

    def __init__(self, data: bytes) -> None:
        magic, self.width, n_levels, n_rows, n_bytes, n_keys, n_blocks = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = HEADER.size
        self.ids = np.frombuffer(data, f"<u{self.width}", n_bytes // self.width, at)
        at += n_bytes
        self.docs = np.frombuffer(data, ROW, n_rows, at)
        at += self.docs.nbytes
        self.table = np.frombuffer(data, ENTRY, n_keys, at)
        at += self.table.nbytes
        directory = np.frombuffer(data, "<u8", 2 * n_levels, at).reshape(-1, 2)
        at += directory.nbytes
        samples = np.frombuffer(data, "<u4", n_blocks, at)
        self.ranked = perfect_hash.Ranked(directory, samples, np.frombuffer(data, np.uint8, -1, at + samples.nbytes))

    def _slots(self, doc_ids: list[int | None]) -> np.ndarray:
        null = np.array([x is None for x in doc_ids], bool)
        keys = perfect_hash.mixed(_keys(doc_ids), 7) ^ null.astype(np.uint64)
        slot = self.ranked.find(keys)
        held = slot >= 0
        held[held] = self.table["print"][slot[held]] == perfect_hash.fingerprints(keys[held])
        return np.where(held, slot, -1)

    def find(self, doc_ids: list[int | None]) -> np.ndarray:
        """First row of each key, -1 if the shard does not hold it."""
        slot = self._slots(doc_ids)
        out = np.full(len(slot), -1, np.int64)
        out[slot >= 0] = self.table["row"][slot[slot >= 0]]
        return out

    def row(self, i: int) -> np.ndarray:
        return self.ids[int(self.docs["offset"][i]) :][: int(self.docs["n"][i])]

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        (slot,) = self._slots([doc_id])
        if slot < 0:
            return []
        first = int(self.table["row"][slot])
        return [self.row(i) for i in range(first, first + int(self.table["rows"][slot]))]


class OpenShard:
    """Keyed access to a shard file without reading it: its header and the directory of its levels once, then a sample and a
    block of bits a level, one entry of the table, and the rows and ids of the key. None of these grows with the file."""

    def __init__(self, file) -> None:
        self.file = file
        magic, self.width, levels, self.n_rows, n_bytes, n_keys, blocks = HEADER.unpack(self._read(0, HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        self.rows = HEADER.size + n_bytes
        self.table = self.rows + self.n_rows * ROW.itemsize
        self.samples = self.table + n_keys * ENTRY.itemsize + 16 * levels
        self.bits = self.samples + 4 * blocks
        self.directory = np.frombuffer(self._read(self.samples - 16 * levels, 16 * levels), "<u8").reshape(-1, 2).tolist()

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each row of a key; no rows if the shard does not hold it."""
        key, block = _hashed(doc_id), perfect_hash.BLOCK
        for level, (begin, size) in enumerate(self.directory):
            at = begin + int(perfect_hash.mixed(key, level)[0]) % size
            bits = np.frombuffer(self._read(self.bits + at // block * (block // 8), block // 8), np.uint8)[None]
            if bits[0, at % block >> 3] >> (7 - at % 8) & 1:
                ahead = np.frombuffer(self._read(self.samples + 4 * (at // block), 4), "<u4")[0]
                slot = int(ahead) + int(perfect_hash._ahead(bits, np.array([at % block]))[0])
                return self._rows(np.frombuffer(self._read(self.table + slot * ENTRY.itemsize, ENTRY.itemsize), ENTRY)[0], key, doc_id)
        return []

    def _rows(self, entry: np.void, key: np.ndarray, doc_id: int | None) -> list[np.ndarray]:
        if entry["print"] != perfect_hash.fingerprints(key)[0]:
            return []
        first, n = int(entry["row"]), int(entry["rows"])
        rows = np.frombuffer(self._read(self.rows + first * ROW.itemsize, n * ROW.itemsize), ROW)
        if (None if rows["null"][0] else int(rows["id"][0])) != doc_id:  # a strange key with the fingerprint of another
            return []
        return [np.frombuffer(self._read(HEADER.size + int(r["offset"]) * self.width, int(r["n"]) * self.width), f"<u{self.width}") for r in rows]


def get(path: str, doc_id: int | None) -> list[np.ndarray]:
    """The ids of each row of a key in a store: its bounds lead to the key's parts (one, but for ids with very many rows),
    a part's index to its shards, and a shard's hash to the rows."""
    disk, folder = filesystem(path)

    def numbers(name: str) -> np.ndarray:
        with disk.open_input_file(f"{folder}/{name}") as f:
            return np.frombuffer(f.read(), "<i8")

    null_parts, *bounds = numbers("bounds.index").tolist()
    low, high = (0, null_parts - 1) if doc_id is None else (null_parts + int(np.searchsorted(bounds, doc_id, side)) for side in ("left", "right"))
    out = []
    for part in range(low, high + 1):
        name = f"part-{part:06d}.index"
        if not disk.get_file_info(f"{folder}/{name}").is_file:  # a part without rows
            continue
        ranges = numbers(name).reshape(-1, 3)  # of each shard: whether it ends with rows without an id, first and last id
        for k in np.flatnonzero(ranges[:, 0] == 1 if doc_id is None else (ranges[:, 1] <= doc_id) & (ranges[:, 2] >= doc_id)).tolist():
            with disk.open_input_file(f"{folder}/shard-{part:06d}-{k:06d}.ids") as f:
                out += OpenShard(f).get(doc_id)
    return out


def encoded(documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", also: Callable[[pd.DataFrame], pd.DataFrame] | None = None, columns: str = "") -> DataFrame:
    """doc_id and ids (bytes, the end id last) of each row, and what also adds to a batch of them (columns: its schema)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(tokenizer)
        end = np.array([END_ID], f"<u{encoder.width}").tobytes()
        for pdf in batches:
            texts, at = pdf["text"].tolist(), 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars < BATCH_CHARS):
                    chars, to = chars + len(texts[to] or ""), to + 1
                rows = pd.DataFrame({"doc_id": pdf["doc_id"].iloc[at:to].astype("Int64"), "ids": [part + end for part in encoder.encode(texts[at:to])]})
                yield also(rows) if also else rows
                at = to

    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInPandas(run, "doc_id long, ids binary" + columns)


def write(documents: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards under path (a URI all executors reach) and returns part, shard, n_docs, n_tokens of each."""

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.array([xxhash.xxh64_intdigest(x) for x in pdf["ids"]], np.uint64)
        return pdf.assign(part=_parts(pdf["doc_id"], h, bounds, null_parts), h=h.view(np.int64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt, width = TaskContext.get().taskAttemptId(), encoder_of(tokenizer).width
        made, ids, parts, size, now, k, ranges = [], [], [], 0, None, 0, []
        disk, folder = filesystem(path)
        disk.create_dir(folder, recursive=True)

        def close() -> None:
            name = f"shard-{now:06d}-{k:06d}.ids"
            own = f"{folder}/_attempt-{attempt}-{name}"
            with disk.open_output_stream(own) as out:
                out.write(pack(ids, parts, width))
            disk.move(own, f"{folder}/{name}")
            made.append((now, name, len(ids), sum(map(len, parts)) // width))
            known = [x for x in ids if x is not None]
            ranges.append((int(len(known) < len(ids)), *((known[0], known[-1]) if known else (1, 0))))

        def index() -> None:
            own = f"{folder}/_attempt-{attempt}-part-{now:06d}.index"
            with disk.open_output_stream(own) as out:
                out.write(np.array(ranges, "<i8").tobytes())
            disk.move(own, f"{folder}/part-{now:06d}.index")
            ranges.clear()

        for pdf in batches:
            for part, key, data in zip(pdf["part"], pdf["doc_id"], pdf["ids"], strict=True):
                if ids and (size >= shard_bytes or part != now):
                    close()
                    if part != now:
                        index()
                    ids, parts, size, k = [], [], 0, k + 1 if part == now else 0
                now = int(part)
                ids.append(None if pd.isna(key) else int(key))
                parts.append(bytes(data))
                size += len(data)
        if ids:
            close()
            index()
        yield pd.DataFrame(made, columns=["part", "shard", "n_docs", "n_tokens"])

    spark = documents.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(doc_id).cast("long")
    probe = documents.agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("known"), F.percentile_approx(key, [i / n_parts for i in range(1, n_parts)] or [1.0]).alias("bounds")).first()
    bounds = np.array(probe.bounds or [], np.int64)
    null_parts = -(-n_parts * (probe.n - probe.known) // max(probe.n, 1))
    disk, folder = filesystem(path)
    disk.create_dir(folder, recursive=True)
    with disk.open_output_stream(f"{folder}/bounds.index") as out:  # one number a part
        out.write(np.concatenate(([null_parts], bounds)).astype("<i8").tobytes())
    dealt = encoded(documents, tokenizer, doc_id, text, deal, ", part int, h long")
    ordered = dealt.repartitionById(null_parts + len(bounds) + 1, "part").sortWithinPartitions("part", "doc_id", "h")
    return ordered.select("part", "doc_id", "ids").mapInPandas(run, "part int, shard string, n_docs long, n_tokens long")


def _parts(doc_ids: pd.Series, h: np.ndarray, bounds: np.ndarray, null_parts: int) -> np.ndarray:
    """The part of each row: null ids by hash over the first null_parts, others by bounds; an id that is several bounds,
    as it has so many rows, spreads over the parts between them by hash. Parts in order hold ascending ids."""
    null = doc_ids.isna().to_numpy()
    x = doc_ids.fillna(0).to_numpy(np.int64)
    low, high = np.searchsorted(bounds, x, "left"), np.searchsorted(bounds, x, "right")
    spread = (h % np.maximum(high - low, 1).astype(np.uint64)).astype(np.int64)
    return np.where(null, (h % np.uint64(max(null_parts, 1))).astype(np.int64), null_parts + low + spread).astype(np.int32)


def read(spark: SparkSession, path: str) -> DataFrame:
    """shard, ordinal, doc_id, n_tokens, ids_crc32, found: each row of the files, and whether the index leads to it.
    Tasks open the files themselves, one at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["path"]:
                disk, file = filesystem(name)
                with disk.open_input_file(file) as f:
                    shard = Shard(f.read())
                ids = [None if null else int(x) for x, null in zip(shard.docs["id"], shard.docs["null"], strict=True)]
                first = shard.find(ids)
                same = lambda i: first[i] >= 0 and ids[first[i]] == ids[i]  # noqa: E731, B023
                yield pd.DataFrame({
                    "shard": name.rsplit("/", 1)[-1], "ordinal": np.arange(len(ids)), "doc_id": pd.array(ids, "Int64"), "n_tokens": shard.docs["n"].astype(np.int64),
                    "ids_crc32": [zlib.crc32(shard.row(i).astype("<u4").tobytes()) for i in range(len(ids))], "found": [bool(same(i)) for i in range(len(ids))],
                })

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.ids").schema("path string, modificationTime timestamp, length long, content binary").load(path).select("path")
    return files.mapInPandas(run, "shard string, ordinal long, doc_id long, n_tokens long, ids_crc32 long, found boolean")


def token_store(documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes and reads back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, found."""
    spark = documents.sparkSession
    path = f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    made = written(write(documents, path, tokenizer, doc_id, text), "token-shards")
    totals = made.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row a task of the writing stage
    if not totals:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, found boolean")
    ends = np.cumsum([r.n for r in totals]).tolist()
    parts = spark.createDataFrame([(r.part, end - r.n) for r, end in zip(totals, ends, strict=True)], "part int, part_start long")
    ahead = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = made.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0))).join(parts, "part").select("shard", (F.col("part_start") + F.col("ahead")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))
    return read(spark, path).join(before, "shard").withColumn("start", F.col("before") + within - F.col("n_tokens")).select("doc_id", "start", "n_tokens", "ids_crc32", "found")
