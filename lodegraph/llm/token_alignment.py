"""Cross-tokenizer alignment: where tokens of two vocabularies end together, and how often each pair of ids does so.

Both tokenizers read a text as bytes; byte offsets where tokens of both end cut it into groups, and the two tokens that
end there are linked. A link's key packs both ids into an int64 (A's in the upper half). Each task sums the keys of its
texts with np.unique; Spark deals these partial counts by ranges of the key, and sorted files of run-length sums
(sorted_counts.py) are mapped and binary-searched when the texts are read a second time. What passes the driver is a row
a file and the highest count of each B id, which the vocabulary bounds.

Texts are read unit by unit where that is exact: a word with the space or line feed before it. A space or line feed that
stands alone always ends a token of either side (a byte-level vocabulary splits there first, and no piece of the other
has a space mark behind a letter, or a line feed), so a unit's tokens, groups and links are its own. Units are kept for
later texts in two generations of at most HELD_BYTES each. A text with other white space or a literal space mark, or one
of whose units does not give its bytes back, is read whole.

Defined cases: texts that are null, empty, or not given back byte for byte by either side have no tokens: zeros and ''.
Special tokens' strings are plain text. Rows repeated count each time and have a row each; null ids stay; very long texts
are read to their end; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm import sorted_counts

HELD_BYTES, UNIT_BYTES, UNIT_CHARS, RUN_UNITS, BLOCK_CHARS = 160 << 20, 400, 200, 4000, 6 << 20
SPACE_MARK = "▁"
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

#: A unit or text: number of A ids, of B ids, link keys as int64 bytes, groups as text if asked for.
Aligned = tuple[int, int, bytes, str | None]
NOTHING: Aligned = (0, 0, b"", "")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are then ordinary text
        self.a.no_truncation()
        self.b = SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for piece, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.mark = self.b.piece_to_id(SPACE_MARK)
        #: Units are exact if no piece goes on behind a space mark that is not its beginning, or over a line feed.
        self.by_unit = not any(SPACE_MARK in p.lstrip(SPACE_MARK) or "\n" in p for p in pieces)
        self.young: dict[str, Aligned] = {}
        self.old: dict[str, Aligned] = {}
        self.with_groups = False

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides of a text that begins with a space, or with a line feed that a space mark is taken from."""
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = self.b.encode(text[1:] if text[0] == " " else text)
        b = b if text[0] == " " else b[1:] if b[:1] == [self.mark] else []
        return np.array(a, np.int64), np.array(b, np.int64)

    def _run(self, units: list[str]) -> list[Aligned] | None:
        """The alignment of units that are read end to end as one text; None if their bytes do not come back."""
        raw = [u.encode("utf-8", "surrogatepass") for u in units]
        whole = b"".join(raw)
        x, y = self._ids(whole.decode("utf-8", "surrogatepass"))
        if b"".join(map(self.a_bytes.__getitem__, x.tolist())) != whole or b"".join(map(self.b_bytes.__getitem__, y.tolist())) != whole:
            return None
        ends = np.cumsum([len(r) for r in raw])
        a_ends, b_ends = np.cumsum(self.a_size[x]), np.cumsum(self.b_size[y])
        both, i, j = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        last = np.searchsorted(both, ends)  # each unit's last link
        if len(units) > 1 and not np.array_equal(both[np.minimum(last, len(both) - 1)], ends):
            return None  # units that do not end tokens of both sides are not units
        keys = (x[i] << 32 | y[j]).astype("<i8").tobytes()
        n_a, n_b = np.diff(i[last] + 1, prepend=0).tolist(), np.diff(j[last] + 1, prepend=0).tolist()
        cuts = [0, *(last + 1).tolist()]
        groups = [None] * len(units)
        if self.with_groups:
            left, right, p, q, each = list(map(str, x.tolist())), list(map(str, y.tolist())), 0, 0, []
            for s, t in zip((i + 1).tolist(), (j + 1).tolist(), strict=True):
                each.append(f"{left[p] if s == p + 1 else ','.join(left[p:s])}|{right[q] if t == q + 1 else ','.join(right[q:t])}")
                p, q = s, t
            groups = [";".join(each[f:t]) for f, t in zip(cuts, cuts[1:], strict=False)]
        return [(n, m, keys[8 * f : 8 * t], g) for n, m, f, t, g in zip(n_a, n_b, cuts, cuts[1:], groups, strict=False)]

    def align(self, text: str) -> Aligned:
        """A whole text behind a space; nothing if its bytes do not come back."""
        found = self._run([" " + text])
        return found[0] if found else NOTHING

    def units(self, text: str) -> list[str] | None:
        """The words of a text, those that begin a line but the first with their line feed; None if it is to be read whole."""
        words = text.replace("\n", " \n").split(" ")
        if not self.by_unit or SPACE_MARK in text or text.split() != text.replace("\n", " ").split(" "):
            return None
        return words

    def known(self, wanted: list[str]) -> list[Aligned | None]:
        """The alignment of each unit, from the kept ones as far as they go; None if its bytes do not come back."""
        young, old = self.young, self.old
        out = list(map(young.get, wanted))
        new = []
        for k, x in enumerate(out):
            if x is None:
                u = wanted[k]
                if (x := old.get(u)) is None:
                    new.append(k)
                else:
                    out[k] = young[u] = x
        for at in range(0, len(new), RUN_UNITS):
            part = new[at : at + RUN_UNITS]
            texts = [u if u[0] == "\n" else " " + u for u in map(wanted.__getitem__, part)]
            done = self._run(texts)
            if done is None:
                done = [(self._run([t]) or [None])[0] for t in texts]
            for k, x in zip(part, done, strict=True):
                out[k] = x
                if x is not None and len(wanted[k]) <= UNIT_CHARS:
                    young[wanted[k]] = x
            if len(young) * UNIT_BYTES > HELD_BYTES:
                self.old, self.young = young, {}
                young, old = self.young, self.old
        return out

    def blocks(self, batches: Iterator[pd.DataFrame], with_groups: bool) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, list[Aligned]]]:
        """Rows of about BLOCK_CHARS letters; how many units each has; the number of each unit, end to end; the alignment of
        each number. A row that is read whole is one unit of its own, and has none if its bytes do not come back."""
        if self.with_groups != with_groups:
            self.young, self.old, self.with_groups = {}, {}, with_groups
        for pdf in batches:
            texts, at = pdf["text"].tolist(), 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars < BLOCK_CHARS):
                    chars, to = chars + len(texts[to] or ""), to + 1
                rows = [self.units(t) if t else [] for t in texts[at:to]]
                size = np.array([len(units or ()) for units in rows], np.int64)
                numbers, distinct = pd.factorize(np.array(list(chain.from_iterable(filter(None, rows))), object))
                held = self.known(distinct.tolist())
                whole = np.array([units is None for units in rows])
                bad = np.array([x is None for x in held], bool)
                if bad.any():
                    whole |= np.bincount(np.repeat(np.arange(len(rows)), size), bad[numbers], len(rows)) > 0
                if whole.any():
                    own = np.flatnonzero(whole)
                    done = [self.align(texts[at + k]) for k in own.tolist()]
                    stay, place = np.repeat(~whole, size), np.where(whole, 0, size)
                    place[own] = [x[0] > 0 for x in done]
                    into = np.zeros(int(place.sum()), np.int64)
                    mine = np.repeat(whole, place)
                    into[~mine] = numbers[stay]
                    into[mine] = len(held) + np.flatnonzero([x[0] > 0 for x in done])
                    held, numbers, size = [x or NOTHING for x in held] + done, into, place
                yield pdf.iloc[at:to], size, numbers, held
                at = to


@lru_cache(2)
def aligner_of(a_path: str, b_path: str) -> Aligner:
    """One a Python worker, so that later tasks find its units."""
    return Aligner(a_path, b_path)


def _keys(aligned: list[Aligned]) -> tuple[np.ndarray, np.ndarray]:
    """The link keys of units end to end, and how many each has."""
    return np.frombuffer(b"".join([x[2] for x in aligned]), "<i8"), np.array([len(x[2]) // 8 for x in aligned], np.int64)


def links(texts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """key, n: partial counts of link keys, summed within each task as far as a block goes; texts: a column text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for _, _, numbers, aligned in aligner_of(a_path, b_path).blocks(batches, False):
            if not len(numbers):
                continue
            keys, n = _keys(aligned)
            distinct, at = np.unique(keys, return_inverse=True)
            times = np.zeros(len(distinct), np.int64)
            np.add.at(times, at, np.repeat(np.bincount(numbers, minlength=len(aligned)), n))
            held.append((distinct[times > 0], times[times > 0]))
            if len(held) > 8:
                held = [_merged(held)]
        if held:
            keys, n = _merged(held)
            yield pd.DataFrame({"key": keys, "n": n})

    return texts.select("text").mapInPandas(run, "key long, n long")


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    return sorted_counts.summed(keys[order], n[order])


def highest(counts: sorted_counts.Counts, spark, size: int) -> np.ndarray:
    """The highest count of each B id; size: how many ids B has, which bounds what the driver gets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, rows in zip(pdf["file"], pdf["rows"], strict=True):
                keys, n = counts._file(name, int(rows))
                b, order = keys & 0xFFFFFFFF, np.argsort(keys & 0xFFFFFFFF, kind="stable")
                at = np.flatnonzero(np.diff(b[order], prepend=-1))
                yield pd.DataFrame({"b": b[order][at].astype(np.int64), "n": np.maximum.reduceat(n[order], at)})

    out = np.zeros(size, np.int64)
    if counts.files:
        files = spark.createDataFrame([(f, rows) for f, rows, _, _ in counts.files], "file string, rows long").repartition(len(counts.files))
        for r in files.mapInPandas(run, "b int, n long").groupBy("b").agg(F.max("n").alias("n")).collect():
            out[r.b] = r.n
    return out


def counted(documents: DataFrame, a_path: str, b_path: str, text: str = "text") -> sorted_counts.Counts:
    """The corpus-wide count of each linked id pair, as sorted files in the shared folder."""
    return sorted_counts.write(links(documents.select(F.col(text).alias("text")), a_path, b_path), "alignment")


def token_alignment(documents: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", groups: bool = False) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is counted as often as any of its B id),
    count_sum (the counts of its links) and groups_sha256; groups adds the groups themselves, a1,a2|b1;a3|b2,b3."""
    from sentencepiece import SentencePieceProcessor

    counts = counted(documents, a_path, b_path, text)
    best = highest(counts, documents.sparkSession, SentencePieceProcessor(model_file=b_path).get_piece_size())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, *block in aligner_of(a_path, b_path).blocks(batches, True):
            yield _rows(pdf["doc_id"], *block, counts, best, groups)

    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInPandas(run, DIGEST + (", groups string" if groups else ""))


def _rows(ids: pd.Series, size: np.ndarray, numbers: np.ndarray, aligned: list[Aligned], counts: Callable[[np.ndarray], np.ndarray], best: np.ndarray, groups: bool) -> pd.DataFrame:
    keys, n = _keys(aligned)
    distinct, at = np.unique(keys, return_inverse=True)
    count = counts(distinct)
    top = count == best[distinct & 0xFFFFFFFF]
    ends = np.concatenate(([0], np.cumsum(n)))
    per = lambda w: np.diff(np.concatenate(([0], np.cumsum(w)))[ends])
    table = [np.array([x[0] for x in aligned], np.int64), np.array([x[1] for x in aligned], np.int64), n, n, per(top[at].astype(np.int64)), per(count[at])]
    to = np.cumsum(size)
    total = lambda w: np.diff(np.concatenate(([0], np.cumsum(w[numbers])))[np.concatenate(([0], to))])
    columns = {c: total(w) for c, w in zip(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), table, strict=True)}
    strings = [x[3] for x in aligned]
    parts = list(map(strings.__getitem__, numbers.tolist()))
    texts = [";".join(parts[f:t]) for f, t in zip((to - size).tolist(), to.tolist(), strict=True)]
    digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
    return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), **columns, "groups_sha256": digests, **({"groups": texts} if groups else {})})
