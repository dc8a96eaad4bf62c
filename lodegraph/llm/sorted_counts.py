"""Sorted counts by 64-bit key in files of the shared folder, which tasks look up by binary search.

write() deals (key, n) rows by ranges of the key, sorts each range, sums runs of equal keys, and writes one file a range:
keys, then counts, as little-endian int64. Its manifest (file, rows, first and last key) is the only thing that passes
the driver, one row a file. Counts maps a local file and reads another into a cache of bounded size; a file that is
missing or short raises, so a lost file never reads as zeros. A task may run again: files are written under an attempt's
own name and renamed.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import filesystem, shared_dir, written

HELD_BYTES, PART_ROWS = 128 << 20, 1 << 22


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run-length sums of counts over ascending keys."""
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts[:0]


class Counts:
    """Counts by key; zero for keys that no file holds."""

    opened: OrderedDict[str, np.ndarray] = OrderedDict()

    def __init__(self, manifest: list[tuple[str, int, int, int]]) -> None:
        self.files = sorted((m for m in manifest if m[1]), key=lambda m: m[2])
        self.last = np.array([m[3] for m in self.files], np.int64)

    def _file(self, name: str, rows: int) -> np.ndarray:
        if name in self.opened:
            self.opened.move_to_end(name)
            return self.opened[name]
        disk, path = filesystem(name)
        held = disk.get_file_info(path).size
        if held != 16 * rows:
            raise OSError(f"{name} should hold {16 * rows} bytes and has {held}")
        if disk.type_name == "local":
            data = np.memmap(path, "<i8", "r", shape=(2, rows))
        else:
            with disk.open_input_file(path) as f:
                data = np.frombuffer(f.read(), "<i8").reshape(2, rows)
        self.opened[name] = data
        while len(self.opened) > 1 and sum(x.nbytes for x in self.opened.values() if not isinstance(x, np.memmap)) > HELD_BYTES:
            self.opened.popitem(last=False)
        return data

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        if not self.files or not len(keys):
            return out
        order = np.argsort(keys)
        of = np.searchsorted(self.last, keys[order])
        for f in np.unique(of[of < len(self.files)]).tolist():
            name, rows, _, _ = self.files[f]
            held, mine = self._file(name, rows), order[np.searchsorted(of, f) : np.searchsorted(of, f, "right")]
            at = np.searchsorted(held[0], keys[mine])
            out[mine] = np.where(held[0][at] == keys[mine], held[1][at], 0)
        return out


def write(counts: DataFrame, what: str) -> Counts:
    """counts: key long, n long, in any number of rows a key."""
    counts = written(counts.select("key", "n"), f"{what}-partial")
    spark = counts.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), counts.count() // PART_ROWS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(p["key"].to_numpy(np.int64), p["n"].to_numpy(np.int64)) for p in batches]
        if not held:
            return
        keys, n = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        if not len(keys):
            return
        disk, folder = filesystem(path)
        disk.create_dir(folder, recursive=True)
        own = uuid.uuid4().hex
        with disk.open_output_stream(f"{folder}/_attempt-{own}") as out:
            out.write(np.stack([keys, n]).astype("<i8").tobytes())
        disk.move(f"{folder}/_attempt-{own}", f"{folder}/{own}.counts")
        yield pd.DataFrame({"file": [f"{path}/{own}.counts"], "rows": [len(keys)], "first": [int(keys[0])], "last": [int(keys[-1])]})

    made = counts.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInPandas(run, "file string, rows long, first long, last long")
    return Counts([tuple(r) for r in made.collect()])
