"""Source trees as tables: scan with pruning, extraction by suffix, caps, repository URLs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.schemas import FILE_EXTRACT
from lodegraph.sources.extract_js import extract_js
from lodegraph.sources.extract_markdown import extract_markdown
from lodegraph.sources.extract_python import extract_python
from lodegraph.sources.tree import tree

# Folders and endings that are never indexed, caps, hosts, and what a remote says of a private repository.
SKIPPED_FOLDERS = [".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".mypy_cache", ".pytest_cache", ".ruff_cache", "site-packages", ".next", ".turbo", "coverage", "vendor"]
SKIPPED_ENDINGS = [".min.js", ".min.mjs", ".bundle.js"]
MAX_FILES, MAX_BYTES = 5000, 500_000_000
HOSTS = ["github.com"]
PRIVATE_SIGNS = ["authentication failed", "could not read username", "terminal prompts disabled", "repository not found", "fatal: could not read", "403", "404"]

Extractor = Callable[[str, bytes], dict]
EXTRACTORS: dict[str, Extractor] = {".py": extract_python, ".js": extract_js, ".jsx": extract_js, ".mjs": extract_js, ".cjs": extract_js, ".ts": extract_js, ".tsx": extract_js, ".md": extract_markdown}


def register_extractor(suffix: str, extractor: Extractor) -> None:
    EXTRACTORS[suffix] = extractor


def wanted(path: Column, suffixes: list[str] | None = None) -> Column:
    """Whether a relative path is indexed."""
    parts = F.split(path, "/")
    ok = ~F.arrays_overlap(parts, F.array(*[F.lit(s) for s in SKIPPED_FOLDERS]))
    for ending in SKIPPED_ENDINGS:
        ok = ok & ~path.endswith(ending)
    suffix = F.concat(F.lit("."), F.substring_index(F.lower(path), ".", -1))
    return ok & suffix.isin(suffixes or list(EXTRACTORS))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), content, size of each wanted file under root; skipped folders are not entered, other files not opened."""
    return tree(spark, root, SKIPPED_FOLDERS, SKIPPED_ENDINGS, list(EXTRACTORS)).select("path", "content", "size")


def capped(files: DataFrame, keys: list[str], max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """keys, n_files, n_bytes, fits: whether each workspace keeps to the caps. files: keys and length."""
    sizes = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("n_bytes"))
    return sizes.withColumn("fits", (F.col("n_files") <= max_files) & (F.col("n_bytes") <= max_bytes))


def measure(spark: SparkSession, root: str, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """n_files, n_bytes, fits: of all files but those of .git."""
    return capped(tree(spark, root, [".git"], content=False).withColumnRenamed("size", "length"), [], max_files, max_bytes)


def extract(files: DataFrame) -> DataFrame:
    """One row a file, by the extractor of its suffix; a file that does not parse still yields its own symbol."""
    known = dict(EXTRACTORS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows.append(known["." + path.rsplit(".", 1)[-1].lower()](path, bytes(content)))
            yield pd.DataFrame(rows, columns=["path", "language", "symbols", "imports", "calls", "had_errors"])

    return files.select("path", "content").mapInPandas(run, FILE_EXTRACT)


def allowed_url(url: Column, hosts: list[str] = HOSTS) -> Column:
    """http(s) with a known host."""
    return F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1)).isin("http", "https") & F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^@/]*@)?([^/:?#]+)", 1)).isin(hosts)


def clone_error(stderr: Column) -> Column:
    """private if the remote asks for rights, else generic."""
    found = [F.lower(stderr).contains(sign) for sign in PRIVATE_SIGNS]
    return F.when(F.greatest(*found), "private").otherwise("generic")
