"""A data source that lists a source tree: folders are its partitions, pruned before anything in them is read.

The driver lists only as deep as it takes to have some folders for every task; each task then walks its folders itself,
does not enter skipped ones, opens the files that are wanted, and no others. Local folders are walked by the operating
system, others by pyarrow's file systems. Defined cases: files of no bytes are rows; links to folders are not followed; a
file that is gone before it is read is left out; a folder that is not there raises.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

FOLDERS, SCHEMA = 64, "path string, size long, content binary"


class Folder(InputPartition):
    """A folder below the root, and whether its own folders are walked too."""

    def __init__(self, path: str, deep: bool) -> None:
        self.path, self.deep = path, deep


class SourceTree(DataSource):
    """Options: path; skipped (folder names) and skipped_endings and suffixes (file endings in lower case; none: all), each
    by commas; content (true or false); folders (how many partitions to look for)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options) -> None:
        listed = lambda k: tuple(x for x in options.get(k, "").split(",") if x)
        root = options["path"]
        self.uri = root if re.match(r"\w+:/", root) else f"file://{root}"
        self.skipped, self.endings, self.suffixes = listed("skipped"), listed("skipped_endings"), listed("suffixes")
        self.content, self.folders = options.get("content", "true") == "true", int(options.get("folders", FOLDERS))

    def _open(self) -> tuple[fs.FileSystem, str]:
        disk, root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", self.uri))
        return disk, root.rstrip("/")

    def _inside(self, disk: fs.FileSystem, path: str) -> tuple[list[str], list[fs.FileInfo]]:
        """Folders to enter and files of one folder."""
        folders, files = [], []
        for x in disk.get_file_info(fs.FileSelector(path)):
            if x.type == fs.FileType.Directory:
                folders += [x.path] if x.base_name not in self.skipped else []
            elif x.type == fs.FileType.File:
                files.append(x)
        return folders, files

    def partitions(self) -> list[InputPartition]:
        disk, root = self._open()
        out, front = [], [root]
        while front and len(out) + len(front) < self.folders:
            level = []
            for path in front:
                out.append(Folder(path, deep=False))
                level += self._inside(disk, path)[0]
            front = level
        return [*out, *(Folder(p, deep=True) for p in front)]

    def _wanted(self, name: str) -> bool:
        return not name.endswith(self.endings) and (not self.suffixes or ("." + name.lower().rsplit(".", 1)[-1]) in self.suffixes)

    def read(self, partition: Folder) -> Iterator[tuple]:
        disk, root = self._open()
        front = [partition.path]
        while front:
            folders, files = self._inside(disk, front.pop())
            front += folders if partition.deep else []
            for x in files:
                relative = x.path[len(root) + 1 :]
                if not self._wanted(x.base_name):
                    continue
                data = None
                if self.content:
                    try:
                        with disk.open_input_stream(x.path) as f:
                            data = f.read()
                    except FileNotFoundError:
                        continue
                yield relative, x.size, data


def tree(spark: SparkSession, root: str, skipped: list[str], endings: list[str] = (), suffixes: list[str] = (), content: bool = True, folders: int = FOLDERS):
    """path (relative to root), size and content (null unless asked for) of the wanted files."""
    spark.dataSource.register(SourceTree)
    options = {"skipped": ",".join(skipped), "skipped_endings": ",".join(endings), "suffixes": ",".join(suffixes), "content": str(content).lower(), "folders": str(folders)}
    return spark.read.format("source_tree").options(**options).load(root)
