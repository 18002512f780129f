"""The workbook tree as a data source whose tasks walk the folders.

A folder that cannot be listed is a row with its error and ends nothing else; a rule folder
without workbooks is a row too. The driver lists the two highest levels only, and each folder
of the second level is a partition, so that a source that holds most files is walked by many
tasks.
"""

from __future__ import annotations

import datetime
import re
import time
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quillmap.schemas import FOLDER, LISTING
from quillmap.sources.workbooks import RULE_FOLDER

#: kind is `folder` or `file`; time and length are a file's, status and error a folder's.
TREE = f"kind string, {LISTING}, status string, error string"
#: Folders of this level are partitions; those below LEVELS hold the rule folders.
SPLIT = 2
LEVELS = len(FOLDER)


@dataclass(frozen=True)
class Place:
    """A folder: its path without the scheme, as the file system takes it, and its level."""

    path: str
    level: int


@dataclass
class TreePart(InputPartition):
    place: Place


class Tree:
    """The folders below a root, listed one at a time."""

    def __init__(self, root: str):
        scheme, _, rest = root.partition(":")
        if scheme == "file" or "/" in scheme:
            self.system, path, self.prefix = fs.LocalFileSystem(), re.sub("^/+", "/", rest or root), "file:"
        else:
            self.system, path = fs.FileSystem.from_uri(urllib.parse.quote(root, safe="/:@"))
            self.prefix = root.rstrip("/").removesuffix(path.rstrip("/"))
        self.root = Place(path.rstrip("/") or "/", 0)

    def children(self, place: Place) -> list[fs.FileInfo]:
        return sorted(self.system.get_file_info(fs.FileSelector(place.path)), key=lambda i: i.path)

    def folders(self, place: Place) -> list[Place]:
        return [Place(i.path, place.level + 1) for i in self.children(place) if i.type == fs.FileType.Directory]

    def parts(self) -> list[Place]:
        """The places that tasks start from; one above SPLIT if its folders cannot be listed."""
        places = self.folders(self.root)  # a root that is missing is an error
        for _ in range(SPLIT - 1):
            below = []
            for place in places:
                try:
                    below += self.folders(place)
                except OSError:
                    below.append(place)  # its task reports it
            places = below
        return places

    def rows(self, place: Place) -> Iterator[tuple]:
        """(kind, path, modificationTime, length, status, error) of rule folders, their files and of failures."""
        try:
            if place.level > LEVELS:
                files = [i for i in self.children(place) if i.type == fs.FileType.File]
            else:
                below = self.folders(place)
        except OSError as e:
            yield ("folder", self.prefix + place.path, None, None, "error", f"{type(e).__name__}: {e}")
            return
        if place.level > LEVELS:
            yield ("folder", self.prefix + place.path, None, None, "ok", None)
            for i in files:
                when = datetime.datetime.fromtimestamp(i.mtime_ns / 1e9, datetime.timezone.utc)
                yield ("file", self.prefix + i.path, when, i.size, None, None)
            return
        for folder in below:
            if place.level < LEVELS or folder.path.endswith(f"/{RULE_FOLDER}"):
                yield from self.rows(folder)


class TreeReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[TreePart]:
        return [TreePart(p) for p in Tree(self.root).parts()]

    def read(self, partition: TreePart) -> Iterator[tuple]:
        if partition is not None:  # a root without folders has one empty partition
            yield from Tree(self.root).rows(partition.place)


class TreeStreamReader(DataSourceStreamReader):
    """The whole tree, listed anew in every batch; see `changed_files`."""

    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {"listed": 0}

    def latestOffset(self) -> dict:
        return {"listed": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[TreePart]:
        return [TreePart(p) for p in Tree(self.root).parts()]

    def read(self, partition: TreePart) -> Iterator[tuple]:
        yield from Tree(self.root).rows(partition.place)


class RuleTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rule_tree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"])

    def streamReader(self, schema) -> TreeStreamReader:
        return TreeStreamReader(self.options["path"])


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Rule folders and their files below `root`, and the folders that cannot be listed.

    A missing root is an error, a root without folders an empty table.
    """
    spark.dataSource.register(RuleTree)
    return spark.read.format("rule_tree").load(root)


def tree_stream(spark: SparkSession, root: str) -> DataFrame:
    """The same rows, of the whole tree in every batch."""
    spark.dataSource.register(RuleTree)
    return spark.readStream.format("rule_tree").load(root)


def tree_files(tree: DataFrame) -> DataFrame:
    """The files, in the layout of a listing."""
    return tree.where("kind = 'file'").select("path", "modificationTime", "length")


def folder_statuses(tree: DataFrame) -> DataFrame:
    """One row per rule folder: its level names, path, status, error and number of files.

    A folder above that cannot be listed has a row with the level names as far as they go.
    """
    folders = tree.where("kind = 'folder'").select(F.col("path").alias("folder_path"), "status", "error")
    files = tree_files(tree).groupBy(F.regexp_replace("path", r"/[^/]*$", "").alias("folder_path")).agg(F.count("*").alias("files"))
    return folders.join(files, "folder_path", "left").fillna(0, ["files"])


def with_levels(folders: DataFrame, root: str) -> DataFrame:
    """Add the level names, which follow the root in the path; null where it ends before."""
    depth = len([p for p in Tree(root).root.path.split("/") if p])
    parts = F.array_remove(F.split(F.regexp_replace("folder_path", "^[^:/]+:(//[^/]*)?", ""), "/"), "")
    return folders.select(*(F.get(parts, F.lit(depth + i)).alias(name) for i, name in enumerate(FOLDER)), *folders.columns)
