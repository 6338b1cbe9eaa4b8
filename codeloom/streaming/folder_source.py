"""A streaming data source of the changes of a folder: files that are new, changed or gone, by comparing listings.

Offsets name listings, which are kept as files in a state folder that driver and executors share; so an offset stays
small however many files there are, and a batch that is run again compares the same two listings. Folders are read
through pyarrow's file systems (local and mounted paths, hdfs, s3, gcs).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Rows of a partition, at most.
PARTITION_ROWS = 10_000
#: Listings that are kept; a restarted query asks for the last two.
KEPT = 4
#: Folders that are never listed.
IGNORED = ("node_modules", ".git", "__pycache__", "dist", "build", "target", ".venv", ".idea", ".vscode")


class Rows(InputPartition):
    def __init__(self, rows: list[tuple]) -> None:
        super().__init__(0)
        self.rows = rows


def differences(before: dict[str, list[int]], after: dict[str, list[int]]) -> list[tuple[str, str, int | None, int | None]]:
    """(path, type, modified, size) of create, change and delete, by path; a file that is renamed is deleted and created."""
    out = []
    for path in sorted(before.keys() | after.keys()):
        if path not in after:
            out.append((path, "delete", None, None))
        elif before.get(path) != after[path]:
            out.append((path, "change" if path in before else "create", *after[path]))
    return out


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.state = options["path"], options["state"]
        self.endings = tuple(e for e in options.get("extensions", "").split(",") if e)
        self.most = int(options.get("maxsize", options.get("maxSize", 1 << 40)))
        self.ignored = set(options["ignored"].split(",")) if "ignored" in options else set(IGNORED)

    def _files(self, place: str) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(place) if "://" in place else (pafs.LocalFileSystem(), place)

    def listing(self) -> dict[str, list[int]]:
        """path -> [modified (ms), size] of the files that are watched: of the endings (all, if none is given), not too large, in no ignored folder."""
        fs, root = self._files(self.root)
        out, folders = {}, [root]
        while folders:
            for f in fs.get_file_info(pafs.FileSelector(folders.pop(), allow_not_found=True)):
                if f.type == pafs.FileType.Directory and f.base_name not in self.ignored:
                    folders.append(f.path)
                elif f.type == pafs.FileType.File and f.size <= self.most and (not self.endings or f.path.endswith(self.endings)):
                    out[f.path] = [int(f.mtime_ns // 1_000_000), f.size]
        return out

    def _kept(self, name: str) -> dict[str, list[int]]:
        if not name:
            return {}
        fs, state = self._files(self.state)
        with fs.open_input_stream(f"{state}/{name}") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"listing": ""}

    def latestOffset(self) -> dict:
        files = json.dumps(self.listing(), sort_keys=True).encode()
        name = hashlib.sha256(files).hexdigest() + ".json"
        fs, state = self._files(self.state)
        fs.create_dir(state, recursive=True)
        with fs.open_output_stream(f"{state}/{name}") as f:  # written again if it is there, so that it counts as recent
            f.write(files)
        return {"listing": name}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        rows = differences(self._kept(start["listing"]), self._kept(end["listing"]))
        return [Rows(rows[i : i + PARTITION_ROWS]) for i in range(0, len(rows), PARTITION_ROWS)] or [Rows([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        fs, state = self._files(self.state)
        old = sorted(fs.get_file_info(pafs.FileSelector(state)), key=lambda f: f.mtime_ns or 0)[:-KEPT]
        for f in old:
            if f.base_name != end["listing"]:
                fs.delete_file(f.path)


class FolderChanges(DataSource):
    """Format ``folder_changes``: options path, state, extensions (comma-separated), maxSize, ignored (comma-separated folder names)."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return "path string, type string, modified long, size long"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FolderReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``spark.readStream.format("folder_changes")`` known."""
    spark.dataSource.register(FolderChanges)
