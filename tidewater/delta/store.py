"""Files of a table through Hadoop's file systems, so that any store Spark reads will do."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    path: str  # relative to the table, as the file system names it
    size: int
    modified_ms: int


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        at = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.root_path = self.fs.makeQualified(at)
        self.root = self.root_path.toString().rstrip("/")
        self.local = self.root_path.toUri().getPath() if self.root.startswith("file:") else None

    def _path(self, relative: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{relative}" if relative else self.root)

    def url(self, relative: str) -> str:
        """The full name of a file."""
        return f"{self.root}/{relative}"

    def exists(self, relative: str) -> bool:
        return self.fs.exists(self._path(relative))

    def list(self, relative: str) -> list[Entry]:
        """Files directly in a folder; none if it does not exist."""
        if self.local is not None:
            try:
                with os.scandir(os.path.join(self.local, relative)) as it:
                    return [Entry(f"{relative}/{e.name}", (s := e.stat()).st_size, s.st_mtime_ns // 1_000_000) for e in it if e.is_file()]
            except FileNotFoundError:
                return []
        if not self.exists(relative):
            return []
        return [Entry(f"{relative}/{s.getPath().getName()}", s.getLen(), s.getModificationTime()) for s in self.fs.listStatus(self._path(relative)) if s.isFile()]

    def walk(self, relative: str = "") -> list[Entry]:
        """All files below a folder."""
        out, cut = [], len(self.root) + 1
        if not self.exists(relative):
            return out
        it = self.fs.listFiles(self._path(relative), True)
        while it.hasNext():
            s = it.next()
            out.append(Entry(s.getPath().toString()[cut:], s.getLen(), s.getModificationTime()))
        return out

    def read(self, relative: str) -> bytes:
        if self.local is not None:
            with open(os.path.join(self.local, relative), "rb") as f:
                return f.read()
        stream = self.fs.open(self._path(relative))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def put_if_absent(self, relative: str, data: bytes) -> bool:
        """Creates the file whole, or returns False if there is one."""
        if self.local is not None:
            to = os.path.join(self.local, relative)
            os.makedirs(os.path.dirname(to), exist_ok=True)
            draft = f"{to}.{uuid.uuid4().hex}.tmp"
            with open(draft, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(draft, to)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
        # a draft renamed: readers see the whole file or none. Where renaming onto a file is refused (HDFS and the like) one
        # writer wins; a store that would replace it needs a commit service of its own.
        draft, to = self._path(f"{relative}.{uuid.uuid4().hex}.tmp"), self._path(relative)
        out = self.fs.create(draft, False)
        out.write(bytearray(data))
        out.close()
        try:
            return not self.fs.exists(to) and bool(self.fs.rename(draft, to))
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            if self.fs.exists(draft):
                self.fs.delete(draft, False)

    def replace(self, relative: str, data: bytes) -> None:
        """Writes a file, in the place of one that is there."""
        out = self.fs.create(self._path(relative), True)
        out.write(bytearray(data))
        out.close()

    def delete(self, relative: str) -> None:
        self.fs.delete(self._path(relative), False)

    def touch(self, relative: str, modified_ms: int) -> None:
        """Sets a modification time."""
        self.fs.setTimes(self._path(relative), modified_ms, -1)


def in_log(path: str) -> str:
    """A relative path as log actions spell it (percent-encoded)."""
    return quote(path, safe="/=-_.!~*'(),@:$&+;")


def on_disk(logged: str) -> str:
    return unquote(logged)
