"""The file operations that the store needs, on any Hadoop file system, with the store's own errors."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import BadDescriptor, CloseFailed, OutOfRange, ReadFailed, StatFailed, StoreError, SyncFailed, WriteFailed


@contextmanager
def _as(kind: type[StoreError], about: str):
    try:
        yield
    except Py4JJavaError as e:
        raise kind(f"{about}: {e.java_exception.toString()}") from e


class Files:
    """Names are relative to the root. The JVM's file system does all work on the driver; data are read and written by Spark."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = self.root.getFileSystem(self.conf)
        self.root = self.fs.makeQualified(self.root)
        self.local = self.fs.getScheme() == "file"
        if self.local and hasattr(self.fs, "getRawFileSystem"):
            self.fs = self.fs.getRawFileSystem()  # it can append, and writes no checksum files beside

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name) if name else self.root

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str) -> list[str]:
        return [n for n, _, _ in self.listing(name)]

    def listing(self, name: str) -> list[tuple[str, int, int]]:
        """(name, bytes, milliseconds of the last change) of what a folder holds, by name; nothing for a missing folder."""
        p = self.path(name)
        if not self.fs.exists(p):
            return []
        with _as(StatFailed, name):
            return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in self.fs.listStatus(p))

    def size(self, name: str) -> int:
        """Bytes of a file, or of a folder with all below."""
        with _as(StatFailed, name):
            return int(self.fs.getContentSummary(self.path(name)).getLength())

    def read(self, name: str) -> bytes:
        with _as(BadDescriptor, name):
            stream = self.fs.open(self.path(name))
        try:
            with _as(ReadFailed, name):
                return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def read_at(self, name: str, offset: int, n: int) -> bytes:
        """The n bytes from an offset on; OutOfRange if the file ends before."""
        with _as(BadDescriptor, name):
            stream = self.fs.open(self.path(name))
        try:
            if offset < 0 or n < 0 or offset + n > self.size(name):
                raise OutOfRange(f"{name} has no bytes {offset} to {offset + n}")
            with _as(ReadFailed, name):
                stream.seek(offset)
                return bytes(stream.readNBytes(n))
        finally:
            stream.close()

    def _write(self, opened, about: str, data: bytes) -> None:
        """Durable when it returns: the bytes are synced before the file is closed."""
        with _as(WriteFailed, about):
            opened.write(bytearray(data))
        with _as(SyncFailed, about):
            opened.hsync()
        with _as(CloseFailed, about):
            opened.close()

    def append(self, name: str, data: bytes) -> int:
        """Adds bytes to a file, which is made if it is missing; returns the offset of the first of them."""
        p = self.path(name)
        with _as(BadDescriptor, name):
            there = self.fs.exists(p)
            at = self.size(name) if there else 0
            out = self.fs.append(p) if there else self.fs.create(p, False)
        self._write(out, name, data)
        return at

    def create(self, name: str, text: str) -> bool:
        """Makes a whole file or nothing; False if it is there already. Of any number of callers one gets True.

        The text goes to a draft first. On a local disk the draft gets the name by a hard link, elsewhere by a rename that does not
        overwrite; both refuse a taken name in one step (on file systems with an atomic rename, as HDFS has).
        """
        draft = f"_drafts/{uuid.uuid4().hex}"
        self.append(draft, text.encode())
        try:
            if self.local:
                plain = lambda n: unquote(urlparse(self.path(n).toUri().toString()).path)
                try:
                    os.link(plain(draft), plain(name))
                except FileExistsError:
                    return False
                return True
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.conf)
            try:
                context.rename(self.path(draft), self.path(name), self._no_overwrite())
            except Py4JJavaError as e:
                if "FileAlreadyExists" in e.java_exception.toString():
                    return False
                raise WriteFailed(f"{name}: {e.java_exception.toString()}") from e
            return True
        finally:
            self.delete(draft)

    def _no_overwrite(self):
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        out = self.gateway.new_array(kind, 1)
        out[0] = kind.NONE
        return out

    def delete(self, name: str) -> None:
        with _as(WriteFailed, name):
            self.fs.delete(self.path(name), True)

    def make(self, name: str) -> None:
        with _as(WriteFailed, name):
            self.fs.mkdirs(self.path(name))

    def rename(self, name: str, to: str) -> None:
        with _as(WriteFailed, name):
            if not self.fs.rename(self.path(name), self.path(to)):
                raise WriteFailed(f"{name} could not be renamed")
