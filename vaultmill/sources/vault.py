"""Scan of a folder of Markdown files.

Spark's readers of files list all of them on the driver and keep what they found there, so its memory grows with the
vault. Folders of a file system that tasks can open themselves are therefore listed and read by tasks, and no file's
name comes to the driver. Other file systems are left to Spark's reader.
"""

from __future__ import annotations

import errno
import os
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])
LISTED = "uri string, path string, modified long, size long"
CONTENT = "uri string, content binary"
BATCH = 1000  # hidden files that are listed or read as one set
TASKS = 8  # tasks for each core that read files, at most
PAGE, BYTES = 10_000, 1 << 24  # names or files, and bytes of them, that a task holds at a time, but for one larger file
ON_DISK = "uri binary, path string, modified long, size long"  # names of files are bytes there


def root_of(spark: SparkSession, folder: str) -> str:
    """The folder's path without scheme and host."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/")


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def on_disk(spark: SparkSession, folder: str) -> str | None:
    """The folder's full path, if it is in a file system that tasks open by themselves."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    scheme = path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
    return root_of(spark, folder) or "/" if scheme == "file" else None


def paged(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size."""
    held: list[tuple] = []
    total = 0

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    for r in rows:
        size = sum(len(x) for x in r if isinstance(x, bytes))
        if held and (len(held) == PAGE or total + size > BYTES):
            yield batch()
            held, total = [], 0
        held.append(r)
        total += size
    if held:
        yield batch()


def entries(folder: bytes) -> Iterator[tuple[os.DirEntry, bool]]:
    """What is in a folder, and whether it is a folder itself. Nothing if it is gone."""
    try:
        with os.scandir(folder) as found:
            for e in found:
                try:
                    yield e, e.is_dir()
                except OSError as error:  # a link that leads to itself
                    if error.errno != errno.ELOOP:
                        raise
    except (FileNotFoundError, NotADirectoryError):
        return


def folders(spark: SparkSession, root: str) -> DataFrame:
    """(uri) of a folder and all below it, found level by level; each level is listed by tasks and stays with them."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from paged(((e.path,) for b in batches for at in b.column(0).to_pylist() for e, is_folder in entries(at) if is_folder), ["uri"], [pa.binary()])

    out = level = spark.createDataFrame([(bytearray(root.encode()),)], "uri binary")
    while True:
        level = level.repartition(spark.sparkContext.defaultParallelism, "uri").mapInArrow(inner, "uri binary").localCheckpoint(storageLevel=StorageLevel.MEMORY_AND_DISK_2)
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def named_by_tasks(spark: SparkSession, root: str, versions: bool = True) -> DataFrame:
    """(uri, path, modified, size) of every *.md below a folder. Without versions the last two are null and no file is asked for."""
    start = len(root.rstrip("/").encode()) + 1

    def rows(folder: bytes) -> Iterator[tuple]:
        for e, is_folder in entries(folder):
            if is_folder or not e.name.endswith(b".md") or not e.is_file():
                continue
            path, modified, size = e.path[start:].decode("utf-8", "replace"), None, None
            if versions:
                try:
                    s = e.stat()
                except FileNotFoundError:
                    continue
                modified, size = s.st_mtime_ns // 1_000_000, s.st_size
            yield e.path, path, modified, size

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from paged((r for b in batches for at in b.column(0).to_pylist() for r in rows(at)), ["uri", "path", "modified", "size"], [pa.binary(), pa.string(), pa.int64(), pa.int64()])

    return folders(spark, root).repartition(spark.sparkContext.defaultParallelism, "uri").mapInArrow(found, ON_DISK)


def read_by_tasks(named: DataFrame) -> DataFrame:
    """(path, modified, size, content) of files named by ``named_by_tasks``. One that is gone since is left out."""

    def rows(b: pa.RecordBatch) -> Iterator[tuple]:
        for at, *rest in zip(*(c.to_pylist() for c in b.columns)):
            try:
                with open(at, "rb") as f:
                    yield *rest, f.read()
            except FileNotFoundError:
                continue

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from paged((r for b in batches for r in rows(b)), ["path", "modified", "size", "content"], [pa.string(), pa.int64(), pa.int64(), pa.binary()])

    spread = named.select("uri", "path", "modified", "size").repartition(TASKS * named.sparkSession.sparkContext.defaultParallelism, "uri")
    return spread.mapInArrow(read, "path string, modified long, size long, content binary")


def unlike(suffix: str) -> str:
    """A pattern of the names that are hidden or do not have the suffix."""
    ends = [suffix[k:] for k in range(1, len(suffix))]
    return f"{{{','.join(['[._]*', *(f'*[^{c}]{suffix[k + 1 :]}' for k, c in enumerate(suffix)), *ends])}}}"


def below(fs, at) -> Iterator:
    """All files below a folder."""
    for f in fs.listStatus(at):
        if f.isDirectory():
            yield from below(fs, f.getPath())
        else:
            yield f


def hidden_files(spark: SparkSession, folder: str, suffix: str = ".md") -> Iterator[tuple[str, str, int, int]]:
    """(uri, path, modified, size) of files that Spark's reader skips, as some name below the folder begins with
    "." or "_". Folders are walked one by one, and the file system itself passes over the names of plain notes, so what
    the driver does grows with folders and other files, not with notes. Nothing is kept."""
    hadoop, root = spark._jvm.org.apache.hadoop.fs, root_of(spark, folder)
    top = hadoop.Path(folder)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    apart, left = hadoop.GlobFilter(unlike(suffix)), [fs.makeQualified(top)]
    while left:
        at = left.pop()
        inner = {f.getPath().getParent().toString() for f in fs.globStatus(hadoop.Path(literal(at.toString()) + f"/*{suffix}/*"))}  # folders that are named like notes
        left += [p for p in map(hadoop.Path, inner) if p.getName()[:1] not in "._"]
        for f in fs.listStatus(at, apart):
            path = f.getPath()
            if path.getName()[:1] not in "._":
                left += [path] if f.isDirectory() else []
                continue
            for h in below(fs, path) if f.isDirectory() else [f]:
                if h.getPath().getName().endswith(suffix):
                    yield h.getPath().toString(), h.getPath().toUri().getPath()[len(root) + 1 :], h.getModificationTime(), h.getLen()


def sets(rows: Iterator) -> Iterator[list]:
    return iter(lambda: list(islice(rows, BATCH)), [])


def relative(uri: str, root: str) -> Column:
    """The path below the root of a file's full path."""
    plain = F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.substring(plain, F.lit(len(root) + 2), F.length(plain))


def binary(spark: SparkSession, paths: str | list[str], since: int | None = None, until: int | None = None) -> DataFrame:
    """Spark's reader of whole files, with modified (milliseconds) and size. What is not selected, or was changed
    before ``since`` or after ``until``, is not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").option("ignoreMissingFiles", True).load(paths)
    if since is not None:
        raw = raw.where(F.col("modificationTime") >= F.timestamp_millis(F.lit(since)))
    if until is not None:
        raw = raw.where(F.col("modificationTime") < F.timestamp_millis(F.lit(until + 1)))
    raw = raw.coalesce(TASKS * spark.sparkContext.defaultParallelism)  # else one task for each few dozen files
    return raw.select(F.col("path").alias("uri"), F.unix_millis("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def read_hidden(spark: SparkSession, uris: list[str]) -> DataFrame:
    """(uri, content) of files that Spark's reader would skip, a bounded number of them.

    Files in hidden folders are read by tasks. No reader takes a file whose own name is hidden, so the driver
    reads these.
    """
    own = [u for u in uris if u.rsplit("/", 1)[-1][:1] in "._"]
    inside = [literal(u) for u in uris if u.rsplit("/", 1)[-1][:1] not in "._"]
    rows = []
    for u in own:
        path = spark._jvm.org.apache.hadoop.fs.Path(u)
        stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
        rows.append((u, bytearray(stream.readAllBytes())))
        stream.close()
    out = spark.createDataFrame(rows, CONTENT)
    if inside:
        out = out.unionByName(spark.createDataFrame(spark.sparkContext.binaryFiles(",".join(inside)).map(lambda kv: (kv[0], bytes(kv[1]))), CONTENT))
    return out


def literal(uri: str) -> str:
    """A path whose special characters stand for themselves where patterns are taken."""
    return re.sub(r"([\[\]{}*?,\\])", r"\\\1", uri)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content): every *.md below the folder, path relative to it; a missing folder is empty.

    Files are listed and read by tasks, where these can open them, else by Spark's binary reader; hidden ones, which
    that skips, are then read apart.
    """
    if not exists(spark, folder):
        return spark.createDataFrame([], FILES)
    if root := on_disk(spark, folder):
        return read_by_tasks(named_by_tasks(spark, root, versions=False)).select("path", "content")
    raw = binary(spark, folder).select("uri", "content")
    for s in sets(hidden_files(spark, folder)):
        raw = raw.unionByName(read_hidden(spark, [uri for uri, *_ in s]))
    return raw.select(relative("uri", root_of(spark, folder)).alias("path"), "content")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(uri, path, modified, size) of the same files, without reading them."""
    if not exists(spark, folder):
        return spark.createDataFrame([], LISTED)
    if root := on_disk(spark, folder):
        return named_by_tasks(spark, root)
    out = binary(spark, folder).select("uri", relative("uri", root_of(spark, folder)).alias("path"), "modified", "size")
    for s in sets(hidden_files(spark, folder)):
        out = out.unionByName(spark.createDataFrame(s, LISTED))
    return out


def read_listed(spark: SparkSession, rows: list[tuple[str, str, int, int]]) -> DataFrame:
    """(path, modified, size, content) of a bounded number of listed files. One that is gone since is left out."""
    there = [r for r in rows if exists(spark, r[0])]
    named = spark.createDataFrame(there, LISTED)
    hidden = [uri for uri, *_ in there if uri.rsplit("/", 1)[-1][:1] in "._"]
    plain = [uri for uri, *_ in there if uri.rsplit("/", 1)[-1][:1] not in "._"]
    content = spark.createDataFrame([], CONTENT)
    if plain:
        content = content.unionByName(binary(spark, [literal(u) for u in plain]).select("uri", "content"))
    if hidden:
        content = content.unionByName(read_hidden(spark, hidden))
    return content.join(F.broadcast(named), "uri").select("path", "modified", "size", "content")


def read_among(spark: SparkSession, folder: str, named: DataFrame) -> DataFrame:
    """The same for named(uri, path, modified, size) of any number, whose names do not come to the driver. Where tasks
    cannot open them, files are read below the folder, those that were changed before or after all that are named left out."""
    if on_disk(spark, folder):
        return read_by_tasks(named)
    hidden = F.col("path").rlike(r"(^|/)[._]")
    span = named.where(~hidden).agg(F.min("modified"), F.max("modified")).first()
    content = spark.createDataFrame([], CONTENT)
    if span[0] is not None:
        content = binary(spark, folder, *span).select("uri", "content")
    for s in sets(named.where(hidden).select("uri").toLocalIterator()):
        content = content.unionByName(read_hidden(spark, [r["uri"] for r in s]))
    return content.join(named, "uri").select("path", "modified", "size", "content")
