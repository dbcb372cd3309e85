"""Files in one piece from sorted DataFrames, and atomic files.

Every task writes its range of the rows as a part in the shared folder. The parts' sizes, one row a task, say where each part lies in the file;
then tasks copy the parts to their places, all at once, where all machines see the file's folder, and else the driver streams them one by one. For
what has to pass through a program (standard output, a Parquet footer) the driver takes Arrow batches in range order and holds one partition.
"""

from __future__ import annotations

import contextlib
import os
import pickle
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from strandmill.plans import storage

COPY = 4 << 20  # bytes that a task copies at once


def arrow_batches(ordered: DataFrame) -> Iterator[pa.RecordBatch]:
    """The rows of an ordered DataFrame as Arrow batches, in order."""

    def pack(batches):
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch"])

    for row in ordered.mapInArrow(pack, "batch binary").toLocalIterator(prefetchPartitions=True):
        with pa.ipc.open_stream(row["batch"]) as stream:
            yield from stream


@contextlib.contextmanager
def atomic(path: str):
    """A binary file that takes its place at path, flushed to disk, only if the block ends well."""
    temporary = f"{path}.tmp"
    try:
        with open(temporary, "wb") as out:
            yield out
            out.flush()
            os.fsync(out.fileno())
        os.replace(temporary, path)
    except BaseException:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(temporary)
        raise


def file_system(spark: SparkSession, path: str):
    """(file system, path) of a path that Spark can write, wherever it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def first_bytes(spark: SparkSession, path: str, n: int) -> bytes:
    """Up to n bytes of the beginning of a file at such a path; none where there is no single file."""
    fs, at = file_system(spark, path)
    if not fs.exists(at) or fs.getFileStatus(at).isDirectory():
        return b""
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(n, fs.getFileStatus(at).getLen())))
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file at such a path."""
    fs, at = file_system(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def get_text(spark: SparkSession, path: str) -> str:
    fs, at = file_system(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def arrow_path(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """(file system, path in it) for Python code in tasks: local and mounted paths, and stores that Arrow knows by their scheme."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def arrow_opens(path: str) -> bool:
    """Whether Python code in tasks can open the file: its scheme is known to Arrow."""
    try:
        store, at = arrow_path(path)
    except pa.ArrowInvalid:
        return False
    return store.get_file_info(at).is_file


def written_parts(rows: DataFrame, pack: Callable) -> list[tuple[str, int, object]]:
    """(path, size, what) of the part of each partition that has rows, in order. pack(batches, out) writes a partition's rows to the binary file out
    and returns what is to be known about it, small. A task that runs again writes another file; only the one whose result counts is named."""
    folder = storage.new_folder(rows.sparkSession, "parts")

    def work(batches):
        store, at = arrow_path(folder)
        filled = (b for b in batches if b.num_rows)
        first = next(filled, None)
        if first is None:
            return
        store.create_dir(at, recursive=True)
        name = f"{folder}/{uuid.uuid4().hex}"
        with store.open_output_stream(arrow_path(name)[1]) as out:
            what = pack(_again(first, filled), out)
            size = out.tell()
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name], "size": pa.array([size], pa.int64()), "what": pa.array([pickle.dumps(what)], pa.binary())})

    found = rows.mapInArrow(work, "part int, name string, size long, what binary").collect()
    return [(r["name"], r["size"], pickle.loads(r["what"])) for r in sorted(found, key=lambda r: r["part"])]


def _again(first, rest):
    yield first
    yield from rest


def places(parts: list[tuple[str, int, object]], head: bytes) -> list[int]:
    """Where each part begins in the file, behind the head."""
    at, found = len(head), []
    for _, size, _ in parts:
        found.append(at)
        at += size
    return found


def assemble(spark: SparkSession, parts: list[tuple[str, int, object]], head: bytes, tail: bytes, path: str) -> None:
    """The file of head, parts and tail, which takes its place at path only when it is whole. The parts are removed."""
    begins = places(parts, head)
    todo = [(name, size, begin) for (name, size, _), begin in zip(parts, begins, strict=True)]
    with atomic(path) as out:
        out.write(head)
        out.truncate(len(head) + sum(size for _, size, _ in todo))
        out.flush()
        mark = f"{path}.{uuid.uuid4().hex}"  # a task that sees it sees the file
        target = out.name
        with open(mark, "wb"):
            pass
        try:
            missing = _copied(spark, todo, target, mark) if todo else []
        finally:
            os.unlink(mark)
        for name, _, begin in missing:
            out.seek(begin)
            for chunk in _chunks(name):
                out.write(chunk)
        out.seek(0, os.SEEK_END)
        out.write(tail)
    for folder in {name.rpartition("/")[0] for name, _, _ in todo}:  # with what tasks that ran again have left
        store, at = arrow_path(folder)
        store.delete_dir(at)


def _chunks(name: str):
    store, at = arrow_path(name)
    with store.open_input_stream(at) as stream:
        while chunk := stream.read(COPY):
            yield chunk


def _copied(spark: SparkSession, todo: list, target: str, mark: str) -> list:
    """Those of todo that no task could copy to their place."""

    def work(batches):
        for batch in batches:
            done = []
            for k in batch.column("id").to_pylist():
                name, _, begin = todo[k]
                if os.path.exists(mark):
                    with open(target, "r+b") as out:
                        out.seek(begin)
                        for chunk in _chunks(name):
                            out.write(chunk)
                        out.flush()
                        os.fsync(out.fileno())
                    done.append(k)
            yield pa.RecordBatch.from_pydict({"id": pa.array(done, pa.int64())})

    seen = {r["id"] for r in spark.range(0, len(todo), 1, len(todo)).mapInArrow(work, "id long").collect()}
    return [t for k, t in enumerate(todo) if k not in seen]
