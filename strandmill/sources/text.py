"""BED text out: one ordered file, a folder of ordered parts, or a stream."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame

from strandmill.sources import ordered


def write_file(lines: DataFrame, path: str, header: list[str] = ()) -> None:
    """One file: header lines, then the ordered column value. Every task writes its part."""

    def pack(batches, out):
        for batch in batches:
            out.write(("\n".join(batch.column("value").to_pylist()) + "\n").encode())

    head = "".join(f"{h}\n" for h in header).encode()
    ordered.assemble(lines.sparkSession, ordered.written_parts(lines.select("value"), pack), head, b"", path)


def write_shared(lines: DataFrame, path: str, header: list[str] = ()) -> None:
    """The same at a path that Spark can write. A store that isn't mounted takes no writes to places within a file, so there one task writes it."""
    if "://" not in path or path.startswith("file:"):
        write_file(lines, ordered.arrow_path(path)[1], header)
    else:
        spark = lines.sparkSession
        spark.createDataFrame([(h,) for h in header], "value string").coalesce(1).union(lines.select("value")).coalesce(1).write.text(path)


def write_parts(lines: DataFrame, path: str) -> None:
    """A folder whose parts, in name order, hold the ordered lines."""
    lines.select("value").write.text(path)


def write_stream(lines: DataFrame, header: list[str] = (), out=None) -> None:
    write_stream_to([lines], header, out or sys.stdout.buffer)


def write_stream_to(pieces, header: list[str], out) -> None:
    """Header lines, then the ordered lines of each piece in turn."""
    for h in header:
        out.write(h.encode() + b"\n")
    for lines in pieces:
        for chunk in _chunks(lines):
            out.write(chunk)
    out.flush()


def _chunks(lines: DataFrame):
    for batch in ordered.arrow_batches(lines.select("value")):
        values = batch.column("value").to_pylist()
        if values:
            yield ("\n".join(values) + "\n").encode()
