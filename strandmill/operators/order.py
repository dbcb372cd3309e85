"""Locus orders. Every order is total: the remaining columns break ties, so results never depend on the run."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.functions import scalar
from strandmill.operators.ranges import numbered
from strandmill.plans import storage
from strandmill.schema import BedError

MODES = ("s", "b", "5")
RANK = "__rank"


def chromosome_keys(chrom: str = "chrom", natural: bool = False) -> list[Column]:
    """Byte order, or natural order with byte order between names that it ties."""
    return [scalar.natural_key(F.col(chrom)), F.col(chrom)] if natural else [F.col(chrom)]


def name_ranks(records: DataFrame, chrom: str = "chrom") -> DataFrame:
    """chrom, rank: the distinct names with their place in natural order, from 0. Only here the natural key is worked out, once a name."""
    names = records.select(chrom).distinct()
    return names.withColumn("rank", F.row_number().over(Window.orderBy(*chromosome_keys(chrom, True))) - 1)


def position(mode: str, start: str = "start", end: str = "end", strand: str = "strand") -> Column:
    if mode not in MODES:
        raise BedError(f"the sort key is one of {', '.join(MODES)}, not {mode}")
    return scalar.five_prime(F.col(start), F.col(end), F.col(strand)) if mode == "5" else F.col(start)


def keyed(records: DataFrame, mode: str, natural: bool = False, ties: tuple[str, ...] = ("value",), **columns: str) -> tuple[DataFrame, list[Column]]:
    """(records, sort columns) of a mode: s by start, b by start and end, 5 by the strand's beginning. For natural order the records carry
    the rank of their name, to be dropped with RANK."""
    chrom = columns.pop("chrom", "chrom")
    first = F.col(chrom)
    if natural:
        ranks = storage.cut(name_ranks(records, chrom).withColumnRenamed("rank", RANK))
        records, first = records.join(storage.small(ranks), chrom), F.col(RANK)
    return records, [first, position(mode, **columns), *([F.col(columns.get("end", "end"))] if mode == "b" else []), *[F.col(t) for t in ties]]


def sort_records(records: DataFrame, mode: str = "s", natural: bool = False, ties: tuple[str, ...] = ("value",), **columns: str) -> DataFrame:
    """Globally sorted: one range exchange on the whole key, so neither a long chromosome nor a crowded start makes a hot task."""
    records, keys = keyed(records, mode, natural, ties, **columns)
    return records.orderBy(*keys).drop(RANK)


def ranked(records: DataFrame, *by) -> DataFrame:
    """records with rn, the row's place in the order of the columns, from 1: sorted by range, so a task's size depends on the data alone."""
    return numbered(records.orderBy(*by))


def _falls(table: pa.RecordBatch) -> int:
    """How many rows come after a greater one, by the columns in turn, nulls first."""
    falls, same = False, True
    for column in table.columns:
        now, then = column.slice(1), column.slice(0, len(column) - 1)
        no_now, no_then = now.is_null(), then.is_null()
        less = pc.or_(pc.fill_null(pc.less(now, then), False), pc.and_(no_now, pc.invert(no_then)))
        falls = pc.or_(falls, pc.and_(same, less))
        same = pc.and_(same, pc.or_(pc.fill_null(pc.equal(now, then), False), pc.and_(no_now, no_then)))
    return pc.sum(falls).as_py() or 0


def inversions(rows: DataFrame, *by: str) -> DataFrame:
    """inversions: the number of rows that come after a greater one, in the order in which rows lie. One pass, in which a task leaves its first and last
    row and its count; nothing is written, and no row moves."""
    own = rows.select(*by)

    def work(batches):
        first, last, found = None, None, 0
        for batch in batches:
            if batch.num_rows:
                first = batch.slice(0, 1) if first is None else first
                both = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
                found, last = found + _falls(both), batch.slice(batch.num_rows - 1)
        if first is not None:
            columns = [pa.array([TaskContext.get().partitionId()], pa.int32()), *(pa.StructArray.from_arrays(e.columns, names=list(by)) for e in (first, last)), pa.array([found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "first", "last", "found"])

    row = T.StructType([T.StructField(f.name, f.dataType) for f in own.schema])
    ends = own.mapInArrow(work, T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", row), T.StructField("last", row), T.StructField("found", T.LongType())]))
    over = F.col("first") < F.lag("last").over(Window.orderBy("part"))  # one row a range
    counted = ends.select((F.col("found") + F.coalesce(over.cast("long"), F.lit(0))).alias("found"))
    return counted.groupBy().agg(F.coalesce(F.sum("found"), F.lit(0)).alias("inversions"))


def bam_keys(tid: Column, pos: Column) -> list[Column]:
    """Coordinate order of alignments: references by number, those without one last, a missing position last within its reference."""
    return [tid < 0, tid, pos < 0, pos]
