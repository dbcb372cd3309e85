"""Running results over rows in a total order, range by range, with what carries over from the ranges before.

placed() writes rows once, in the order in which they lie, with the number of their range. A pass in Arrow batches then sees one range, and a table of one row a
range carries the results across. So a task's size follows the data: neither a long chromosome, nor a crowded start, nor an interval that spans everything
makes a hot task. Neighbours likewise meet within their range, or over its boundary by that table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.plans import storage

PLACE, PART = "__id", "__part"
RANGE_ROWS = 500_000  # of a range, about


def placed(rows: DataFrame) -> DataFrame:
    """rows, written, with their place (ascending in the order in which they lie) and their range."""
    return storage.cut(rows.withColumn(PLACE, F.monotonically_increasing_id())).withColumn(PART, F.shiftrightunsigned(PLACE, 33))


def in_order(rows: DataFrame, *keys, size: int = 0) -> DataFrame:
    """rows sorted by the keys and placed. Rows of equal keys may lie in several ranges. size: how many rows to expect at most; there are as many ranges
    as RANGE_ROWS asks for, so that a task's work doesn't grow with the input."""
    with storage.shuffles(rows.sparkSession, -(-size // RANGE_ROWS)):
        return placed(rows.withColumn("__tie", F.monotonically_increasing_id()).orderBy(*keys, "__tie").drop("__tie"))


def kept(rows: DataFrame) -> DataFrame:
    """placed rows, written again with what has been found so far, so that each further pass starts from there."""
    return storage.cut(rows)


def released(rows: DataFrame) -> DataFrame:
    return rows.drop(PLACE, PART)


def _both(agg, own: Column, carry: Column) -> Column:
    if agg is F.sum:
        return F.coalesce(own, F.lit(0)) + F.coalesce(carry, F.lit(0))
    return (F.greatest if agg is F.max else F.least)(own, carry)


def _ranges(batches):
    """(range, batch) of placed batches, of one range each."""
    for batch in batches:
        part = batch.column(PART).to_numpy()
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                yield int(part[a]), batch.slice(a, b - a)


def _best(column: pa.Array, least: bool) -> np.ndarray:
    """For each element, the index of the greatest (least) so far by Spark's order, -1 where all so far are null; a struct compares field by field."""
    table = pa.table(dict((str(i), f) for i, f in enumerate(column.flatten()))) if pa.types.is_struct(column.type) else pa.table({"0": column})
    order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in table.column_names], null_placement="at_start").to_numpy().astype(np.int64)
    order = order[::-1] if least else order
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    rank[column.is_null().to_numpy(zero_copy_only=False)] = -1
    top = np.maximum.accumulate(rank)
    return np.where(top < 0, -1, order[top])


class _Running:
    """One running result over the rows of one range, a column at a time."""

    def __init__(self, agg: str, kind: pa.DataType):
        self.agg, self.carry = agg, pa.array([0 if agg == "sum" else None], kind)

    def __call__(self, column: pa.Array, inclusive: bool = False) -> pa.Array:
        if self.agg == "sum":
            both = pc.cumulative_sum(pa.concat_arrays([self.carry, column.fill_null(pa.scalar(0).cast(column.type))]))
        else:
            both = pa.concat_arrays([self.carry, column])
            best = _best(both, self.agg == "min")
            both = both.take(pa.array(np.maximum(best, 0), mask=best < 0))
        self.carry = both.slice(len(column))
        return both.slice(1) if inclusive else both.slice(0, len(column))


def _with(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)


def _valued(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c not in values], *[v.alias(n) for n, v in values.items()])


def _loose(rows: DataFrame, names) -> T.StructType:
    """The schema of rows, in which the named columns may be null."""
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable or f.name in names, f.metadata) for f in rows.schema])


def running(rows: DataFrame, agg: Callable, inclusive: bool = False, reverse: bool = False, **values: Column) -> DataFrame:
    """placed rows with agg (F.max, F.min or F.sum) of each value, under its name, over all rows before, or, reverse, behind; inclusive: the
    row's own counts.

    Sums of nothing are 0, other results null. Structs compare field by field, so a running maximum of (chromosome, end) begins anew with each
    chromosome where rows are sorted by it. A range is one pass in Arrow batches over its written rows, without an exchange; reverse holds the range.
    """
    kinds = rows.select(*[agg(v).alias(n) for n, v in values.items()]).schema
    valued = _valued(rows, {n: v.cast(kinds[n].dataType) for n, v in values.items()})
    how, names = {F.sum: "sum", F.max: "max", F.min: "min"}[agg], list(values)

    def begin(batch):
        return {n: _Running(how, batch.schema.field(n).type) for n in names}

    def total(batches):
        own, state = None, {}
        for part, batch in _ranges(batches):
            if part != own:
                if state:
                    yield answer(own, state)
                own, state = part, begin(batch)
            for n in names:
                state[n](batch.column(n))
        if state:
            yield answer(own, state)

    def answer(part, state):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *(state[n].carry for n in names)], [PART, *names])

    def work(batches):
        own, state, held = None, {}, []
        for part, batch in _ranges(batches):
            if part != own:
                yield from backwards(held)
                own, state, held = part, begin(batch), []
            if reverse:
                held.append(batch)
            else:
                yield _with(batch, {n: state[n](batch.column(n), inclusive) for n in names})
        yield from backwards(held)

    def backwards(held):
        if held:
            state, out = begin(held[0]), []
            while held:
                batch = held.pop()
                turn = pa.array(np.arange(batch.num_rows)[::-1])
                out.append(_with(batch, {n: state[n](batch.column(n).take(turn), inclusive).take(turn) for n in names}))
            while out:
                yield out.pop()

    kept = [PART, *names]
    ends = valued.select(*kept).mapInArrow(total, T.StructType([T.StructField(PART, T.LongType()), *[T.StructField(n, kinds[n].dataType) for n in names]]))
    across = Window.orderBy(F.desc(PART) if reverse else F.asc(PART)).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    carried = ends.select(PART, *[agg(n).over(across).alias(f"__carry_{n}") for n in names])
    both = valued.mapInArrow(work, _loose(valued, names)).join(F.broadcast(carried), PART)
    return both.withColumns({n: _both(agg, F.col(n), F.col(f"__carry_{n}")) for n in names}).drop(*[f"__carry_{n}" for n in names])


def neighbour(rows: DataFrame, out: str, value: Column, step: int = -1) -> DataFrame:
    """placed rows with the value, a struct, of the row before (step -1) or behind (step 1); null where there is none. Passes as in running."""
    valued = _valued(rows, {out: value})

    def edge(batches):
        own, held = None, None
        for part, batch in _ranges(batches):
            if part != own:
                if held is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), held], [PART, "__edge"])
                own, held = part, None
            if held is None or step < 0:
                held = batch.column(out).slice(batch.num_rows - 1 if step < 0 else 0, 1)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), held], [PART, "__edge"])

    def shifted(batches):
        own, held = None, None  # step -1: the last value; step 1: the batch that waits for the next value
        for part, batch in _ranges(batches):
            column = batch.column(out)
            none = pa.nulls(1, column.type)
            if step < 0:
                first = held if part == own else none
                yield _with(batch, {out: pa.concat_arrays([first, column.slice(0, batch.num_rows - 1)])})
                held = column.slice(batch.num_rows - 1)
            else:
                if held is not None:
                    waits = held.column(out)
                    yield _with(held, {out: pa.concat_arrays([waits.slice(1), column.slice(0, 1) if part == own else none])})
                held = batch
            own = part
        if step > 0 and held is not None:
            waits = held.column(out)
            yield _with(held, {out: pa.concat_arrays([waits.slice(1), pa.nulls(1, waits.type)])})

    kind = valued.schema[out].dataType
    edges = valued.select(PART, out).mapInArrow(edge, T.StructType([T.StructField(PART, T.LongType()), T.StructField("__edge", kind)]))
    edges = edges.select(PART, (F.lag if step < 0 else F.lead)("__edge", 1).over(Window.orderBy(PART)).alias("__edge"))  # one row a range; a range without rows has none
    return valued.mapInArrow(shifted, _loose(valued, [out])).join(F.broadcast(edges), PART).withColumn(out, F.coalesce(out, "__edge")).drop("__edge")


def numbered(rows: DataFrame, out: str = "rn", keep: bool = False) -> DataFrame:
    """rows (placed, or to be placed now) with the place of each in the order in which they lie, from 1. keep: they stay placed."""
    own = rows if PLACE in rows.columns else placed(rows)
    counts = own.groupBy(PART).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.col("__before") + F.col(PLACE).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    found = own.join(F.broadcast(counts.select(PART, before.alias("__before"))), PART).withColumn(out, place).drop("__before")
    return found if keep else released(found)
