"""Columns and tables derived from loci: running maxima, runs, statistics, histograms, the interval index.

Small tables of totals carry results across tasks: a task's size is bounded by positions or by ranges of the data, not by a
chromosome or by how many records begin at one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions import scalar
from strandmill.operators import ranges
from strandmill.plans.storage import BROADCAST_ROWS
from strandmill.schema import BedError

INDEX_BLOCK = 16_384  # rows of a block of the interval index
RECORD_OVERHEAD = 20  # bytes a record adds to a pass's budget besides its line


def max_end_so_far(loci: DataFrame, chrom="Chromosome", start="Start", end="End", shift: int = scalar.BUCKET_SHIFT, out: str = "MaxEndSoFar") -> DataFrame:
    """loci with the running maximum of end within its chromosome, in order of (start, end).

    Among equal starts the ends ascend, so a row's maximum is its own end or the most of earlier starts. One row a start, combined before
    the exchange, is all that the windows see: a bucket has at most 2**shift of them, however many records begin there.
    """
    starts = loci.groupBy(F.col(chrom).alias("__c"), F.col(start).alias("__s")).agg(F.max(end).alias("__most")).withColumn("__cell", scalar.bucket(F.col("__s"), shift))
    earlier_cells = Window.partitionBy("__c").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = starts.groupBy("__c", "__cell").agg(F.max("__most").alias("__top")).select("__c", "__cell", F.max("__top").over(earlier_cells).alias("__before"))
    earlier = Window.partitionBy("__c", "__cell").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    prior = starts.withColumn("__own", F.max("__most").over(earlier)).join(cells, ["__c", "__cell"]).select("__c", "__s", F.greatest("__own", "__before").alias("__prior"))
    joined = loci.join(prior, (F.col(chrom) == F.col("__c")) & (F.col(start) == F.col("__s")))
    return joined.withColumn(out, F.greatest(end, "__prior")).drop("__c", "__s", "__prior")


def max_end_in_order(rows: DataFrame, chrom="Chromosome", end="End", out: str = "MaxEndSoFar") -> DataFrame:
    """rows that lie sorted, each chromosome in one run, with the running maximum of end within the chromosome, in the same order.

    The rows are written once; a table of at most one row a range says what a range's first chromosome brings from the ranges before, and then each
    range is one pass in Arrow batches. So there is no exchange besides the caller's sort.
    """
    own = ranges.placed(rows)
    tops = own.groupBy(ranges.PART, F.col(chrom).alias("c")).agg(F.max(end).alias("top"))
    before = Window.partitionBy("c").orderBy(ranges.PART).rowsBetween(Window.unboundedPreceding, -1)
    # Only a chromosome that spans ranges has a carry, and only as the first of a range.
    carried = tops.select(ranges.PART, "c", F.max("top").over(before).alias("carry")).where("carry is not null")
    carry = {r[ranges.PART]: (r["c"], r["carry"]) for r in carried.collect()}

    def work(batches):
        name, most = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names, ends = batch.column(chrom), batch.column(end).to_numpy(zero_copy_only=False)
            if name is None:
                name, most = carry.get(batch.column(ranges.PLACE)[0].as_py() >> 33, (None, None))
            runs = pc.run_end_encode(names)
            found, begin = np.empty(len(ends), ends.dtype), 0
            for own_name, stop in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                top = np.maximum.accumulate(ends[begin:stop])
                found[begin:stop] = np.maximum(top, most) if own_name == name else top
                name, most, begin = own_name, found[stop - 1], stop
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found)], [*kept, out])

    kept = [c for c in rows.columns if c != out]
    schema = rows.select(*kept).schema.add(out, rows.schema[end].dataType, False)
    return own.drop(ranges.PART).mapInArrow(work, schema)


def chromosome_stats(loci: DataFrame, chrom="Chromosome", start="Start", end="End", chrom_keys=None) -> DataFrame:
    """name, rows, row_offset, min_start, max_start, max_end: a row a chromosome, offsets in storage order."""
    stats = loci.groupBy(F.col(chrom).alias("name")).agg(F.count("*").alias("rows"), F.min(start).alias("min_start"), F.max(start).alias("max_start"), F.max(end).alias("max_end"))
    before = Window.orderBy(*(chrom_keys or [F.col("name")])).rowsBetween(Window.unboundedPreceding, -1)
    return stats.withColumn("row_offset", F.coalesce(F.sum("rows").over(before), F.lit(0)))


def run_boundaries(rows: DataFrame, chrom="chrom") -> DataFrame:
    """rows with rn, their place in the order in which they lie, and new_run: whether the row before is of another chromosome."""
    own = ranges.placed(rows)
    met = ranges.neighbour(ranges.numbered(own, keep=True), "__before", F.struct(F.col(chrom).alias("c")))
    return ranges.released(met.withColumn("new_run", F.col("__before").isNull() | (F.col("__before.c") != F.col(chrom))).drop("__before"))


def position_histogram(records: DataFrame, shift: int = scalar.BUCKET_SHIFT, chrom="chrom", start="start", line="value") -> DataFrame:
    """chrom, bucket, records, bytes (lines with their line ends)."""
    return records.groupBy(chrom, scalar.bucket(F.col(start), shift).alias("bucket")).agg(F.count("*").alias("records"), F.sum(F.octet_length(line) + 1).alias("bytes"))


def plan_passes(histogram: list[tuple], budget: int) -> list[tuple[int, int]]:
    """Stretches [a, b) of the ordered (chrom, bucket, records, bytes) rows whose bytes and overheads fit the budget."""
    passes, a, used = [], 0, 0
    for i, (chrom, bucket, records, size) in enumerate(histogram):
        need = size + RECORD_OVERHEAD * records
        if need > budget:
            raise BedError(f"bucket {bucket} of {chrom} needs {need} bytes, more than the budget of {budget}")
        if used + need > budget:
            passes.append((a, i))
            a, used = i, 0
        used += need
    return [*passes, (a, len(histogram))] if len(histogram) > a else passes


def in_bucket_range(chrom, bucket, low: tuple, high: tuple | None):
    """Whether (chrom, bucket) lies in [low, high); no high means no end."""
    at_least = lambda k: (chrom > k[0]) | ((chrom == k[0]) & (bucket >= k[1]))
    return at_least(low) & (~at_least(high) if high is not None else F.lit(True))


def interval_index(loci: DataFrame, chrom="Chromosome", start="Start", end="End", shift: int = scalar.BUCKET_SHIFT) -> DataFrame:
    """chromosome, starts, ends, max_end_running, row_id: a row a chromosome with lists in storage order.

    The lists of a chromosome form one row by definition, so a chromosome must fit a task; the index is opt-in for that reason. The running
    maximum is worked out before the rows come together, which then are sorted once.
    """
    rows = max_end_so_far(loci.select(F.col(chrom).alias("chromosome"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")), "chromosome", "s", "e", shift, "m")
    lists = rows.groupBy("chromosome").agg(F.array_sort(F.collect_list(F.struct("s", "e", "m"))).alias("rows"))
    before = Window.orderBy("chromosome").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.size("rows").cast("long")).over(before), F.lit(0))
    return lists.withColumn("offset", offset).select(
        "chromosome",
        F.col("rows.s").alias("starts"),
        F.col("rows.e").alias("ends"),
        F.col("rows.m").alias("max_end_running"),
        F.sequence(F.col("offset"), F.col("offset") + F.size("rows") - 1).alias("row_id"),
    )


def quantiles(rows: DataFrame, key: str, value: str, at: list[float], accuracy: int = 10_000) -> DataFrame:
    """key, n, quantiles (a list): by sketches of bounded size, one a task and key, which are merged; an exact percentile holds every distinct value of a
    key in one place. The rank of each answer is off by at most n / accuracy."""
    return rows.groupBy(key).agg(F.count(value).alias("n"), F.percentile_approx(value, at, accuracy).alias("quantiles"))


def quantile_errors(rows: DataFrame, key: str, value: str, at: list[float], accuracy: int = 10_000) -> DataFrame:
    """key, n, and for each quantile off_i: by how many rows its answer misses the wanted rank."""
    found = quantiles(rows, key, value, at, accuracy)
    met = rows.where(F.col(value).isNotNull()).join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, key)
    below = [F.sum((F.col(value) < F.col("quantiles")[i]).cast("long")).alias(f"below{i}") for i in range(len(at))]
    upto = [F.sum((F.col(value) <= F.col("quantiles")[i]).cast("long")).alias(f"upto{i}") for i in range(len(at))]
    ranks = met.groupBy(key, "n").agg(*below, *upto)
    rank = lambda q: F.ceil(F.col("n") * q)
    off = [F.greatest(F.col(f"below{i}") + 1 - rank(q), rank(q) - F.col(f"upto{i}"), F.lit(0)).alias(f"off{i}") for i, q in enumerate(at)]
    return ranks.select(key, "n", *off)


def blocked_index(loci: DataFrame, chrom="Chromosome", start="Start", end="End", block_rows: int = INDEX_BLOCK, chrom_keys=None) -> DataFrame:
    """The interval index in blocks: chromosome, block, first_start, last_start, most_end (the running maximum at its last row), first_row, rows,
    and the lists starts, ends, max_end_running, row_id of at most block_rows rows in storage order.

    Rows are sorted once by range; places and running maxima carry over from range to range, and a block is a group of bounded size, so no task
    holds a chromosome. A reader finds its blocks by the scalar columns, which are the directory, without the lists.
    """
    rows = loci.select(F.col(chrom).alias("chromosome"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    rows = ranges.in_order(rows, *(chrom_keys or [F.col("chromosome")]), "s", "e")
    rows = ranges.numbered(ranges.running(rows, F.max, inclusive=True, top=F.struct("chromosome", "e")), "place")
    rows = rows.select("chromosome", F.floor((F.col("place") - 1) / block_rows).alias("block"), F.struct((F.col("place") - 1).alias("i"), "s", "e", F.col("top.e").alias("m")).alias("r"))
    lists = rows.groupBy("chromosome", "block").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    first, last = F.get("rows", F.lit(0)), F.element_at("rows", -1)
    scalars = [first["s"].alias("first_start"), last["s"].alias("last_start"), last["m"].alias("most_end"), first["i"].alias("first_row"), F.size("rows").alias("rows")]
    return lists.select("chromosome", "block", *scalars, *[F.col(f"rows.{c}").alias(n) for c, n in (("s", "starts"), ("e", "ends"), ("m", "max_end_running"), ("i", "row_id"))])


def first_above(ascending: Column, bound) -> Column:
    """The number of elements of an ascending array that are at most the bound, by halving: 40 looks at the array, whatever its length."""
    look = lambda s, _: F.when(s["low"] >= s["high"], s).otherwise(halved(s))

    def halved(s):
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        right = F.get(ascending, middle) <= F.lit(bound)
        return F.struct(F.when(right, middle + 1).otherwise(s["low"]).alias("low"), F.when(right, s["high"]).otherwise(middle).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(F.lit(0).alias("low"), F.size(ascending).alias("high")), look, lambda s: s["low"])
