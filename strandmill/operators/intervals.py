"""Sets of intervals: merging, depth of coverage, set operations, nearest records. All in sweeps over ranges of the sorted rows, see ranges.

Intervals are half open, [Start, End); rows with End <= Start cover nothing and are left out, null coordinates too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.operators import ranges

LOCUS = ("Chromosome", "Start", "End")


def _covering(loci: DataFrame, *more: str) -> DataFrame:
    return loci.select("Chromosome", F.col("Start").cast("long").alias("Start"), F.col("End").cast("long").alias("End"), *more).where("End > Start and Chromosome is not null")


def merged(loci: DataFrame, gap: int = 0) -> DataFrame:
    """Chromosome, Start, End, records: what remains when intervals that overlap, touch or lie at most gap apart become one.

    Equal intervals are counted before the sort. An interval begins a new island if it starts behind all that ended before; islands are numbered by a
    running sum, and sums by island combine before their exchange, so an island may hold all rows.
    """
    rows = _covering(loci).groupBy(*LOCUS).agg(F.count("*").alias("records"))
    rows = ranges.running(ranges.in_order(rows, *LOCUS, size=loci.count()), F.max, before=F.struct("Chromosome", "End"))
    apart = F.col("before").isNull() | (F.col("before.Chromosome") != F.col("Chromosome")) | (F.col("Start") > F.col("before.End") + gap)
    rows = ranges.kept(rows.withColumn("apart", apart.cast("long")).drop("before"))
    rows = ranges.running(rows, F.sum, inclusive=True, island=F.col("apart"))
    return rows.groupBy("island").agg(F.min("Chromosome").alias("Chromosome"), F.min("Start").alias("Start"), F.max("End").alias("End"), F.sum("records").alias("records")).drop("island")


def _events(loci: DataFrame, out: str) -> DataFrame:
    """Chromosome, at, out: by how much the depth changes at a place. What begins and ends there is summed before any exchange."""
    edge = F.explode(F.array(F.struct(F.col("Start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("End").alias("at"), F.lit(-1).alias("d")))).alias("e")
    return _covering(loci).select("Chromosome", edge).groupBy("Chromosome", F.col("e.at").alias("at")).agg(F.sum("e.d").alias(out)).where(F.col(out) != 0)


def coverage(loci: DataFrame) -> DataFrame:
    """Chromosome, Start, End, depth: the longest stretches of equal depth above 0. The depth is the running sum of the changes, back at 0 at
    each chromosome's end."""
    rows = ranges.in_order(_events(loci, "change"), "Chromosome", "at", size=2 * loci.count())
    rows = ranges.running(rows, F.sum, inclusive=True, depth=F.col("change"))
    rows = ranges.neighbour(ranges.kept(rows), "behind", F.struct("at"), 1)
    return rows.where("depth > 0").select("Chromosome", F.col("at").alias("Start"), F.col("behind.at").alias("End"), "depth")


def combined(left: DataFrame, right: DataFrame, keep: Column) -> DataFrame:
    """Chromosome, Start, End: the longest stretches in which keep holds, a condition on how many intervals of either side are open (left_open,
    right_open), which must not hold where none is. One sweep carries both counts; what they were before a place follows from its changes."""
    zero = F.lit(0).cast("long")
    changes = _events(left, "l").withColumn("r", zero).unionByName(_events(right, "r").withColumn("l", zero))
    changes = changes.groupBy("Chromosome", "at").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    rows = ranges.in_order(changes, "Chromosome", "at", size=2 * (left.count() + right.count()))
    rows = ranges.running(rows, F.sum, inclusive=True, left_open=F.col("l"), right_open=F.col("r")).withColumn("kept", keep)
    rows = rows.withColumns({"left_open": F.col("left_open") - F.col("l"), "right_open": F.col("right_open") - F.col("r")}).where(F.col("kept") != keep)
    turns = ranges.neighbour(ranges.kept(rows.select("Chromosome", "at", "kept", ranges.PLACE, ranges.PART)), "behind", F.struct("at"), 1)
    return turns.where("kept").select("Chromosome", F.col("at").alias("Start"), F.col("behind.at").alias("End"))


def subtracted(left: DataFrame, right: DataFrame) -> DataFrame:
    """The stretches that the left covers and the right doesn't."""
    return combined(left, right, F.expr("left_open > 0 and right_open = 0"))


def intersected(left: DataFrame, right: DataFrame) -> DataFrame:
    """The stretches that both cover."""
    return combined(left, right, F.expr("left_open > 0 and right_open > 0"))


def complement(loci: DataFrame, sizes: DataFrame) -> DataFrame:
    """The stretches of the chromosomes (name, length) that nothing covers."""
    return subtracted(sizes.select(F.col("name").alias("Chromosome"), F.lit(0).alias("Start"), F.col("length").alias("End")), loci)


def closest(left: DataFrame, right: DataFrame) -> DataFrame:
    """left with the nearest record of right on its chromosome: its columns under near_, and distance, 0 if the two overlap or touch.

    Of the records that begin before the left one ends, the one that reaches furthest counts (of several the last by start and other columns);
    of those that begin later the first. The nearer of the two is taken, on a tie the earlier. Both are observations carried through one order: the running
    maximum of what came before, the running minimum of what follows. Left rows without coordinates or without a record on their chromosome have
    nulls; right rows without coordinates take no part.
    """
    more = [c for c in right.columns if c not in LOCUS]
    own = [F.col(c).alias(f"c{i}") for i, c in enumerate(left.columns)]
    queries = left.select("Chromosome", F.col("End").cast("long").alias("at"), F.lit(0).alias("kind"), F.struct(*own).alias("row"), F.col("Start").cast("long").alias("low"), F.lit(None).cast("long").alias("reach"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"m{i}") for i, c in enumerate(more)])
    targets = right.where("Chromosome is not null and Start is not null and End is not null").select("Chromosome", F.col("Start").cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(queries.schema["row"].dataType).alias("row"), F.lit(None).cast("long").alias("low"), F.col("End").cast("long").alias("reach"), *[F.col(c).alias(f"m{i}") for i, c in enumerate(more)])
    rest = [f"m{i}" for i in range(len(more))]
    rows = ranges.in_order(queries.unionByName(targets), "Chromosome", "at", "kind", "reach", *rest, size=queries.count() + targets.count())
    seen = F.col("kind") == 1
    rows = ranges.kept(ranges.running(rows, F.max, back=F.when(seen, F.struct("Chromosome", "reach", "at", *rest))))
    rows = ranges.running(rows, F.min, reverse=True, forth=F.when(seen, F.struct("Chromosome", "at", "reach", *rest)))
    here = lambda c: (F.col(f"{c}.Chromosome") == F.col("Chromosome")) & F.col("low").isNotNull() & F.col("at").isNotNull()
    rows = rows.where("kind = 0").withColumn("d_back", F.when(here("back"), F.greatest(F.col("low") - F.col("back.reach"), F.lit(0)))).withColumn("d_forth", F.when(here("forth"), F.col("forth.at") - F.col("at")))
    first = F.col("d_back").isNotNull() & (F.col("d_forth").isNull() | (F.col("d_back") <= F.col("d_forth")))
    pick = lambda c: F.when(first, F.col(f"back.{c}")).when(F.col("d_forth").isNotNull(), F.col(f"forth.{c}"))
    near = [pick("at").alias("near_Start"), pick("reach").alias("near_End"), *[pick(f"m{i}").alias(f"near_{c}") for i, c in enumerate(more)]]
    return rows.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(left.columns)], *near, F.when(first, F.col("d_back")).otherwise(F.col("d_forth")).alias("distance"))
