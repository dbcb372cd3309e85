"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words; a document's expected copies are target / words of its source. Within a
source, documents lie in order of size, and a document is emitted once for each integer that its stretch of the running
sum of expected copies, moved by one random offset, crosses. So copies differ from the expectation by less than one, and
neighbours of like size make up for each other: a source misses its target by about its largest document at most.

The running sum needs no task that holds a source: rows are ranged by (source, size, hash), written out, counted by
range and source, and a row's place is the sum of the counts before plus its place in its range. The offset is a hash of
the source, so reruns agree.

Defined cases: a null text has size 0; a null source is a source, the last; sources of size 0 have target 0 and no
copies; repeated rows are separate rows, counted before they move, so no task holds all of a group; an empty table gives an
empty result; extra columns pass through `mix`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm import textkit

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_REPEATS = 2.0
RUN = 100_000  # equal documents that one task takes back to rows


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """source, source_size, target from source, source_size: share of all words by weight, never above most times a source's words.

    Sources fill in order of their cap over their weight. The level at a source is what the rest gets for a weight of 1 when all
    before are full; it rises as long as sources fill and falls after, so the highest is the level at which filling ends. One row a source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    table = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    settled = F.max("level").over(every)
    return table.withColumn("level", level).withColumn("target", F.least(F.col("cap"), F.col("weight") * settled)).select("source", "source_size", "target")


def _keyed(docs: DataFrame):
    """The columns that tell rows apart for the mix; rows equal in them are interchangeable."""
    return {"size": word_count(F.col("text")), **textkit.row_keys("doc_id", "text", "source")}


KEYS = ["source", "size", *textkit.ROW_KEYS]


def places(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """doc_id, the keys, source_size, target, n, ahead, expected, offset: a row for n equal documents, with the rows ahead of them in
    their source's order, the copies expected of one document and the source's offset."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source", *[c.alias(n) for n, c in _keyed(docs).items()])
    base = textkit.cut(rows.groupBy("doc_id", *KEYS).agg(F.count("*").alias("n")))
    sources = textkit.cut(targets(base.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most))
    luck = F.xxhash64("doc_id", "row_key", F.lit("order"))
    ranged = base.withColumn("luck", luck).repartitionByRange(textkit.partitions(spark), F.col("source").asc_nulls_last(), "size", "luck")
    ranged = textkit.cut(ranged.withColumn("range", F.spark_partition_id()))  # written out: a range keeps its rows
    counts = ranged.groupBy("range", "source").agg(F.sum("n").alias("rows"))
    ahead = F.coalesce(F.sum("rows").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("range").alias("of_range"), F.col("source").alias("of_source"), ahead.alias("before"))
    sources = sources.withColumnRenamed("source", "its_source")
    counts = textkit.cut(counts.join(sources, F.col("of_source").eqNullSafe(F.col("its_source"))).drop("its_source"))  # one row a range and source
    earlier = Window.partitionBy("range", "source").orderBy("size", "luck", "doc_id", *textkit.ROW_KEYS).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    joined = ranged.withColumn("within", within).join(counts, (F.col("range") == F.col("of_range")) & F.col("source").eqNullSafe(F.col("of_source")))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64("source", F.lit("offset")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return joined.select("doc_id", *KEYS, "source_size", "target", "n", (F.col("before") + F.col("within")).alias("ahead"), expected.alias("expected"), offset.alias("offset"))


def _drawn(number: Column) -> Column:
    """The copies of the number-th (from 1) of equal documents: the integers that its stretch crosses."""
    end = F.col("ahead") + number
    return (F.floor(F.col("expected") * end + F.col("offset")) - F.floor(F.col("expected") * (end - 1) + F.col("offset"))).cast("int")


def copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, copies for every document."""
    placed = places(docs, weights, share, most)
    count = F.col("n")
    few = placed.where(count <= RUN).withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), count)))
    out = few.select("doc_id", "size", "source_size", "target", _drawn(F.col("number")).alias("copies"))
    many = placed.where(count > RUN)
    if many.isEmpty():
        return out
    # More equal documents than a run come back to rows in runs, dealt out.
    runs = many.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((count - 1) / RUN)))).repartition(textkit.partitions(docs.sparkSession), "row_key", "run")
    numbers = runs.withColumn("number", F.explode(F.sequence(F.col("run") * RUN + 1, F.least(count, (F.col("run") + 1) * RUN))))
    return out.unionByName(numbers.select("doc_id", "size", "source_size", "target", _drawn(F.col("number")).alias("copies")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (the words taken from the document) for every document."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """docs, each row as often as it was drawn. The texts move once, to meet their copies."""
    opened = ("text", "source")
    placed = textkit.cut(places(docs, weights, share, most).drop("doc_id", "source_size", "target", "source", "size"))
    rows = textkit.sealed(docs, opened, **textkit.row_keys("doc_id", "text", "source"), home=F.spark_partition_id())
    alone = placed.where("n = 1").select(*textkit.ROW_KEYS, _drawn(F.lit(1)).alias("drawn")).where("drawn > 0")
    out = rows.join(alone, textkit.ROW_KEYS).select("row", *opened, "drawn")
    several = placed.where("n > 1")
    if not several.isEmpty():  # equal rows get numbers within their partition, and the rows of the partitions before
        met = textkit.cut(rows.join(textkit.small(several), textkit.ROW_KEYS))
        counts = met.groupBy(*textkit.ROW_KEYS, "home").agg(F.count("*").alias("rows"))
        before = F.coalesce(F.sum("rows").over(Window.partitionBy(*textkit.ROW_KEYS).orderBy("home").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.select(*textkit.ROW_KEYS, "home", before.alias("before"))
        own = F.row_number().over(Window.partitionBy(*textkit.ROW_KEYS, "home").orderBy("home"))
        numbered = met.withColumn("own", own).join(counts, [*textkit.ROW_KEYS, "home"])
        out = out.unionByName(numbered.select("row", *opened, _drawn(F.col("before") + F.col("own")).alias("drawn")).where("drawn > 0"))
    return textkit.unsealed(out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("drawn")))), docs.columns, opened)
