"""Query workloads: regions as tab-separated text, regions drawn over chromosomes, and regions dealt by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import scalar

# Region sizes of the published benchmark, and how many regions of each.
SIZES = ((1_000, 333), (100_000, 333), (10_000_000, 334))


def parsed(lines: DataFrame) -> DataFrame:
    """q_chrom, q_start, q_end of lines (value) of at least three fields; shorter lines are skipped, further fields ignored.

    A position that is no integer ends the job, which names the line.
    """
    fields = F.split("value", "\t")
    rows = lines.where(F.size(fields) >= 3).select("value", fields.alias("fields"))

    def number(i):
        text = F.get("fields", F.lit(i))
        return F.coalesce(scalar.int32_strict(text), F.raise_error(F.concat(F.lit("a region's position is no integer: "), F.col("value"))).cast("int"))

    return rows.select(F.get("fields", F.lit(0)).alias("q_chrom"), number(1).alias("q_start"), number(2).alias("q_end"))


def read_workload(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path, lineSep="\n").select(scalar.without_return(F.col("value")).alias("value")))


def luck(seed: int, salt: str, number: Column) -> Column:
    """32 pseudo-random bits for a number, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed} {salt} "), number.cast("string"))), 1, 8), 16, 10).cast("long")


def drawn(sizes: DataFrame, seed: int = 42, wanted=SIZES) -> DataFrame:
    """q_id, q_chrom, q_start, q_end, size: regions at random places of chromosomes longer than they are; none of a size that fits nowhere.

    sizes: name, length. The chromosomes are a small table; a region picks one by its number among those that are long enough.
    """
    spark = sizes.sparkSession
    kinds = spark.createDataFrame([(i, size, n, sum(x for _, x in wanted[:i])) for i, (size, n) in enumerate(wanted)], "kind int, size long, n long, first long")
    regions = kinds.withColumn("q_id", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))).select("q_id", "kind", "size")
    fitting = kinds.join(sizes, F.col("length") > F.col("size")).groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("name", "length"))).alias("names"))
    picked = regions.join(fitting, "kind").withColumn("own", F.get("names", F.pmod(luck(seed, "chromosome", F.col("q_id")), F.size("names")).cast("int")))
    start = F.pmod(luck(seed, "start", F.col("q_id")), F.col("own.length") - F.col("size")).cast("int")
    return picked.select("q_id", F.col("own.name").alias("q_chrom"), start.alias("q_start"), (start + F.col("size")).cast("int").alias("q_end"), "size")


def chromosome_sizes(spark: SparkSession, manifest: dict) -> DataFrame:
    """name, length (the largest end) of the chromosomes of a dataset."""
    return spark.createDataFrame([(c["name"], int(c["max_end"])) for c in manifest["chromosomes"]], "name string, length long")


def of_size(regions: DataFrame, size: int) -> DataFrame:
    """The regions of one size, without it."""
    return regions.where(F.col("q_end") - F.col("q_start") == size).select("q_chrom", "q_start", "q_end")


def summary(regions: DataFrame, hits: DataFrame) -> DataFrame:
    """size, regions, hits: how many regions of each size there are, and how many loci they overlap. hits: regions joined to loci, with q_start and q_end."""
    size = (F.col("q_end") - F.col("q_start")).cast("long").alias("size")
    asked = regions.groupBy(size).agg(F.count("*").alias("regions"))
    found = hits.groupBy(size).agg(F.count("*").alias("hits"))
    return asked.join(found, "size", "left").select("size", "regions", F.coalesce("hits", F.lit(0)).alias("hits"))
