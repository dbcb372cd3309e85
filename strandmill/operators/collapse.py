"""Records that share a chromosome and a start become one, with the sum of their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions import scalar


def with_weight(records: DataFrame) -> DataFrame:
    """records with weight: the score as a number, 0 where the column is missing; a score without a number ends the job."""
    number = scalar.weight(F.col("score"))
    bad = F.raise_error(F.concat(F.lit("score is no number: "), F.col("value"))).cast("double")
    return records.withColumn("weight", F.when(F.col("score").isNull(), F.lit(0.0)).when(number.isNotNull(), number).otherwise(bad))


def collapse(records: DataFrame, weight: str = "weight") -> DataFrame:
    """chrom, start, end (start + 1), score: partial sums combine before the exchange, so a crowded start costs one row a task."""
    summed = records.groupBy("chrom", "start").agg(F.sum(weight).alias("score"))
    return summed.select("chrom", "start", (F.col("start") + 1).alias("end"), "score")


def rendered(collapsed: DataFrame) -> DataFrame:
    """value: collapsed records as six-column lines."""
    return collapsed.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), scalar.general_format(F.col("score").cast("double")), F.lit("+")).alias("value"))


def as_locus(collapsed: DataFrame) -> DataFrame:
    return collapsed.select(F.col("chrom").alias("Chromosome"), F.col("start").alias("Start"), F.col("end").alias("End"), F.col("score").cast("double").alias("Score"))
