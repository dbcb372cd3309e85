"""An extra beyond the batch engine: collapse over a stream of BED files, kept up to date as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandmill.functions import scalar
from strandmill.operators import collapse
from strandmill.sources import bed


def collapsed_stream(spark: SparkSession, folder: str) -> DataFrame:
    """chrom, start, end, score over all files that come into the folder; run it in complete or update mode."""
    lines = spark.readStream.text(folder)
    data = lines.where(~scalar.is_header(lines["value"]) & (lines["value"] != ""))
    rows = bed.parsed6(bed.validated(bed.parsed3(data.withColumn("value", scalar.without_return(data["value"])))))
    return collapse.collapse(collapse.with_weight(rows))
