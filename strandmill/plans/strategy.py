"""Ways to sort: the default plan, per chromosome, bounded memory with a spill codec, several passes without one big exchange."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import scalar
from strandmill.operators import derive, order
from strandmill.plans import storage
from strandmill.schema import BedError

CODECS = {"raw": ("lz4", "false"), "lz4": ("lz4", "true"), "zstd": ("zstd", "true")}
DEFAULT_BUDGET = 1 << 30
MOST_PASSES = 4  # over the input, however small the budget is beside it
MOST_RUNS = 1_000  # ranges beyond the session's own; the driver gets a sample of each to choose their bounds
MOST_BUCKETS = 100_000  # of a histogram that the driver plans passes from


def spill_settings(codec: str, tmpdir: str | None = None) -> dict[str, str]:
    """Session settings for shuffle and spill blocks; they count when the session starts."""
    if codec in ("rans0", "rans1"):
        warnings.warn(f"{codec} has no counterpart; zstd is used", stacklevel=2)
        codec = "zstd"
    if codec not in CODECS:
        raise BedError(f"the codec is one of {', '.join(CODECS)}, not {codec}")
    name, on = CODECS[codec]
    out = {"spark.io.compression.codec": name, "spark.shuffle.compress": on, "spark.shuffle.spill.compress": on}
    return out | ({"spark.local.dir": tmpdir} if tmpdir else {})


def per_chromosome(records: DataFrame, mode: str = "s", natural: bool = False) -> DataFrame:
    """Chromosomes in parallel, each sorted in place: ranges of (chromosome, start), so that long chromosomes are divided too."""
    return _in_ranges(records, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), mode, natural)


def external(records: DataFrame, budget: int = DEFAULT_BUDGET, mode: str = "s", natural: bool = False) -> DataFrame:
    """Sorted runs of at most about the budget each: as many ranges as the lines and their overheads need. A range that outgrows the memory
    a task gets all the same spills under the codec of spill_settings and is merged from disk. Beyond MOST_RUNS the runs grow instead of their number, as the
    driver gets a sample of each."""
    spark = records.sparkSession
    size = records.agg(F.sum(F.octet_length("value") + 1 + derive.RECORD_OVERHEAD)).first()[0] or 0
    return _in_ranges(records, max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-size // budget), MOST_RUNS)), mode, natural)


def _in_ranges(records: DataFrame, n: int, mode: str, natural: bool) -> DataFrame:
    records, keys = order.keyed(records, mode, natural)
    return records.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(order.RANK)


def multi_pass(records: DataFrame, budget: int = DEFAULT_BUDGET, shift: int = scalar.BUCKET_SHIFT) -> Iterator[DataFrame]:
    """Ordered pieces of the default order, one pass over the input each: a histogram plans stretches of buckets, and each pass reads the input with
    all tasks, keeps its stretch and sorts it by range, so that no exchange holds more than a stretch.

    A stretch fits the budget, or an equal share of MOST_PASSES where the budget would ask for more of them: else the work would grow with the
    square of the input. What a task sorts of such a stretch keeps to the budget. The planner's buckets widen with the positions that they cover.
    """
    counts = storage.cut(derive.position_histogram(records, shift))
    while counts.count() > MOST_BUCKETS and shift < 31:
        shift += 4
        counts = storage.cut(counts.groupBy("chrom", F.shiftright("bucket", 4).alias("bucket")).agg(F.sum("records").alias("records"), F.sum("bytes").alias("bytes")))
    histogram = [tuple(r) for r in counts.orderBy("chrom", "bucket").collect()]
    size = sum(r[3] + derive.RECORD_OVERHEAD * r[2] for r in histogram)
    share = max(budget, -(-size // MOST_PASSES))
    tasks = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-share // budget), MOST_RUNS))
    for a, b in derive.plan_passes(histogram, share):
        low, high = histogram[a][:2], histogram[b][:2] if b < len(histogram) else None
        inside = records.where(derive.in_bucket_range(F.col("chrom"), scalar.bucket(F.col("start"), shift), low, high))
        yield order.sort_records(inside) if share == budget else _in_ranges(inside, tasks, "s", False)


def session(threads: int = 0, settings: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("strandmill").master(f"local[{threads or '*'}]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    return builder.config(map=settings or {}).getOrCreate()
