"""BED text as DataFrames: scan, header split, parsing, flavors."""

from __future__ import annotations

import contextlib
import os
import shutil
import sys
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill import schema
from strandmill.functions import scalar
from strandmill.plans import storage
from strandmill.schema import BedError
from strandmill.sources import bgzf, ordered

MOST_SCORE_BYTES = 255


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, line_id: the lines of one file, a carriage return at their end removed. Ids ascend in the file's order.

    Compression goes by suffix. Blocked gzip is read by ranges of bytes; a plain gzip stream is one split, so callers that sort lose
    nothing by it: the range exchange deals its rows out again.
    """
    if path.endswith((".gz", ".bgz")) and ordered.first_bytes(spark, path, 18)[12:14] == b"BC" and ordered.arrow_opens(path):
        return bgzf.read_lines(spark, path)
    raw = spark.read.text(path, lineSep="\n")
    return raw.select(scalar.without_return(F.col("value")).alias("value"), F.monotonically_increasing_id().alias("line_id"))


@contextlib.contextmanager
def spooled_stdin(spark: SparkSession):
    """Standard input as a file while the block runs. A pipe ends at the driver, so this is for local mode only."""
    if not storage.is_local(spark):
        raise BedError("standard input is read in local mode only; put the file where the cluster can read it")
    with tempfile.TemporaryDirectory(prefix="spool") as folder:
        path = os.path.join(folder, "stdin.bed")
        with open(path, "wb") as out:
            shutil.copyfileobj(sys.stdin.buffer, out)
        yield path


def split_header(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(header, data): the header lines before the first record, and all other lines but blank ones.

    A header line after a record stays with the data, where it is malformed.
    """
    first = numbered.where((F.col("value") != "") & ~scalar.is_header(F.col("value"))).select("line_id").first()
    marked = numbered.withColumn("first", F.lit(first["line_id"] if first else None).cast("long"))
    leading = scalar.is_header(F.col("value")) & (F.col("first").isNull() | (F.col("line_id") < F.col("first")))
    return marked.where(leading).drop("first"), marked.where(~leading & (F.col("value") != "")).drop("first")


def parsed3(data: DataFrame) -> DataFrame:
    """data with chrom, start, end, tail (with its leading separator); null positions where the line is malformed.

    A name without white space, a separator (one tab or space), digits, a separator, digits; the tail is all that follows. The fields are cut by
    byte searches; a pattern looks only at a third field that isn't all digits.
    """
    line = F.when(F.contains("value", F.lit(" ")), F.translate("value", " ", "\t")).otherwise(F.col("value"))
    cut = data.withColumn("__line", line).withColumn("chrom", F.substring_index("__line", "\t", 1))
    cut = cut.withColumn("__start", F.substring_index(F.substring_index("__line", "\t", 2), "\t", -1))
    cut = cut.withColumn("__rest", F.substring("__line", F.length("chrom") + F.length("__start") + 3, F.lit(1 << 30)))
    third = F.substring_index("__rest", "\t", 1)
    cut = cut.withColumn("__end", F.when(scalar.all_digits(third), third).otherwise(F.regexp_extract("__rest", "^[0-9]+", 0)))
    fine = (F.col("chrom") != "") & ~F.contains("chrom", F.lit("\r"))
    used = F.length("chrom") + F.length("__start") + F.length("__end") + 3
    return cut.withColumns({"start": F.when(fine, scalar.unsigned(F.col("__start"))), "end": F.col("__end").try_cast("int"), "tail": F.substring("value", used, F.lit(1 << 30))}).drop("__line", "__start", "__rest", "__end")


def is_well_formed() -> Column:
    return (F.col("chrom") != "") & F.col("start").isNotNull() & F.col("end").isNotNull()


def validated(rows: DataFrame, on_error: str = "fail") -> DataFrame:
    """Rows of parsed3 whose three columns parse. fail: a malformed line ends the job, which names it; drop: it goes."""
    if on_error == "drop":
        return rows.where(is_well_formed())
    if on_error != "fail":
        raise BedError(f"on_error is fail or drop, not {on_error}")
    # Checked in the start column, so that no plan that needs the row can skip it.
    checked = F.when(is_well_formed(), F.col("start")).otherwise(F.raise_error(F.concat(F.lit("malformed record (needs chromosome, start and end, unsigned and below 2^31): "), F.col("value"))).cast("int"))
    return rows.withColumn("start", checked)


def body(value: Column, tail: Column) -> Column:
    """The tail without its leading separator; separated by tabs, also where the line uses single spaces only."""
    own = F.substring(tail, 2, 1 << 30)
    return F.when(F.contains(value, F.lit("\t")), own).otherwise(F.translate(own, " ", "\t"))


def with_fields(rows: DataFrame) -> DataFrame:
    """rows with fields, the columns after the third."""
    return rows.withColumn("fields", scalar.tail_fields(body(F.col("value"), F.col("tail"))))


def parsed6(rows: DataFrame) -> DataFrame:
    """rows with name, score (null where the column is missing), strand (first character, + where missing)."""
    at = lambda i: F.get("fields", F.lit(i))
    score = F.when(F.octet_length(at(1)) > MOST_SCORE_BYTES, F.raise_error(F.concat(F.lit("score of more than 255 bytes: "), F.col("value"))).cast("string")).otherwise(at(1))
    strand = F.coalesce(F.when(at(2) != "", F.substring(at(2), 1, 1)), F.lit("+"))
    return with_fields(rows).withColumns({"name": at(0), "score": score, "strand": strand})


def read_bed(spark: SparkSession, path: str, on_error: str = "fail") -> tuple[list[str], DataFrame]:
    """(header lines, records): records have value (the line as it stands), chrom, start, end, name, score, strand, fields."""
    header, data = split_header(lines(spark, path))
    return [r["value"] for r in header.orderBy("line_id").collect()], parsed6(validated(parsed3(data), on_error))


def detect_flavor(records: DataFrame) -> str:
    """The one flavor of all records, by one aggregation over the number of columns; BED3 for none."""
    n = F.size("fields") + 3
    found = records.agg(F.min(n).alias("low"), F.max(n).alias("high")).first()
    if found["low"] is None:
        return "BED3"
    low, high = schema.flavor_of(found["low"]), schema.flavor_of(found["high"])
    if low != high or (low != "BED_PLUS" and found["low"] != found["high"]):
        raise BedError(f"records of {found['low']} and of {found['high']} columns do not mix")
    if low == "BED_PLUS" and found["low"] < 12 < found["high"]:
        mixed = records.where(n == 12).limit(1).count()
        if mixed:
            raise BedError("records of 12 columns and records of other column counts do not mix")
    return low


def typed(records: DataFrame, flavor: str) -> DataFrame:
    """The flavor's columns without the derived one; integers of 12-column records are checked."""
    at = lambda i: F.get("fields", F.lit(i))
    place = {"Name": 0, "Score": 1, "Strand": 2, "ThickStart": 3, "ThickEnd": 4, "ItemRgb": 5, "BlockCount": 6, "BlockSizes": 7, "BlockStarts": 8}
    columns = [F.col("chrom").alias("Chromosome"), F.col("start").alias("Start"), F.col("end").alias("End")]
    for name in schema.PAYLOAD[flavor]:
        if name == "Tail":
            column = F.array_join("fields", "\t")
        elif name in schema.INTEGER_COLUMNS:
            number = scalar.int32_strict(at(place[name]))
            column = F.when(number.isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit(f"{name} is no 32-bit integer: "), F.col("value"))).cast("int"))
        else:
            column = at(place[name])
        columns.append(column.alias(name))
    return records.select(*columns)


def rendered(records: DataFrame) -> DataFrame:
    """value: the line made anew from chrom, start, end and the tail."""
    return records.select(F.concat(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string")), F.col("tail")).alias("value"))
