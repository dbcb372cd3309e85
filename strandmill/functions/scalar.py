"""Scalar functions as column expressions, and the few that belong on the driver."""

from __future__ import annotations

import re
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER_STARTS = ("#", "track ", "browser ")  # fixed values
BUCKET_SHIFT = 20


def natural_key(chrom: Column) -> Column:
    """A string that orders names with digit runs by number: each run becomes 0, its length and its digits, leading zeros
    gone. A byte that isn't a digit is below 0 or above 9, so runs and other text never mix. Names that differ in leading
    zeros only tie; order by the name next."""
    bare = lambda t: F.regexp_replace(t, "^0+(?=[0-9])", "")
    one = lambda t: F.when(t.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(bare(t)).cast("string"), 4, "0"), bare(t))).otherwise(t)
    return F.array_join(F.transform(F.regexp_extract_all(chrom, F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), one), "")


def five_prime(start: Column, end: Column, strand: Column) -> Column:
    """Where the record's strand begins: the end on the minus strand, the start otherwise."""
    return F.when(strand == "-", end).otherwise(start)


def bucket(position: Column, shift: int = BUCKET_SHIFT) -> Column:
    return F.shiftright(position, shift)


def is_header(line: Column) -> Column:
    found = F.lit(False)
    for s in HEADER_STARTS:
        found = found | line.startswith(s)
    return found


def without_return(line: Column) -> Column:
    """The line without one carriage return at its end."""
    return F.when(line.endswith("\r"), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)


def all_digits(text: Column) -> Column:
    """Whether the text is a decimal number below 2^31 of digits alone: it begins and ends with a digit, and as a whole it is an integer."""
    digit = lambda c: (c >= "0") & (c < ":")
    return digit(text) & digit(F.right(text, F.lit(1))) & text.try_cast("int").isNotNull()


def unsigned(text: Column) -> Column:
    """Decimal digits as INT; null for anything else, a sign included, and for what doesn't fit."""
    return F.when(all_digits(text), text).try_cast("int")


def int32_strict(text: Column) -> Column:
    """An optional minus sign and digits as INT; null for anything else and for what doesn't fit."""
    return F.when(text.rlike("^-?[0-9]+$"), text).try_cast("int")


def weight(text: Column) -> Column:
    """The number that the text begins with, rounded to single precision, as DOUBLE; null where there is none."""
    number = F.regexp_extract(text, r"^[ \t]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?(?i:infinity|inf|nan))", 1)
    return F.when(number != "", number).try_cast("float").cast("double")


def tail_fields(tail: Column) -> Column:
    """The tab-separated fields of a tail that has lost its leading separator; none for an empty tail."""
    return F.when(tail == "", F.array().cast("array<string>")).otherwise(F.split(tail, "\t", -1))


@F.pandas_udf(T.StringType())
def general_format(x: pd.Series) -> pd.Series:
    """Six significant digits in C's %g form, off the hot path: rendering only."""
    return x.map(lambda v: "%g" % v)


def memory_size(text: str) -> int:
    """Bytes of 4G, 500M, 1024K or a plain number; 0 if malformed."""
    found = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)([KMGkmg]?)[bB]?", text.strip())
    return int(float(found[1]) * 1024 ** " KMG".index(found[2].upper() or " ")) if found else 0


def now_utc() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")
