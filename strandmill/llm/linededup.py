"""Lines that many documents hold, kept in one document only; in DataFrame functions only.

A line's key is the line without white space at its ends, in lower case (A-Z). Keys of LEAST_CHARS characters or more that at least
LEAST_DOCS documents hold lose their lines, except in the document of the largest id.

Each line of a long enough key becomes a row of fixed width: 128 bits of the key, the document's id, 128 bits for the document's
row, the place of the line. The rows are written once, ranged by key and sorted within it by descending document and place; windows stream over that
order: the first document that occurs stays, later ones go as soon as a key has enough documents. What comes back for a document is
no text but a keep bitmap, run-length coded: the stretches (at, n) of lines that stay. `report` and `dedupe` apply it to the texts, which move
once, to meet their bitmaps.

A key that holds more than 1 / HOT of an average range's rows is settled without its rows coming together: rows are first joined by key and
document, as partial sums before any exchange, and the resulting table, at most HOT keys a range and counted before it is broadcast, marks the
rows where they lie. So a line of a third of all documents makes no hot task.

Defined cases: rows of one id are one document; a null id is an id, below all others; a null or empty text is one empty line; repeated rows get
equal results; a text is a row and has to fit one; an empty table gives an empty result; extra columns are not read and pass through
`dedupe`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm import textkit

LEAST_CHARS = 20
LEAST_DOCS = 3
RANGE_ROWS = 2_000_000
HOT = 8
SPACE = "".join(map(chr, (0x20, *range(0x09, 0x0E))))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY, DOC = ["key", "key2"], textkit.ROW_KEYS


def lines_of(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """lower() is A-Z to a-z alone where all characters are ASCII, and faster."""
    trimmed = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(trimmed)).otherwise(F.translate(trimmed, UPPER, LOWER))


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """key, key2, doc, row_key, row_key2, place, n_lines: a row for each line of a long enough key."""
    lines = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).withColumns(textkit.row_keys("doc", "text"))
    lines = lines.select("doc", *DOC, lines_of("text").alias("lines")).select("doc", *DOC, F.size("lines").alias("n_lines"), F.posexplode("lines").alias("place", "line"))
    lines = lines.select("doc", *DOC, "n_lines", "place", line_key(F.col("line")).alias("line")).where(F.char_length("line") >= least_chars)
    return lines.select(*[c.alias(n) for n, c in zip(KEY, textkit.row_keys("line").values(), strict=True)], "doc", *DOC, "place", "n_lines")


def dropped_lines(rows: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Those rows of line_rows, written beforehand, whose lines go."""
    total = rows.count()
    ranges = max(textkit.partitions(rows.sparkSession), -(-total // RANGE_ROWS))
    hot = textkit.cut(rows.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") * (HOT * ranges) > total).select(*KEY))
    crowded = not hot.isEmpty()
    cold = rows.join(textkit.small(hot), KEY, "left_anti") if crowded else rows
    latest = F.desc_nulls_last("doc")
    order = Window.partitionBy(*KEY).orderBy(latest)
    ranked = cold.repartitionByRange(ranges, *KEY).sortWithinPartitions(*KEY, latest, *DOC, "place").withColumn("nth", F.dense_rank().over(order)).withColumn("docs", F.max("nth").over(Window.partitionBy(*KEY)))
    dropped = ranked.where((F.col("docs") >= least_docs) & (F.col("nth") > 1)).select(*rows.columns)
    if crowded:
        rest = rows.join(textkit.small(hot), KEY)
        last = rest.select(*KEY, "doc").distinct().groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("doc").alias("last")).where(F.col("docs") >= least_docs)
        last = textkit.cut(last.select(*KEY, "last"))  # at most a row for each hot key
        dropped = dropped.unionByName(rest.join(textkit.small(last), KEY).where(~F.col("doc").eqNullSafe(F.col("last"))).select(*rows.columns))
    return dropped


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """row_key, row_key2, keep: for each document's row that loses lines the stretches array<struct<at, n>> of lines that stay, from 0."""
    rows = textkit.cut(line_rows(docs, id_col, text_col, least_chars))
    gone = dropped_lines(rows, least_docs).groupBy(*DOC).agg(F.sort_array(F.collect_set("place")).alias("gone"), F.max("n_lines").alias("n_lines"))
    at = F.concat(F.array(F.lit(0)), F.transform("gone", lambda p: p + 1))
    until = F.concat("gone", F.array("n_lines"))
    stretches = F.zip_with(at, until, lambda a, b: F.struct(a.alias("at"), (b - a).alias("n")))
    return gone.select(*DOC, F.filter(stretches, lambda s: s["n"] > 0).alias("keep"))


def _joined(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """rows (doc_id, text and others) with lines, keep and text as it is when the bitmap is applied, as kept."""
    met = rows.withColumns(textkit.row_keys("doc_id", "text")).join(bitmaps, DOC, "left").withColumn("lines", lines_of("text"))
    stay = F.flatten(F.transform("keep", lambda s: F.slice("lines", s["at"] + 1, s["n"])))
    return met.withColumn("kept", F.when(F.col("keep").isNull(), F.col("text")).otherwise(F.concat_ws("\n", stay)))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every document."""
    docs = docs.select("doc_id", "text")
    stay = F.aggregate("keep", F.lit(0), lambda n, s: n + s["n"])
    n = F.size("lines").cast("long")
    lost = F.when(F.col("keep").isNull(), F.lit(0)).otherwise(n - stay).cast("long")
    return _joined(docs, keep_bitmaps(docs)).select("doc_id", n.alias("n_lines"), lost.alias("n_dropped"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def dedupe(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs without the lines that go. Texts that lose none stay as they are, null ones too; n_chars (where there is one) follows the text."""
    opened = ("doc_id", "text")
    cleaned = _joined(textkit.sealed(docs, opened), keep_bitmaps(docs, least_chars=least_chars, least_docs=least_docs))
    cleaned = textkit.unsealed(cleaned.select("row", "doc_id", F.col("kept").alias("text")), docs.columns, opened)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned
