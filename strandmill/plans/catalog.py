"""Named queries over the star-schema tables, and their SQL twins.

Two locus views stand in for BED input: L over lineitem (many ties on purpose) and E over events (long, nested intervals).
Orderings expose their rank as rn, so that a comparison that ignores row order still sees them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import scalar
from strandmill.operators import collapse, derive, intervals, order, region
from strandmill.plans import storage, strategy
from strandmill.sources import bed, locus_parquet, workload
from strandmill.sources import text as bed_text

SHIFT = 12  # the views' coordinates are small
PASS_BUDGET = 3_000_000
INDEX_ROWS = 1_000  # of a block of the index; the views are small
WORKLOAD = ((100, 333), (1_000, 333), (10_000, 334))  # regions of sizes that fit the views
REGION = ("chr2", 4_000, 5_000)
E_REGION = ("click", 2_000, 4_000)
REGIONS = [(c, s, s + w) for c in ("chr1", "chr2", "chr10", "chr20") for s, w in ((0, 1_000), (4_000, 1_000), (50_000, 300))]

L_SQL = """select 'chr' || cast(l_suppkey % 24 + 1 as varchar) as chrom, cast(l_partkey * 50 as integer) as start_,
 cast(l_partkey * 50 + l_quantity as integer) as end_, 'o' || cast(l_orderkey as varchar) || '_' || cast(l_linenumber as varchar) as name,
 cast(l_extendedprice as decimal(18,2)) as score, case l_returnflag when 'R' then '-' when 'A' then '+' else '.' end as strand from lineitem"""
E_SQL = """select event_type as chrom, cast(event_id as integer) as start_, cast(event_id + user_id + 1 as integer) as end_,
 cast(event_id as varchar) as name, cast(value as decimal(18,2)) as score, '+' as strand from events"""
NATURAL_SQL = r"""array_to_string(list_transform(regexp_extract_all(chrom,'[0-9]+|[^0-9]+'), lambda t: case when regexp_matches(t,'^[0-9]')
 then concat('0',lpad(cast(length(regexp_replace(t,'^0+([0-9])','\1')) as varchar),4,'0'),regexp_replace(t,'^0+([0-9])','\1')) else t end),'')"""


def view_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, start, end, name, score, strand, value (the record as a line) and fields over lineitem."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return _as_records(
        t.select(
            F.concat(F.lit("chr"), (F.col("l_suppkey") % 24 + 1).cast("string")).alias("chrom"),
            (F.col("l_partkey") * 50).cast("int").alias("start"),
            (F.col("l_partkey") * 50 + F.col("l_quantity")).cast("int").alias("end"),
            F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("name"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("score"),
            F.when(F.col("l_returnflag") == "R", "-").when(F.col("l_returnflag") == "A", "+").otherwise(".").alias("strand"),
        )
    )


def view_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _as_records(
        t.select(
            F.col("event_type").alias("chrom"),
            F.col("event_id").cast("int").alias("start"),
            (F.col("event_id") + F.col("user_id") + 1).cast("int").alias("end"),
            F.col("event_id").cast("string").alias("name"),
            F.col("value").cast("decimal(18,2)").alias("score"),
            F.lit("+").alias("strand"),
        )
    )


def _as_records(v: DataFrame) -> DataFrame:
    text = [F.col(c).cast("string") for c in ("chrom", "start", "end", "name", "score", "strand")]
    return v.withColumns({"value": F.concat_ws("\t", *text), "fields": F.array(*text[3:])})


def _loci(v: DataFrame) -> DataFrame:
    """The view with the dataset's column names."""
    return v.select(F.col("chrom").alias("Chromosome"), F.col("start").alias("Start"), F.col("end").alias("End"), F.col("strand").alias("Strand"), F.col("name").alias("Name"), F.col("score").cast("string").alias("Score"))


def _plain(df: DataFrame) -> DataFrame:
    """Names that need no quoting in SQL."""
    return df.withColumnsRenamed({"start": "start_", "end": "end_"})


TIES = ["start", "end", "name", "score", "strand"]
_TIES_SQL = "start_, end_, name, score, strand"
_kept: dict[tuple, str] = {}


def _once(spark, sf_dir: str, name: str, write) -> str:
    """The folder in which write(folder) left something made from sf_dir, once a session: queries over stored data start from there."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        folder = storage.new_folder(spark, name)
        write(folder)
        _kept[key] = folder
    return _kept[key]


def _dataset(spark, sf_dir, view=view_l):
    """A stored dataset of the view, in ordered parts, as its reader sees it."""
    return locus_parquet.read_locus(spark, _dataset_folder(spark, sf_dir, view))


def _dataset_folder(spark, sf_dir, view=view_l) -> str:
    return _once(spark, sf_dir, view.__name__, lambda f: locus_parquet.write_locus_parts(_loci(view(spark, sf_dir)), f))


def _lines_file(spark, sf_dir) -> str:
    """One text file with the lines of L below three header lines; all tasks write it."""
    head = ["# made", "track name=l", "browser position chr1"]
    return _once(spark, sf_dir, "lines", lambda path: bed_text.write_shared(view_l(spark, sf_dir), path, head))


def _parsed_lines(spark, sf_dir):
    """The lines of L, parsed again as a scan would."""
    return bed.validated(bed.parsed3(view_l(spark, sf_dir).select("value")))


def _rank(mode: str, natural: bool = False):
    """Records with the place at which the sort puts them."""

    def run(spark, sf_dir):
        out = order.numbered(order.sort_records(view_l(spark, sf_dir), mode, natural))
        return _plain(out.select("chrom", "start", "end", "name", "score", "strand", "rn"))

    return run


def scan_bed(spark, sf_dir):
    _, rows = bed.read_bed(spark, _lines_file(spark, sf_dir))
    return _plain(rows.select("chrom", "start", "end", "name", F.col("score").cast("decimal(18,2)").alias("score"), "strand"))


def header_split(spark, sf_dir):
    head = spark.createDataFrame([(0, "# made"), (1, "track name=l"), (2, "browser position chr1")], "line_id bigint, value string")
    body = view_l(spark, sf_dir).select((F.monotonically_increasing_id() + 10).alias("line_id"), "value")
    header, data = bed.split_header(head.union(body))
    return header.select(F.lit("header").alias("part"), "value").union(data.select(F.lit("data").alias("part"), "value"))


def empty_scan(spark, sf_dir):
    return bed.validated(bed.parsed3(view_l(spark, sf_dir).where(F.lit(False)).select("value"))).groupBy().agg(F.count("*").alias("n"))


def parse_bed3(spark, sf_dir):
    return _plain(_parsed_lines(spark, sf_dir).select("chrom", "start", "end", "tail"))


def parse_bed6(spark, sf_dir):
    return bed.parsed6(_parsed_lines(spark, sf_dir)).select("name", F.col("score").alias("score_text"), "strand", scalar.weight(F.col("score")).alias("weight"))


def _texts(spark, sf_dir):
    """Number-like and other texts, made from lineitem."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.col("l_orderkey").cast("string")
    kind = F.col("l_linenumber") % 6
    text = F.when(kind == 0, key).when(kind == 1, F.concat(F.lit("-"), key)).when(kind == 2, F.concat(key, F.lit("x"))).when(kind == 3, F.concat(F.lit("00"), key)).when(kind == 4, F.concat(F.lit("99999999"), key)).otherwise(F.lit(""))
    return t.select(text.alias("text"))


_TEXTS_SQL = """select case l_linenumber % 6 when 0 then k when 1 then '-' || k when 2 then k || 'x' when 3 then '00' || k when 4 then '99999999' || k else '' end as text
 from (select l_linenumber, cast(l_orderkey as varchar) as k from lineitem)"""


def parse_uint(spark, sf_dir):
    return _texts(spark, sf_dir).select("text", scalar.unsigned(F.col("text")).alias("number"))


def parse_int32_strict(spark, sf_dir):
    return _texts(spark, sf_dir).select("text", scalar.int32_strict(F.col("text")).alias("number"))


def validate_rows(spark, sf_dir):
    lines = _texts(spark, sf_dir).select(F.concat(F.lit("chr1\t"), F.col("text"), F.lit("\t2000000000\tx")).alias("value"))
    kept = bed.validated(bed.parsed3(lines), on_error="drop")
    return _plain(kept.select("chrom", "start", "end", "tail"))


def tail_field_count(spark, sf_dir):
    rows = bed.with_fields(_parsed_lines(spark, sf_dir))
    return rows.groupBy(F.size("fields").alias("fields_")).agg(F.count("*").alias("records"))


def tail_split(spark, sf_dir):
    rows = bed.with_fields(_parsed_lines(spark, sf_dir))
    return rows.select(F.get("fields", F.lit(0)).alias("f1"), F.get("fields", F.lit(1)).alias("f2"), F.get("fields", F.lit(2)).alias("f3"), F.get("fields", F.lit(3)).alias("f4"))


def flavor_detect(spark, sf_dir):
    rows = bed.with_fields(_parsed_lines(spark, sf_dir))
    n = F.size("fields") + 3
    flavor = F.when(n == 3, "BED3").when(n == 4, "BED4").when(n == 5, "BED5").when(n == 6, "BED6").when(n == 12, "BED12").otherwise("BED_PLUS")
    assert bed.detect_flavor(rows) == "BED6"
    return rows.groupBy(flavor.alias("flavor")).agg(F.count("*").alias("records"))


def flavor_bed6(spark, sf_dir):
    return bed.typed(bed.with_fields(_parsed_lines(spark, sf_dir)), "BED6").withColumnsRenamed({"Start": "Start_", "End": "End_"})


def flavor_bed12(spark, sf_dir):
    v = view_l(spark, sf_dir)
    more = [F.col("start").cast("string"), F.col("end").cast("string"), F.lit("0,0,255"), F.lit("1"), (F.col("end") - F.col("start")).cast("string"), F.lit("0")]
    lines = v.select(F.concat_ws("\t", "value", *more).alias("value"))
    return bed.typed(bed.with_fields(bed.validated(bed.parsed3(lines))), "BED12").withColumnsRenamed({"Start": "Start_", "End": "End_"})


def render_bed(spark, sf_dir):
    return bed.rendered(_parsed_lines(spark, sf_dir))


def _collapsed(spark, sf_dir):
    return collapse.collapse(collapse.with_weight(bed.parsed6(_parsed_lines(spark, sf_dir))))


def collapse_query(spark, sf_dir):
    return _plain(_collapsed(spark, sf_dir))


def collapse_render(spark, sf_dir):
    return collapse.rendered(_collapsed(spark, sf_dir))


def collapse_locus(spark, sf_dir):
    """Collapsed records with the running maximum, sorted once: one pass over the ranges finds it."""
    rows = collapse.as_locus(_collapsed(spark, sf_dir))
    return derive.max_end_in_order(rows.orderBy("Chromosome", "Start", "End")).withColumnsRenamed({"Start": "Start_", "End": "End_"})


def locus_parquet_rows(spark, sf_dir):
    """The dataset's rows with the place at which the writer puts them."""
    rows = order.numbered(locus_parquet.table_rows(_loci(view_l(spark, sf_dir))))
    return rows.withColumnsRenamed({"Start": "Start_", "End": "End_"})


def read_locus(spark, sf_dir):
    """The rows of a stored dataset."""
    return _dataset(spark, sf_dir, view_e).withColumnsRenamed({"Start": "Start_", "End": "End_"})


def max_end_so_far(spark, sf_dir):
    return derive.max_end_so_far(_loci(view_e(spark, sf_dir)), shift=SHIFT).select("Chromosome", F.col("Start").alias("Start_"), F.col("End").alias("End_"), "MaxEndSoFar")


def manifest_chrom_stats(spark, sf_dir):
    return derive.chromosome_stats(_loci(view_l(spark, sf_dir)))


def interval_index(spark, sf_dir):
    return derive.interval_index(_loci(view_e(spark, sf_dir)), shift=SHIFT)


def index_lookup(spark, sf_dir):
    """Rows of a region by a stored index in blocks; only the blocks that the directory names are read."""

    def write(folder):
        derive.blocked_index(_dataset(spark, sf_dir, view_e), block_rows=INDEX_ROWS).write.parquet(folder)

    return region.blocked_lookup(spark.read.parquet(_once(spark, sf_dir, "index", write)), *E_REGION)


def index_directory(spark, sf_dir):
    """The directory of the index in blocks."""
    index = derive.blocked_index(_loci(view_l(spark, sf_dir)), block_rows=INDEX_ROWS)
    return index.select("chromosome", "block", "first_start", "last_start", "most_end", "first_row", "rows")


def overlap_join(spark, sf_dir):
    """Forward records and longer stretches that they overlap, neither side broadcast."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber = 7")
    low = (F.col("l_partkey") * 50).cast("int")
    regions = t.select(F.concat(F.lit("chr"), (F.col("l_suppkey") % 24 + 1).cast("string")).alias("q_chrom"), low.alias("q_start"), (low + F.col("l_orderkey") % 20_000).cast("int").alias("q_end"))
    return _stretches(region.overlap_join(_by_strand(spark, sf_dir, "+", "name"), regions))


def region_overlap(spark, sf_dir):
    """The stored records that overlap one region; all clauses reach the scan."""
    return region.region(_dataset(spark, sf_dir), *REGION).withColumnsRenamed({"Start": "Start_", "End": "End_"})


def _overlaps(joined: DataFrame) -> DataFrame:
    return joined.select("Chromosome", F.col("Start").alias("Start_"), F.col("End").alias("End_"), "Name", "q_start", "q_end")


def region_overlap_batch(spark, sf_dir):
    regions = spark.createDataFrame(REGIONS, "q_chrom string, q_start int, q_end int")
    return _overlaps(locus_parquet.read_regions(spark, _dataset_folder(spark, sf_dir), regions))


def region_overlap_binned(spark, sf_dir):
    """The same join as a large set of regions takes it: by bins."""
    regions = spark.createDataFrame(REGIONS, "q_chrom string, q_start int, q_end int")
    return _overlaps(region.overlap_join(_dataset(spark, sf_dir), regions))


def _sizes(spark, sf_dir):
    """Chromosomes and their lengths, as a manifest has them."""
    return view_l(spark, sf_dir).groupBy(F.col("chrom").alias("name")).agg(F.max("end").cast("long").alias("length"))


def workload_scan(spark, sf_dir):
    """Regions read from lines, of which every seventh lacks a field."""
    v = view_l(spark, sf_dir)
    fields = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"))
    short = F.concat_ws("\t", "chrom", F.col("start").cast("string"))
    return workload.parsed(v.select(F.when(F.col("start") % 7 == 0, short).otherwise(F.concat_ws("\t", fields, "name")).alias("value")))


def workload_drawn(spark, sf_dir):
    return workload.drawn(_sizes(spark, sf_dir), 42, WORKLOAD)


def workload_buckets(spark, sf_dir):
    """Regions and overlapping records by size of region, against a stored dataset."""
    regions = workload.drawn(_sizes(spark, sf_dir), 42, WORKLOAD).select("q_chrom", "q_start", "q_end")
    return workload.summary(regions, locus_parquet.read_regions(spark, _dataset_folder(spark, sf_dir), regions))


def position_histogram(spark, sf_dir):
    return derive.position_histogram(view_l(spark, sf_dir), SHIFT)


def bucket_filter(spark, sf_dir):
    v = view_l(spark, sf_dir)
    inside = derive.in_bucket_range(F.col("chrom"), scalar.bucket(F.col("start"), SHIFT), ("chr10", 5), ("chr14", 3))
    return _plain(v.where(inside).select("chrom", "start", "end", "name"))


def chrom_rank_join(spark, sf_dir):
    """Records with the rank of their chromosome in natural order, from the small table of chromosomes."""
    v = view_l(spark, sf_dir)
    ranks = order.name_ranks(v).select("chrom", F.col("rank").cast("long").alias("chrom_rank"))
    return _plain(v.join(ranks, "chrom").groupBy("chrom", "chrom_rank").agg(F.count("*").alias("records"), F.min("start").alias("min_start")))


def row_count(spark, sf_dir):
    return view_l(spark, sf_dir).groupBy().agg(F.count("*").alias("n"))


def distinct_chroms(spark, sf_dir):
    return view_l(spark, sf_dir).select("chrom").distinct()


def row_id(spark, sf_dir):
    out = order.ranked(view_l(spark, sf_dir), "chrom", *TIES)
    return _plain(out.select("chrom", "start", "end", "name", (F.col("rn") - 1).alias("row_id")))


def run_boundaries(spark, sf_dir):
    """Where a run of one chromosome begins, in two orders: by chromosome, with a run each, and by start, with many."""
    v = view_l(spark, sf_dir).select("chrom", *TIES)
    found = [derive.run_boundaries(v.orderBy(*by)).where("new_run").select(F.lit(name).alias("stored"), "chrom", "start", "end", "name", "rn") for name, by in (("chrom", ("chrom", *TIES)), ("start", (*TIES, "chrom")))]
    return _plain(found[0].unionByName(found[1]))


def sort_per_chrom(spark, sf_dir):
    """The places that the per-chromosome plan gives, with natural order of names."""
    out = order.numbered(strategy.per_chromosome(view_l(spark, sf_dir), natural=True))
    return _plain(out.select("chrom", "start", "end", "name", "rn"))


def sort_external(spark, sf_dir):
    """The places that runs of at most 1 MB give, sorted by start and end."""
    out = strategy.external(view_l(spark, sf_dir), 1_000_000, "b")
    return _plain(order.numbered(out.select("chrom", "start", "end", "name")))


def sort_multipass(spark, sf_dir):
    """The places that the passes of a budget give, one pass after the other."""
    out, before = None, 0
    for piece in strategy.multi_pass(view_l(spark, sf_dir), PASS_BUDGET, SHIFT):
        own = order.numbered(piece.select("chrom", "start", "end", "name")).withColumn("rn", F.col("rn") + before)
        before += own.count()
        out = own if out is None else out.unionByName(own)
    return _plain(out)


def sort_bam_key(spark, sf_dir):
    """Alignments made from lineitem: some without a reference, some without a position."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tid = F.when(F.col("l_linenumber") == 7, -1).otherwise((F.col("l_suppkey") % 24).cast("int"))
    pos = F.when(F.col("l_quantity") == 50, -1).otherwise((F.col("l_partkey") * 50).cast("int"))
    a = t.select(tid.alias("tid"), pos.alias("pos"), "l_orderkey", "l_linenumber", "l_extendedprice")
    no_tid, t_, no_pos, p = order.bam_keys(F.col("tid"), F.col("pos"))
    out = order.ranked(a, no_tid, t_, no_pos, p, "l_orderkey", "l_linenumber", "l_extendedprice")
    return out.select("tid", "pos", "l_orderkey", "l_linenumber", "rn")


def union_runs(spark, sf_dir):
    """Runs joined as they are, and the union of their chromosome dictionaries."""
    l, e = view_l(spark, sf_dir), view_e(spark, sf_dir)
    both = l.select("chrom", "start").unionByName(e.select("chrom", "start"))
    return both.groupBy("chrom").agg(F.count("*").alias("records"))


def _by_strand(spark, sf_dir, strand: str, *more: str):
    return view_l(spark, sf_dir).where(F.col("strand") == strand).select(F.col("chrom").alias("Chromosome"), F.col("start").alias("Start"), F.col("end").alias("End"), *more)


def _stretches(found: DataFrame) -> DataFrame:
    return found.withColumnsRenamed({"Start": "Start_", "End": "End_"})


def merge_records(spark, sf_dir):
    """Islands of records at most 3 apart."""
    return _stretches(intervals.merged(_loci(view_l(spark, sf_dir)), 3))


def coverage_depth(spark, sf_dir):
    return _stretches(intervals.coverage(_loci(view_e(spark, sf_dir))))


def subtract_records(spark, sf_dir):
    """What forward records cover and reverse ones don't."""
    return _stretches(intervals.subtracted(_by_strand(spark, sf_dir, "+"), _by_strand(spark, sf_dir, "-")))


def intersect_records(spark, sf_dir):
    return _stretches(intervals.intersected(_by_strand(spark, sf_dir, "+"), _by_strand(spark, sf_dir, "-")))


def complement_records(spark, sf_dir):
    """What no record covers, up to the end of each chromosome."""
    return _stretches(intervals.complement(_loci(view_l(spark, sf_dir)), _sizes(spark, sf_dir)))


def closest_record(spark, sf_dir):
    """For each forward record the nearest reverse one."""
    return intervals.closest(_by_strand(spark, sf_dir, "+", "name"), _by_strand(spark, sf_dir, "-", "name")).withColumnsRenamed({"Start": "Start_", "End": "End_"})


def latency_summary(spark, sf_dir):
    """Count, total, median and 99th percentile by kind: the benchmark's summary, over events."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.col("user_id").cast("double").alias("x"))
    return t.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.percentile("x", 0.5).alias("median"), F.percentile("x", 0.99).alias("p99"))


def latency_sketch(spark, sf_dir):
    """The same quantiles by merged sketches: whether their ranks keep to the bound of one in a thousand."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.col("user_id").cast("double").alias("x"))
    off = derive.quantile_errors(t, "event_type", "x", [0.5, 0.99], 1000)
    return off.select("event_type", "n", (F.col("off0") <= F.col("n") / 1000 + 1).alias("median_within"), (F.col("off1") <= F.col("n") / 1000 + 1).alias("p99_within"))


def order_check(spark, sf_dir):
    """How often a record comes after a greater one: never in the plans' results, often in the order of names."""
    v = view_l(spark, sf_dir)
    plans = {"default": order.sort_records(v), "per_chromosome": strategy.per_chromosome(v), "external": strategy.external(v, 1_000_000), "by_name": v.orderBy("name", "value")}
    out = None
    for name, rows in plans.items():
        own = order.inversions(rows, "chrom", "start", "value").select(F.lit(name).alias("plan"), "inversions")
        out = own if out is None else out.unionByName(own)
    return out


def queries():
    named = [
        scan_bed, header_split, empty_scan, parse_bed3, parse_bed6, parse_uint, parse_int32_strict, validate_rows, tail_field_count, tail_split, flavor_detect, flavor_bed6, flavor_bed12,
        render_bed, collapse_render, collapse_locus, locus_parquet_rows, read_locus, max_end_so_far, manifest_chrom_stats, interval_index, index_lookup, region_overlap, region_overlap_batch,
        region_overlap_binned, workload_scan, workload_drawn, workload_buckets, position_histogram, bucket_filter, chrom_rank_join, row_count, distinct_chroms, row_id, run_boundaries, sort_per_chrom, sort_external, sort_multipass, sort_bam_key, union_runs,
        latency_summary, order_check, merge_records, coverage_depth, subtract_records, intersect_records, complement_records, closest_record, overlap_join, index_directory, latency_sketch,
    ]
    found = {f.__name__: f for f in named}
    return found | {"collapse": collapse_query, "sort_start": _rank("s"), "sort_start_end": _rank("b"), "sort_five_prime": _rank("5"), "sort_natural": _rank("s", natural=True)}


def _ranked_sql(keys: str, columns: str = "chrom, start_, end_, name, score, strand", table: str = L_SQL) -> str:
    return f"with l as ({table}) select {columns}, row_number() over (order by {keys}) as rn from l"


_RUNNING = "max({end}) over (partition by {chrom} order by {keys} rows between unbounded preceding and current row)"
_LINE_SQL = "concat_ws(chr(9), chrom, cast(start_ as varchar), cast(end_ as varchar), name, cast(score as varchar), strand)"


def _stored_sql(table: str, ties: str, more: str = "") -> str:
    running = _RUNNING.format(end="end_", chrom="chrom", keys=f"start_, end_, {ties}")
    return f'select chrom as "Chromosome", start_ as "Start_", end_ as "End_", strand as "Strand", name as "Name", cast(score as varchar) as "Score", {running} as "MaxEndSoFar"{more} from ({table})'


def _luck_sql(salt: str) -> str:
    return f"cast(concat('0x', substr(md5(concat('42 {salt} ', cast(q_id as varchar))), 1, 8)) as bigint)"


def _drawn_sql() -> str:
    kinds = ", ".join(f"({size}, {sum(n for _, n in WORKLOAD[:i])}, {n})" for i, (size, n) in enumerate(WORKLOAD))
    return f"""select q_id, own, cast({_luck_sql("start")} % (own.length - size) as integer) as q_start, size from (select *, names[cast({_luck_sql("chromosome")} % len(names) as integer) + 1] as own from
 (select size, unnest(range(first_, first_ + n)) as q_id from (values {kinds}) k(size, first_, n)) join (select size, list(struct_pack(name := name, length := length) order by name) as names from
 (values {kinds}) k(size, first_, n) join (select chrom as name, max(end_) as length from ({L_SQL}) group by chrom) on length > size group by size) using (size))"""


def _depths_sql(**tables: str) -> str:
    """chrom, pos, a count of open intervals for each table, and next_: where the next change is."""
    events = " union all ".join(f"select chrom, {pos} as pos, {', '.join(f'{d if n == name else 0} as {n}' for n in tables)} from ({t})" for name, t in tables.items() for pos, d in (("start_", 1), ("end_", -1)))
    changes = f"select chrom, pos, {', '.join(f'sum({n}) as {n}' for n in tables)} from ({events}) group by chrom, pos having {' or '.join(f'sum({n}) <> 0' for n in tables)}"
    return f"select chrom, pos, {', '.join(f'sum({n}) over w as {n}' for n in tables)}, lead(pos) over w as next_ from ({changes}) window w as (partition by chrom order by pos)"


def _combined_sql(keep: str, **tables: str) -> str:
    """The longest stretches in which keep holds."""
    marked = f"select *, ({keep}) as kept, lag({keep}) over (partition by chrom order by pos) as was from ({_depths_sql(**tables)})"
    turns = f"select chrom, pos, kept, lead(pos) over (partition by chrom order by pos) as until from ({marked}) where kept <> coalesce(was, false)"
    return f'select chrom as "Chromosome", cast(pos as bigint) as "Start_", cast(until as bigint) as "End_" from ({turns}) where kept'


def oracle_sql():
    line = _LINE_SQL
    strand = lambda s: f"select * from ({L_SQL}) where strand = '{s}'"
    whole = f"select chrom, 0 as start_, max(end_) as end_ from ({L_SQL}) group by chrom"
    tail = "concat(chr(9), name, chr(9), cast(score as varchar), chr(9), strand)"
    number = "case when regexp_full_match(text, '{p}') then try_cast(text as integer) end"
    regions = ", ".join(f"('{c}', {s}, {e})" for c, s, e in REGIONS)
    overlap = f"""with l as ({L_SQL}), q(q_chrom, q_start, q_end) as (values {regions}) select chrom as "Chromosome", start_ as "Start_", end_ as "End_", name as "Name", q_start, q_end
 from l join q on chrom = q_chrom and start_ < q_end and end_ > q_start"""
    c, low, high = E_REGION
    e_index = f"select chrom, start_, end_, row_number() over (order by chrom, start_, end_) - 1 as row_id, max(end_) over (partition by chrom order by start_, end_ rows between unbounded preceding and current row) as most from ({E_SQL})"
    summed = f"select chrom, start_, sum(cast(cast(cast(score as varchar) as float) as double)) as s from ({L_SQL}) group by chrom, start_"
    regions_drawn = f"select own.name as q_chrom, q_start, cast(q_start + size as integer) as q_end, size from ({_drawn_sql()})"
    keys = _TIES_SQL
    return {
        "scan_bed": f"select chrom, start_, end_, name, score, strand from ({L_SQL})",
        "header_split": f"select 'header' as part, unnest(['# made', 'track name=l', 'browser position chr1']) as value union all select 'data', {line} from ({L_SQL})",
        "empty_scan": "select cast(0 as bigint) as n",
        "parse_bed3": f"select chrom, start_, end_, {tail} as tail from ({L_SQL})",
        "parse_bed6": f"select name, cast(score as varchar) as score_text, strand, cast(cast(cast(score as varchar) as float) as double) as weight from ({L_SQL})",
        "parse_uint": f"select text, {number.format(p='[0-9]+')} as number from ({_TEXTS_SQL})",
        "parse_int32_strict": f"select text, {number.format(p='-?[0-9]+')} as number from ({_TEXTS_SQL})",
        "validate_rows": f"select 'chr1' as chrom, number as start_, 2000000000 as end_, chr(9) || 'x' as tail from (select {number.format(p='[0-9]+')} as number from ({_TEXTS_SQL})) where number is not null",
        "tail_field_count": "select 3 as fields_, count(*) as records from lineitem",
        "tail_split": f"select name as f1, cast(score as varchar) as f2, strand as f3, cast(null as varchar) as f4 from ({L_SQL})",
        "flavor_detect": "select 'BED6' as flavor, count(*) as records from lineitem",
        "flavor_bed6": f'select chrom as "Chromosome", start_ as "Start_", end_ as "End_", strand as "Strand", name as "Name", cast(score as varchar) as "Score" from ({L_SQL})',
        "flavor_bed12": f"""select chrom as "Chromosome", start_ as "Start_", end_ as "End_", strand as "Strand", name as "Name", cast(score as varchar) as "Score", start_ as "ThickStart", end_ as "ThickEnd",
 '0,0,255' as "ItemRgb", 1 as "BlockCount", cast(end_ - start_ as varchar) as "BlockSizes", '0' as "BlockStarts" from ({L_SQL})""",
        "render_bed": f"select {line} as value from ({L_SQL})",
        "collapse": f"select chrom, start_, start_ + 1 as end_, s as score from ({summed})",
        "collapse_render": f"select concat_ws(chr(9), chrom, cast(start_ as varchar), cast(start_ + 1 as varchar), '.', printf('%g', s), '+') as value from ({summed})",
        "collapse_locus": f'select chrom as "Chromosome", start_ as "Start_", start_ + 1 as "End_", s as "Score", start_ + 1 as "MaxEndSoFar" from ({summed})',
        "locus_parquet_rows": _stored_sql(L_SQL, "strand, name, cast(score as varchar)", ', row_number() over (order by chrom, start_, end_, strand, name, cast(score as varchar)) as rn'),
        "read_locus": _stored_sql(E_SQL, "strand, name, cast(score as varchar)"),
        "max_end_so_far": f'select "Chromosome", "Start_", "End_", "MaxEndSoFar" from ({_stored_sql(E_SQL, "name")})',
        "manifest_chrom_stats": f"""select name, n as rows, min_start, max_start, max_end, cast(coalesce(sum(n) over (order by name rows between unbounded preceding and 1 preceding), 0) as bigint) as row_offset
 from (select chrom as name, count(*) as n, min(start_) as min_start, max(start_) as max_start, max(end_) as max_end from ({L_SQL}) group by chrom)""",
        "interval_index": f"""select chrom as chromosome, list(cast(start_ as bigint) order by row_id) as starts, list(cast(end_ as bigint) order by row_id) as ends, list(cast(most as bigint) order by row_id) as max_end_running,
 list(row_id order by row_id) as row_id from ({e_index}) group by chrom""",
        "index_lookup": f"select row_id, cast(start_ as bigint) as start_, cast(end_ as bigint) as end_ from ({e_index}) where chrom = '{c}' and start_ < {high} and end_ > {low}",
        "region_overlap": f"""select * from ({_stored_sql(L_SQL, "strand, name, cast(score as varchar)")}) where "Chromosome" = '{REGION[0]}' and "Start_" < {REGION[2]} and "End_" > {REGION[1]}""",
        "region_overlap_batch": overlap,
        "region_overlap_binned": overlap,
        "workload_scan": f"select chrom as q_chrom, start_ as q_start, end_ as q_end from ({L_SQL}) where start_ % 7 <> 0",
        "workload_drawn": f"select q_id, own.name as q_chrom, q_start, cast(q_start + size as integer) as q_end, cast(size as bigint) as size from ({_drawn_sql()})",
        "workload_buckets": f"""with q as ({regions_drawn}) select cast(size as bigint) as size, count(*) as regions, cast(sum((select count(*) from ({L_SQL}) l where l.chrom = q.q_chrom and l.start_ < q.q_end and l.end_ > q.q_start)) as bigint) as hits from q group by size""",
        "position_histogram": f"select chrom, start_ >> {SHIFT} as bucket, count(*) as records, cast(sum(octet_length(encode({line})) + 1) as bigint) as bytes from ({L_SQL}) group by all",
        "bucket_filter": f"select chrom, start_, end_, name from ({L_SQL}) where (chrom > 'chr10' or (chrom = 'chr10' and start_ >> {SHIFT} >= 5)) and not (chrom > 'chr14' or (chrom = 'chr14' and start_ >> {SHIFT} >= 3))",
        "chrom_rank_join": f"""with l as ({L_SQL}), d as (select chrom, row_number() over (order by {NATURAL_SQL}, chrom) - 1 as chrom_rank from (select distinct chrom from l))
 select chrom, chrom_rank, count(*) as records, min(start_) as min_start from l join d using (chrom) group by all""",
        "row_count": "select count(*) as n from lineitem",
        "distinct_chroms": f"select distinct chrom from ({L_SQL})",
        "row_id": f"with l as ({L_SQL}) select chrom, start_, end_, name, row_number() over (order by chrom, {keys}) - 1 as row_id from l",
        "run_boundaries": " union all ".join(
            f"select '{name}' as stored, chrom, start_, end_, name, rn from (select *, row_number() over (order by {by}) as rn, lag(chrom) over (order by {by}) as before from ({L_SQL})) where before is distinct from chrom"
            for name, by in (("chrom", f"chrom, {keys}"), ("start", f"{keys}, chrom"))
        ),
        "sort_start": _ranked_sql(f"chrom, start_, {line}"),
        "sort_start_end": _ranked_sql(f"chrom, start_, end_, {line}"),
        "sort_five_prime": _ranked_sql(f"chrom, case strand when '-' then end_ else start_ end, {line}"),
        "sort_natural": _ranked_sql(f"{NATURAL_SQL}, chrom, start_, {line}"),
        "sort_per_chrom": _ranked_sql(f"{NATURAL_SQL}, chrom, start_, {line}", "chrom, start_, end_, name"),
        "sort_external": _ranked_sql(f"chrom, start_, end_, {line}", "chrom, start_, end_, name"),
        "sort_multipass": _ranked_sql(f"chrom, start_, {line}", "chrom, start_, end_, name"),
        "sort_bam_key": """select tid, pos, l_orderkey, l_linenumber, row_number() over (order by tid < 0, tid, pos < 0, pos, l_orderkey, l_linenumber, l_extendedprice) as rn from (select case when l_linenumber = 7 then -1 else
 cast(l_suppkey % 24 as integer) end as tid, case when l_quantity = 50 then -1 else cast(l_partkey * 50 as integer) end as pos, l_orderkey, l_linenumber, l_extendedprice from lineitem)""",
        "union_runs": f"select chrom, count(*) as records from (select chrom from ({L_SQL}) union all select chrom from ({E_SQL})) group by chrom",
        "merge_records": f"""select chrom as "Chromosome", cast(min(start_) as bigint) as "Start_", cast(max(end_) as bigint) as "End_", count(*) as records from
 (select *, sum(apart) over (partition by chrom order by start_, end_, name) as island from
 (select *, case when start_ <= max(end_) over (partition by chrom order by start_, end_, name rows between unbounded preceding and 1 preceding) + 3 then 0 else 1 end as apart from ({L_SQL}) where end_ > start_)) group by chrom, island""",
        "coverage_depth": f"""select chrom as "Chromosome", cast(pos as bigint) as "Start_", cast(next_ as bigint) as "End_", cast(n as bigint) as depth from ({_depths_sql(n=E_SQL)}) where n > 0""",
        "subtract_records": _combined_sql("a > 0 and b = 0", a=strand("+"), b=strand("-")),
        "intersect_records": _combined_sql("a > 0 and b > 0", a=strand("+"), b=strand("-")),
        "complement_records": _combined_sql("a > 0 and b = 0", a=whole, b=L_SQL),
        "closest_record": f"""select "Chromosome", "Start_", "End_", name, cast(b_start as bigint) as "near_Start", cast(b_end as bigint) as "near_End", b_name as near_name, cast(distance as bigint) as distance from
 (select *, row_number() over (partition by "Chromosome", "Start_", "End_", name order by distance, later, case later when 0 then -b_end else b_start end, case later when 0 then -b_start else b_end end,
 case later when 0 then -names else names end) as nth from (select a.chrom as "Chromosome", a.start_ as "Start_", a.end_ as "End_", a.name, b.start_ as b_start, b.end_ as b_end, b.name as b_name, b.names,
 case when b.start_ < a.end_ then 0 else 1 end as later, case when b.start_ < a.end_ then greatest(a.start_ - b.end_, 0) else b.start_ - a.end_ end as distance
 from ({strand("+")}) a left join (select *, row_number() over (order by name) as names from ({strand("-")})) b on a.chrom = b.chrom)) where nth = 1""",
        "overlap_join": f"""select chrom as "Chromosome", start_ as "Start_", end_ as "End_", name, q_chrom, q_start, q_end from ({strand("+")}) join
 (select 'chr' || cast(l_suppkey % 24 + 1 as varchar) as q_chrom, cast(l_partkey * 50 as integer) as q_start, cast(l_partkey * 50 + l_orderkey % 20000 as integer) as q_end from lineitem where l_linenumber = 7)
 on chrom = q_chrom and start_ < q_end and end_ > q_start""",
        "index_directory": f"""select chrom as chromosome, cast(row_id // {INDEX_ROWS} as bigint) as block, cast(min(start_) as bigint) as first_start, cast(max(start_) as bigint) as last_start, cast(max(most) as bigint) as most_end,
 min(row_id) as first_row, cast(count(*) as integer) as rows from (select chrom, start_, row_number() over (order by chrom, start_, end_) - 1 as row_id, max(end_) over (partition by chrom order by start_, end_ rows between unbounded preceding and current row) as most
 from ({L_SQL})) group by chrom, row_id // {INDEX_ROWS}""",
        "latency_summary": "select event_type, count(*) as n, sum(cast(user_id as double)) as total, quantile_cont(cast(user_id as double), 0.5) as median, quantile_cont(cast(user_id as double), 0.99) as p99 from events group by event_type",
        "latency_sketch": "select event_type, count(*) as n, true as median_within, true as p99_within from events group by event_type",
        "order_check": f"""select unnest(['default', 'per_chromosome', 'external']) as plan, cast(0 as bigint) as inversions union all select 'by_name', count(*) from
 (select row(chrom, start_, value) as now_, lag(row(chrom, start_, value)) over (order by name, value) as then_ from (select *, {line} as value from ({L_SQL}))) where now_ < then_""",
    }


