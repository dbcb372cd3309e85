"""Locus datasets: one sorted, self-describing Parquet file with a manifest and an optional interval index in its footer."""

from __future__ import annotations

import base64
import io
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill import __version__, schema
from strandmill.functions import scalar
from strandmill.operators import derive, order, ranges, region
from strandmill.schema import BedError, Manifest
from strandmill.sources import ordered

KEY_PREFIX = "locus"  # of the footer keys; give another tool's prefix to write files for it
ZSTD_MAGIC = bytes.fromhex("28b52ffd")  # fixed value of the format
FOOTERS = 64  # parts whose footers a task reads
FEW_REGIONS = 64  # as many go to the scan as one condition
PART_BLOCK = 4 << 20  # bytes of a row group of a part, so that statistics prune within parts


def table_rows(typed: DataFrame, natural: bool = False, coord_dtype: str = "int32") -> DataFrame:
    """The dataset's rows, ordered, with the derived running maximum; a row with End <= Start ends the job. One range exchange; the rows are written
    in order, and passes over them start from there."""
    kind = schema.coordinate_type(coord_dtype)
    ok = F.when(F.col("End") > F.col("Start"), F.col("End")).otherwise(F.raise_error(F.concat(F.lit("End must be above Start: "), F.to_json(F.struct("Chromosome", "Start", "End")))).cast("int"))
    rows = typed.withColumns({"Start": F.col("Start").cast(kind), "End": ok.cast(kind)})
    payload = tuple(c for c in typed.columns if c not in schema.LOCUS)
    return derive.max_end_in_order(order.sort_records(rows, "b", natural, payload, chrom="Chromosome", start="Start", end="End"))


def arrow_schema(columns: DataFrame) -> pa.Schema:
    """Non-null Arrow fields of the dataset's columns."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "float": pa.float32(), "binary": pa.large_binary(), "boolean": pa.bool_()}
    return pa.schema([pa.field(n, kinds.get(k) or pa.string(), nullable=False) for n, k in columns.dtypes])


def index_blob(rows: DataFrame, prefix: str) -> bytes:
    """The interval index of ordered rows: an Arrow stream, compressed, in base64 so that readers which want text keys can hold it.

    Rows come in order, a batch at a time, and a chromosome's lists are written as soon as it ends; the driver holds one chromosome's lists
    as arrays, which make one row of the index by its format.
    """
    names = ("starts", "ends", "max_end_running", "row_id")
    layout = pa.schema([pa.field("chromosome", pa.string()), *[pa.field(n, pa.large_list(pa.int64())) for n in names]], metadata={f"{prefix}_index_format_version": schema.INDEX_VERSION})
    packed = io.BytesIO()
    with zstandard.ZstdCompressor().stream_writer(packed, closefd=False) as out, pa.ipc.new_stream(out, layout) as stream:
        held, name, offset = [], None, 0

        def flush():
            nonlocal held, offset
            if held:
                lists = [np.concatenate(c) for c in zip(*held, strict=True)]
                n = len(lists[0])
                lists.append(np.arange(offset, offset + n))
                ends = pa.array([0, n], pa.int64())
                stream.write_batch(pa.RecordBatch.from_arrays([pa.array([name]), *(pa.LargeListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in lists)], schema=layout))
                held, offset = [], offset + n

        for batch in ordered.arrow_batches(rows.select("Chromosome", "Start", "End", schema.DERIVED)):
            runs = pc.run_end_encode(batch.column("Chromosome"))
            begin = 0
            for chrom, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if chrom != name:
                    flush()
                    name = chrom
                held.append([batch.column(c).slice(begin, end - begin).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("Start", "End", schema.DERIVED)])
                begin = end
        flush()
    return base64.b64encode(packed.getvalue())


def _manifest(rows: DataFrame, layout: pa.Schema, natural: bool, coord_dtype: str, headers, provenance: dict) -> Manifest:
    """The manifest of stored rows, from one aggregation over their coordinates."""
    stats = derive.chromosome_stats(rows, chrom_keys=order.chromosome_keys("name", natural)).orderBy("row_offset").collect()
    extra = {k: v for k, v in provenance.items() if v is not None}
    if headers:
        extra["user_metadata"] = {**extra.get("user_metadata", {}), "headers": list(headers)}
    return Manifest(
        row_count=sum(r["rows"] for r in stats),
        chromosomes=[{k: r[k] for k in ("name", "rows", "row_offset", "min_start", "max_start", "max_end")} for r in stats],
        schema_columns=[{"name": f.name, "arrow_type": str(f.type), "compression": ["zstd", 3], "encoding": "native", "derived": f.name == schema.DERIVED} for f in layout],
        writer_version=f"strandmill {__version__}",
        created_utc=scalar.now_utc(),
        coord_dtype=coord_dtype,
        extra=extra,
    )


def write_locus(typed: DataFrame, path: str, natural: bool = False, index: bool = False, coord_dtype: str = "int32", headers: list[str] = (), key_prefix: str = KEY_PREFIX, **provenance) -> Manifest:
    """Writes the dataset as one file and returns its manifest. provenance: assembly, species, source_url, user_metadata.

    The rows are sorted and derived once and written to the shared folder; statistics, index and file read them from there.
    """
    rows = table_rows(typed, natural, coord_dtype)
    layout = arrow_schema(rows)
    manifest = _manifest(rows, layout, natural, coord_dtype, headers, provenance)
    blob = index_blob(rows, key_prefix) if index else None
    sorting = [pq.SortingColumn(i) for i in range(3)]
    options = {"version": "2.6", "data_page_version": "2.0", "compression": "zstd", "compression_level": 3, "write_statistics": True, "write_page_index": True, "use_dictionary": True, "sorting_columns": sorting}
    with ordered.atomic(path) as out, pq.ParquetWriter(out, layout, **options) as writer:
        held, n = [], 0
        for batch in ordered.arrow_batches(rows):
            held.append(pa.Table.from_batches([batch]).cast(layout))
            n += batch.num_rows
            while n >= schema.ROW_GROUP:  # whole row groups of the one size
                table = pa.concat_tables(held).combine_chunks()
                writer.write_table(table.slice(0, schema.ROW_GROUP), row_group_size=schema.ROW_GROUP)
                held, n = [table.slice(schema.ROW_GROUP)], n - schema.ROW_GROUP
        if n:
            writer.write_table(pa.concat_tables(held), row_group_size=schema.ROW_GROUP)
        keys = {f"{key_prefix}_manifest": json.dumps(manifest.as_json())} | ({f"{key_prefix}_interval_index": blob} if blob else {})
        writer.add_key_value_metadata(keys)
    return manifest


MANIFEST_FILE = "_manifest.json"


def write_locus_parts(typed: DataFrame, folder: str, natural: bool = False, coord_dtype: str = "int32", headers: list[str] = (), **provenance) -> Manifest:
    """Writes the dataset as a folder whose parts, in name order, hold the ordered rows: every task writes its own range. The folder takes its place
    when all parts and the manifest beside them are there. Any path that Spark can write."""
    spark = typed.sparkSession
    fs, at = ordered.file_system(spark, folder)
    parts = at.suffix(".tmp")
    rows = table_rows(typed, natural, coord_dtype)
    rows.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", PART_BLOCK).parquet(parts.toString())
    stored = spark.read.parquet(parts.toString())
    manifest = _manifest(stored, arrow_schema(stored), natural, coord_dtype, headers, provenance)
    ordered.put_text(spark, f"{parts.toString()}/{MANIFEST_FILE}", json.dumps(manifest.as_json()))
    fs.delete(at, True)
    if not fs.rename(parts, at):
        raise BedError(f"{folder} can't be published")
    return manifest


def read_parts_manifest(spark: SparkSession, folder: str) -> dict:
    """The manifest of a dataset in parts."""
    return json.loads(ordered.get_text(spark, f"{folder}/{MANIFEST_FILE}"))


def read_locus(spark: SparkSession, path: str) -> DataFrame:
    """The rows; any file name extension."""
    return spark.read.format("parquet").load(path)


def row_groups(spark: SparkSession, folder: str) -> DataFrame:
    """file, group, rows, first_chrom, last_chrom, min_start, max_end: the row groups of a dataset in parts by their footers' statistics, a task for
    each FOOTERS parts; max_end is the greatest running maximum."""
    files = part_files(spark, folder)

    def work(batches):
        for batch in batches:
            out = []
            for k in batch.column("id").to_pylist():
                store, at = ordered.arrow_path(files[k])
                own = pq.read_metadata(at, filesystem=store)
                place = {own.schema.column(i).path: i for i in range(own.num_columns)}
                for g in range(own.num_row_groups):
                    group = own.row_group(g)
                    chrom, start, most = (group.column(place[c]).statistics for c in ("Chromosome", "Start", schema.DERIVED))
                    known = group.num_rows and all(x is not None and x.has_min_max for x in (chrom, start, most))
                    out.append((files[k], g, group.num_rows, *((chrom.min, chrom.max, int(start.min), int(most.max)) if known else (None,) * 4)))
            yield pa.RecordBatch.from_pylist([dict(zip(_GROUP.names, r, strict=True)) for r in out], _GROUP)

    n = len(files)
    tasks = max(1, -(-n // FOOTERS))
    return spark.range(0, n, 1, tasks).mapInArrow(work, "file string, group int, rows long, first_chrom string, last_chrom string, min_start long, max_end long")


_GROUP = pa.schema([("file", pa.string()), ("group", pa.int32()), ("rows", pa.int64()), ("first_chrom", pa.string()), ("last_chrom", pa.string()), ("min_start", pa.int64()), ("max_end", pa.int64())])


def part_files(spark: SparkSession, folder: str) -> list[str]:
    """The parts of a dataset, in order."""
    fs, at = ordered.file_system(spark, folder)
    return sorted(str(f.getPath().toString()) for f in fs.listStatus(at) if str(f.getPath().getName()).startswith("part-"))


def touched(groups: DataFrame, regions: DataFrame) -> DataFrame:
    """Those of row_groups in which something may overlap one of the regions (q_chrom, q_start, q_end). Groups of one chromosome meet regions by
    it; the few that hold several, and any without statistics, are taken for each chromosome between."""
    near = (F.col("first_chrom") == F.col("q_chrom")) & (F.col("min_start") < F.col("q_end")) & (F.col("max_end") > F.col("q_start"))
    one = groups.where("first_chrom = last_chrom").join(regions, near, "left_semi")
    names = F.broadcast(regions.select("q_chrom").distinct())
    several = groups.where("first_chrom < last_chrom").join(names, F.col("q_chrom").between(F.col("first_chrom"), F.col("last_chrom")), "left_semi")
    return one.unionByName(several).unionByName(groups.where("first_chrom is null and rows > 0"))


def read_groups(spark: SparkSession, folder: str, groups: DataFrame) -> DataFrame:
    """The rows of some row groups of a dataset in parts."""
    kind = read_locus(spark, folder).schema

    def work(batches):
        for batch in batches:
            for file, group in zip(batch.column("file").to_pylist(), batch.column("group").to_pylist(), strict=True):
                store, at = ordered.arrow_path(file)
                with pq.ParquetFile(at, filesystem=store) as own:
                    yield from own.read_row_group(group, columns=kind.names).select(kind.names).to_batches()

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return groups.select("file", "group").repartition(n, "file", "group").mapInArrow(work, kind)


def read_regions(spark: SparkSession, folder: str, regions: DataFrame) -> DataFrame:
    """The stored loci joined to the regions (q_chrom, q_start, q_end) that they overlap, of a dataset in parts. A few regions go to the scan as one
    condition; for more, the row groups to be read are chosen by their footers' statistics first."""
    few = regions.limit(FEW_REGIONS + 1).collect()
    if len(few) <= FEW_REGIONS:
        return region.few_regions(read_locus(spark, folder).where(region.any_of([(r["q_chrom"], r["q_start"], r["q_end"]) for r in few])), regions)
    parts = part_files(spark, folder)
    if not parts or not ordered.arrow_opens(parts[0]):  # a store that only Spark reads
        return region.region_batch(read_locus(spark, folder), regions)
    return region.region_batch(read_groups(spark, folder, touched(row_groups(spark, folder), regions)), regions)


def _footer(path: str, ending: str) -> tuple[str, bytes] | None:
    own = pq.read_metadata(path).metadata or {}
    return next(((k.decode(), v) for k, v in own.items() if k.decode().endswith(ending)), None)


def read_manifest(path: str) -> dict:
    found = _footer(path, "_manifest")
    if found is None:
        raise BedError(f"{path} has no manifest")
    manifest = json.loads(found[1])
    if manifest.get("format_version") != schema.FORMAT_VERSION:
        raise BedError(f"unknown format version {manifest.get('format_version')}")
    return manifest


def _index_batches(path: str):
    """The index a chromosome at a time, as Arrow batches; nothing where the file has no index that can be read."""
    found = _footer(path, "_interval_index")
    if found is None:
        return
    raw = found[1] if found[1][:4] == ZSTD_MAGIC else base64.b64decode(found[1], validate=True)  # version 1 came without base64
    with zstandard.ZstdDecompressor().stream_reader(raw) as plain, pa.ipc.open_stream(plain) as stream:
        version = {k.decode(): v.decode() for k, v in (stream.schema.metadata or {}).items()}
        if {"1", schema.INDEX_VERSION} & set(version.values()):
            yield from stream


_UNREADABLE = (ValueError, pa.ArrowInvalid, zstandard.ZstdError, OSError)


def index_entry(path: str, chrom: str) -> dict | None:
    """One chromosome's lists as arrays, for region.lookup; None where the file has no index that can be read, or none of it: use the predicate then.
    No other chromosome's lists are kept."""
    try:
        for batch in _index_batches(path):
            at = pc.index(batch.column("chromosome"), pa.scalar(chrom)).as_py()
            if at >= 0:
                return {c: batch.column(c)[at].values.to_numpy() for c in batch.schema.names if c != "chromosome"}
    except _UNREADABLE:
        return None
    return None


def read_index(path: str) -> dict[str, dict] | None:
    """Chromosome to its lists, whole; None where the file has no index that can be read."""
    try:
        found = {r["chromosome"]: r for batch in _index_batches(path) for r in batch.to_pylist()}
    except _UNREADABLE:
        return None
    return found or None


def verify(spark: SparkSession, path: str) -> list[str]:
    """What keeps the file from conforming; an empty list if it conforms."""
    problems = []
    try:
        manifest = read_manifest(path)
    except BedError as e:
        return [str(e)]
    rows = read_locus(spark, path)
    kinds = dict(rows.dtypes)
    missing = [c for c in (*schema.LOCUS, schema.DERIVED) if c not in kinds]
    if missing:
        return [f"columns missing: {', '.join(missing)}"]
    width = {"int32": "int", "int64": "bigint"}.get(manifest.get("coord_dtype", "int32" if kinds["Start"] == "int" else "int64"))
    if any(kinds[c] != width for c in ("Start", "End", schema.DERIVED)):
        problems.append("coord_dtype and the columns' types differ")
    if manifest["sort_keys"] != schema.SORT_KEYS:
        problems.append("sort_keys")
    if {c["name"] for c in manifest["schema_columns"]} != set(rows.columns):
        problems.append("schema_columns and the columns differ")
    rank = {c["name"]: i for i, c in enumerate(manifest["chromosomes"])}
    # One file read in order: what a row must be follows from the row before.
    ranks = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv]) if rank else F.create_map().cast("map<string,int>")
    ordered_rows = ranges.placed(rows.select(*schema.LOCUS, schema.DERIVED, F.try_element_at(ranks, F.col("Chromosome")).alias("rank")))
    if ordered_rows.where("End <= Start").limit(1).count():
        problems.append("a row with End <= Start")
    if ordered_rows.where("rank is null").limit(1).count():
        problems.append("a chromosome that the manifest lacks")
    before = F.struct(F.col("Chromosome").alias("c0"), F.col("Start").alias("s0"), F.col("End").alias("e0"), F.col(schema.DERIVED).alias("m0"), F.col("rank").alias("r0"))
    both = ranges.neighbour(ordered_rows, "before", before).select("*", "before.*")
    inside = both.where("Chromosome = c0")
    if inside.where("Start < s0 or (Start = s0 and End < e0)").limit(1).count():
        problems.append("rows out of order within a chromosome")
    most = F.when(F.col("Chromosome") == F.col("c0"), F.greatest("End", "m0")).otherwise(F.col("End"))
    if both.where(F.col(schema.DERIVED) != most).limit(1).count():
        problems.append("MaxEndSoFar is not the running maximum")
    if both.where("Chromosome <> c0 and rank <= r0").limit(1).count():
        problems.append("chromosomes not in contiguous runs in the manifest's order")
    actual = {r["name"]: r for r in derive.chromosome_stats(rows).collect()}
    offset = 0
    for c in manifest["chromosomes"]:
        own = actual.get(c["name"])
        if own is None or any(c[k] != own[k] for k in ("rows", "min_start", "max_start", "max_end")) or c["row_offset"] != offset:
            problems.append(f"statistics of {c['name']}")
        offset += c["rows"]
    if not offset == manifest["row_count"] == pq.read_metadata(path).num_rows:
        problems.append("row counts differ")
    return problems
