"""Scans, sinks and the command line, against GNU sort, golden rows and read-backs."""

import gzip
import io
import json
import random
import struct
import subprocess
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strandmill import cli, schema
from strandmill.functions import scalar
from strandmill.operators import collapse, derive, order, region
from strandmill.plans import storage, strategy
from strandmill.schema import BedError
from strandmill.sources import bam, bed, bgzf, locus_parquet, text, workload


def bed6(n=3000, seed=42, chroms=("chr1", "chr2", "chr10", "chrX"), most=5000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.randrange(most)
        rows.append(f"{rng.choice(chroms)}\t{s}\t{s + rng.randint(1, 200)}\tread{i}\t{rng.randint(0, 50)}\t{rng.choice('+-')}")
    return rows


def put(path, lines, end="\n"):
    path.write_bytes(("".join(x + end for x in lines)).encode())
    return str(path)


def gnu(lines, *keys):
    return subprocess.run(["sort", *keys], input="\n".join(lines) + "\n", capture_output=True, text=True, env={"LC_ALL": "C"}).stdout.splitlines()


def options(*args):
    return cli.parser().parse_args([str(a) for a in args])


def test_sort_equals_gnu_sort(spark, tmp_path):
    lines = bed6()
    path = put(tmp_path / "a.bed", ["# head", "track name=x", *lines])
    for args, keys in (((), ("-k1,1", "-k2,2n")), (("-s", "b"), ("-k1,1", "-k2,2n", "-k3,3n")), (("--low-mem-ssd",), ("-k1,1", "-k2,2n")), (("--external-merge", "--max-mem", "4K"), ("-k1,1", "-k2,2n")), (("--multi-pass", "--max-mem", "1M"), ("-k1,1", "-k2,2n"))):
        out = tmp_path / "out.bed"
        cli.run(options(path, "-o", out, *args), spark)
        assert out.read_text().splitlines() == ["# head", "track name=x", *gnu(lines, *keys)]


def test_five_prime_and_natural(spark, tmp_path):
    lines = bed6()
    path = put(tmp_path / "a.bed", lines)
    cli.run(options(path, "-o", tmp_path / "o", "-s", "5"), spark)
    got = [x.split("\t") for x in (tmp_path / "o").read_text().splitlines()]
    place = lambda r: (r[0], int(r[2]) if r[5] == "-" else int(r[1]))
    assert got == sorted((x.split("\t") for x in lines), key=lambda r: (*place(r), "\t".join(r)))
    names = ["chr10", "chr2", "chr1", "chr20", "chrX", "chrY", "chr9", "chr01", "chr1_random", "2", "10", "chr"]
    path = put(tmp_path / "n.bed", [f"{c}\t1\t2" for c in names])
    cli.run(options(path, "-o", tmp_path / "o", "-n"), spark)
    assert [x.split("\t")[0] for x in (tmp_path / "o").read_text().splitlines()] == ["2", "10", "chr", "chr01", "chr1", "chr1_random", "chr2", "chr9", "chr10", "chr20", "chrX", "chrY"]
    cli.run(options(put(tmp_path / "three.bed", ["chr1\t5\t6", "chr1\t2\t9"]), "-o", tmp_path / "o", "-s", "5"), spark)
    assert (tmp_path / "o").read_text() == "chr1\t2\t9\nchr1\t5\t6\n"


def test_scan_forms(spark, tmp_path, monkeypatch, capfdbinary):
    lines = bed6(200)
    want = gnu(lines, "-k1,1", "-k2,2n")
    (tmp_path / "z.bed.gz").write_bytes(gzip.compress("\n".join(lines[:100]).encode() + b"\n") + gzip.compress("\n".join(lines[100:]).encode() + b"\n"))
    for path in (put(tmp_path / "crlf.bed", lines, "\r\n"), str(tmp_path / "z.bed.gz"), put(tmp_path / "blank.bed", ["", *lines[:50], "", *lines[50:], ""])):
        cli.run(options(path, "-o", tmp_path / "o"), spark)
        assert (tmp_path / "o").read_text().splitlines() == want
    (tmp_path / "open.bed").write_text("\n".join(lines))
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO("\n".join(lines).encode())))
    cli.run(options("-"), spark)
    assert capfdbinary.readouterr().out.decode().splitlines() == want
    spaced = put(tmp_path / "s.bed", ["chr1 20 30 a 5 -", "chr1 3 4"])
    header, rows = bed.read_bed(spark, spaced)
    assert sorted((r["start"], r["name"], r["score"], r["strand"]) for r in rows.collect()) == [(3, None, None, "+"), (20, "a", "5", "-")]
    for empty in ([], ["# only", "track x"]):
        cli.run(options(put(tmp_path / "e.bed", empty), "-o", tmp_path / "o"), spark)
        assert (tmp_path / "o").read_text().splitlines() == empty


@pytest.mark.parametrize("line", ["chr1\t5", "chr1\t-5\t10", "chr1\tx\t10", "chr1\t1.5\t3", "chr1\t2147483648\t2147483649", "# late"])
def test_malformed_lines_fail_and_are_named(spark, tmp_path, line):
    path = put(tmp_path / "bad.bed", ["chr1\t1\t2", line])
    with pytest.raises(Exception, match="malformed"):
        bed.read_bed(spark, path)[1].select("value", "start").collect()
    assert bed.read_bed(spark, path, on_error="drop")[1].count() == 1


def test_scores(spark, tmp_path):
    path = put(tmp_path / "c.bed", ["chr1\t100\t101\t.\t1.5\t+", "chr1\t100\t101\t.\t2.5\t+", "chr1\t200\t201\t.\t3.0\t+", "chr2\t50\t51\t.\t4.0\t+", "chr3\t1\t2"])
    cli.run(options(path, "-o", tmp_path / "o", "--collapse"), spark)
    assert (tmp_path / "o").read_text().splitlines() == ["chr1\t100\t101\t.\t4\t+", "chr1\t200\t201\t.\t3\t+", "chr2\t50\t51\t.\t4\t+", "chr3\t1\t2\t.\t0\t+"]
    for score in (".", "x" * 256, ""):
        path = put(tmp_path / "b.bed", [f"chr1\t1\t2\tn\t{score}\t+"])
        with pytest.raises(Exception, match="score"):
            collapse.collapse(collapse.with_weight(bed.read_bed(spark, path)[1])).collect()


def test_flavors(spark, tmp_path):
    def flavor(*lines):
        return bed.detect_flavor(bed.read_bed(spark, put(tmp_path / "f.bed", lines))[1])

    base = ["chr1", "1", "2"]
    for n in range(3, 15):
        assert flavor("\t".join([*base, *"x" * (n - 3)])) == schema.flavor_of(n)
    assert flavor("\t".join([*base, *"abcd"]), "\t".join([*base, *"abcdef"])) == "BED_PLUS"
    with pytest.raises(BedError):
        flavor("\t".join(base), "\t".join([*base, *"abc"]))
    with pytest.raises(BedError):
        flavor("\t".join([*base, *"abcd"]), "\t".join([*base, *"abcdefghi"]), "\t".join([*base, *"abcdefghij"]))
    twelve = "chr1\t10\t50\tn\t5\t-\t12\t40\t0,0,1\t2\t5,6\t0,9"
    rows = bed.typed(bed.read_bed(spark, put(tmp_path / "t.bed", [twelve]))[1], "BED12").first()
    assert tuple(rows) == ("chr1", 10, 50, "-", "n", "5", 12, 40, "0,0,1", 2, "5,6", "0,9")
    with pytest.raises(Exception, match="ThickStart"):
        bed.typed(bed.read_bed(spark, put(tmp_path / "t.bed", [twelve.replace("\t12\t", "\tx\t")]))[1], "BED12").collect()


def write(spark, tmp_path, lines, *args):
    out = tmp_path / "d.locus"
    cli.run(options(put(tmp_path / "in.bed", lines), "--locus-output", out, *args), spark)
    return str(out)


def test_locus_golden_rows(spark, tmp_path):
    path = write(spark, tmp_path, ["# kept", "chr2\t100\t200\tname1\t1\t+", "chr1\t50\t150\tname2\t2\t-", "chr1\t10\t20\tname3\t3\t+", "chr2\t30\t40\tname4\t4\t-"], "--locus-index")
    table = pq.read_table(path)
    assert table.column_names == schema.columns_of("BED6")
    assert [tuple(r.values()) for r in table.to_pylist()] == [("chr1", 10, 20, "+", "name3", "3", 20), ("chr1", 50, 150, "-", "name2", "2", 150), ("chr2", 30, 40, "-", "name4", "4", 40), ("chr2", 100, 200, "+", "name1", "1", 200)]
    assert not any(f.nullable for f in table.schema)
    manifest = locus_parquet.read_manifest(path)
    assert manifest["row_count"] == 4 and [c["row_offset"] for c in manifest["chromosomes"]] == [0, 2] and manifest["user_metadata"]["headers"] == ["# kept"]
    assert locus_parquet.read_index(path)["chr2"] == {"chromosome": "chr2", "starts": [30, 100], "ends": [40, 200], "max_end_running": [40, 200], "row_id": [2, 3]}
    assert locus_parquet.verify(spark, path) == []
    path = write(spark, tmp_path, ["chr1\t100\t200\tr1\t2\t+", "chr1\t100\t500\tr2\t3\t-", "chr1\t150\t160\tr3\t1\t+", "chr2\t50\t60\tr4\t7\t+", "chr2\t50\t61\tr5\t4\t-"], "--collapse")
    assert [tuple(r.values()) for r in pq.read_table(path).to_pylist()] == [("chr1", 100, 101, 5.0, 101), ("chr1", 150, 151, 1.0, 151), ("chr2", 50, 51, 11.0, 51)]
    assert {c["name"] for c in locus_parquet.read_manifest(path)["schema_columns"]} == set(schema.columns_of("COLLAPSED"))


def test_locus_cases(spark, tmp_path):
    path = write(spark, tmp_path, ["# nothing"])
    assert pq.read_table(path).column_names == schema.columns_of("BED3") and locus_parquet.verify(spark, path) == []
    with pytest.raises(Exception, match="End must be above Start"):
        write(spark, tmp_path, ["chr1\t5\t5"])
    path = write(spark, tmp_path, bed6(500), "-n", "--coord-dtype", "int64")
    assert [c["name"] for c in locus_parquet.read_manifest(path)["chromosomes"]] == ["chr1", "chr2", "chr10", "chrX"]
    assert locus_parquet.verify(spark, path) == [] and str(pq.read_schema(path).field("End").type) == "int64"
    table = pq.read_table(path)
    broken = str(tmp_path / "broken.locus")
    pq.write_table(table.take(list(range(1, 500)) + [0]).replace_schema_metadata(table.schema.metadata), broken)
    assert locus_parquet.verify(spark, broken) != []


def test_row_groups_and_pruning(spark, tmp_path):
    n = 2 * schema.ROW_GROUP + 1
    rows = spark.range(n).select(F.lit("chr1").alias("Chromosome"), F.col("id").cast("int").alias("Start"), (F.col("id") + 5).cast("int").alias("End"))
    path = str(tmp_path / "g.locus")
    locus_parquet.write_locus(rows, path)
    meta = pq.read_metadata(path)
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [schema.ROW_GROUP, schema.ROW_GROUP, 1]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    found = region.region(locus_parquet.read_locus(spark, path), "chr1", 1000, 1010)
    plan = found._jdf.queryExecution().toString()
    for clause in ("EqualTo(Chromosome,chr1)", "LessThan(Start,1010)", "GreaterThan(End,1000)", "GreaterThan(MaxEndSoFar,1000)"):
        assert clause in plan
    assert found.count() == 14


def test_regions_by_predicate_index_and_tabix(spark, tmp_path):
    lines = bed6(800)
    path = write(spark, tmp_path, lines, "--locus-index")
    index, loci = locus_parquet.read_index(path), locus_parquet.read_locus(spark, path)
    table = pq.read_table(path).to_pylist()
    zipped = str(tmp_path / "z.bed.gz")
    cli.run(options(put(tmp_path / "in.bed", ["#h", *lines]), "-o", zipped, "--tabix"), spark)
    assert gzip.open(zipped, "rt").read().splitlines() == ["#h", *gnu(lines, "-k1,1", "-k2,2n")]
    rng = random.Random(1)
    for chrom, low, high in [("chr1", 0, 1), ("chrUn", 5, 50), *((rng.choice(["chr1", "chr10", "chrX"]), s, s + rng.choice([1, 50, 900])) for s in rng.sample(range(5000), 6))]:
        want = [i for i, r in enumerate(table) if r["Chromosome"] == chrom and r["Start"] < high and r["End"] > low]
        assert region.region(loci, chrom, low, high).count() == len(want)
        assert (region.lookup(index[chrom], low, high) if chrom in index else []) == want
        entry = locus_parquet.index_entry(path, chrom)
        assert (region.lookup(entry, low, high) if entry else []) == want
        assert sorted(r["value"] for r in bgzf.fetch(spark, zipped, chrom, low, high).collect()) == sorted(x for x in lines if x.split("\t")[0] == chrom and int(x.split("\t")[1]) < high and int(x.split("\t")[2]) > low)


def test_bgzf_blocks(spark, tmp_path):
    lines = [f"chr1\t{i}\t{i + 1}\t{'x' * 100}" for i in range(3000)] + [f"chr2\t1\t2\t{'y' * 200_000}"]
    path = str(tmp_path / "b.gz")
    cli.run(options(put(tmp_path / "in.bed", lines), "-o", path, "--bgzip"), spark)
    raw = open(path, "rb").read()
    assert raw.endswith(bgzf.END_OF_FILE) and gzip.decompress(raw).decode().splitlines() == gnu(lines, "-k1,1", "-k2,2n")
    at = 0
    while at < len(raw):
        assert raw[at + 12 : at + 16] == b"BC\x02\x00"
        at += struct.unpack_from("<H", raw, at + 16)[0] + 1
    assert at == len(raw)


def test_bam(spark, tmp_path):
    rng = random.Random(3)
    own = [(rng.choice([-1, 0, 1]), rng.choice([-1, 5, rng.randrange(1000)]), f"r{i}".encode()) for i in range(300)]
    refs = struct.pack("<i", 2) + b"".join(struct.pack("<i", len(n) + 1) + n + b"\0" + struct.pack("<i", 5000) for n in (b"chr1", b"chr2"))
    text_ = b"@HD\tVN:1.6\tSO:unsorted\n"
    body = b"".join(struct.pack("<i", 8 + len(r)) + struct.pack("<ii", t, p) + r for t, p, r in own)
    source = tmp_path / "a.bam"
    source.write_bytes(bgzf.block(b"BAM\1" + struct.pack("<i", len(text_)) + text_ + refs) + bgzf.block(body) + bgzf.END_OF_FILE)
    cli.run(options(source, "-o", tmp_path / "o.bam"), spark)
    with gzip.open(tmp_path / "o.bam") as f:
        head, table = bam.read_header(f)
        got = [(t, p, raw[8:]) for t, p, raw in bam.records(f)]
    assert head == "@HD\tVN:1.6\tSO:coordinate\n" .rstrip("\0") and table == refs
    assert got == sorted(own, key=lambda r: (r[0] & 0xFFFFFFFF, r[1] & 0xFFFFFFFF))


def test_option_matrix(tmp_path):
    path = put(tmp_path / "a.bed", ["chr1\t1\t2"])
    bad = ["--bgzip", "--tabix", "--bgzip -o x --locus-output y", "--locus-output y -s b", "--locus-output y -o x", "--collapse -s b", "--collapse -s 5", "--multi-pass -s b", "--multi-pass --collapse", "--external-merge --low-mem-ssd", "--merge-codec foo", "--max-mem lots",
           "--strict-compat --external-merge -s b", "--strict-compat --locus-output y --collapse --low-mem-ssd"]
    for args in bad:
        assert cli.main([path, *args.split()]) == 1, args
    for args in (["a.bam"], ["a.bam", "-o", "x", "-n"], ["-", "--multi-pass"]):
        assert cli.main(args) == 1
    for args in ("", "--tabix -o x", "--locus-output y --collapse", "--external-merge -s 5", "-n -s b --low-mem-ssd"):
        cli.check_options(options(path, *args.split()))
    with pytest.warns(UserWarning):
        cli.check_options(options(path, "--locus-index"))
    with pytest.warns(UserWarning):
        assert strategy.spill_settings("rans0")["spark.io.compression.codec"] == "zstd"


def test_small_functions(spark):
    assert [scalar.memory_size(x) for x in ("4G", "500M", "1024K", "77", "x", "")] == [4 << 30, 500 << 20, 1 << 20, 77, 0, 0]
    assert derive.plan_passes([("a", 0, 1, 80), ("a", 1, 1, 80), ("b", 0, 1, 50)], 150) == [(0, 1), (1, 2), (2, 3)]
    assert derive.plan_passes([("a", 0, 1, 30), ("a", 1, 1, 30)], 150) == [(0, 2)] and derive.plan_passes([], 9) == []
    with pytest.raises(BedError):
        derive.plan_passes([("a", 0, 1, 500)], 100)
    rows = spark.createDataFrame([("chr1", 1_048_575), ("chr1", 1_048_576)], "chrom string, start int").withColumn("value", F.lit("x"))
    assert sorted(tuple(r) for r in derive.position_histogram(rows).collect()) == [("chr1", 0, 1, 2), ("chr1", 1, 1, 2)]
    got = spark.createDataFrame([(4.0,), (0.1,), (123456.5,), (1e10,)], "x double").select(scalar.general_format("x")).collect()
    assert [r[0] for r in got] == ["4", "0.1", "123456", "1e+10"]
    texts = spark.createDataFrame([("1.5abc",), (" 2e1",), ("nan",), ("-inf",), (".",), ("",)], "t string").select(scalar.weight(F.col("t"))).collect()
    assert str([r[0] for r in texts]) == "[1.5, 20.0, nan, -inf, None, None]"


def test_two_level_maximum_and_ranks(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), s := rng.randrange(3000), s + rng.choice([1, 5, 900])) for _ in range(700)]
    loci = spark.createDataFrame(rows, "Chromosome string, Start int, End int")
    most, want = {}, []
    for c, s, e in sorted(rows):
        most[c] = max(most.get(c, 0), e)
        want.append((c, s, e, most[c]))
    for shift in (0, 4, 20):
        assert sorted(tuple(r) for r in derive.max_end_so_far(loci, shift=shift).collect()) == sorted(want)
    ranked = order.ranked(loci, "Chromosome", "Start", "End").collect()
    assert [(r["Chromosome"], r["Start"], r["End"]) for r in sorted(ranked, key=lambda r: r["rn"])] == sorted(rows) and sorted(r["rn"] for r in ranked) == list(range(1, 701))


def test_a_crowded_start_is_one_row_of_the_windows(spark):
    rows = [("a", 5, 6 + i % 7) for i in range(2000)] + [("a", 4, 9), ("a", 6, 7)]
    got = derive.max_end_so_far(spark.createDataFrame(rows, "Chromosome string, Start int, End int"))
    assert sorted((r["Start"], r["End"], r["MaxEndSoFar"]) for r in got.collect()) == sorted((s, e, e if s == 4 else max(9, e) if s == 5 else 12) for _, s, e in rows)
    plan = got._jdf.queryExecution().toString()
    assert plan.index("Aggregate") < plan.index("Window") or "Aggregate" in plan.split("Window")[-1]


def test_physical_places_and_inversions(spark):
    rows = spark.createDataFrame([(i, (i * 7919) % 1000) for i in range(1000)], "i int, x int")
    placed = order.numbered(rows.orderBy("x")).orderBy("rn").collect()
    assert [r["rn"] for r in placed] == list(range(1, 1001)) and [r["x"] for r in placed] == sorted(r["x"] for r in placed)
    assert order.inversions(order.numbered(rows.orderBy("x")), "x").first()[0] == 0
    shuffled = [(i * 7919) % 1000 for i in range(1000)]
    assert order.inversions(order.numbered(rows.orderBy("i")), "x").first()[0] == sum(a > b for a, b in zip(shuffled, shuffled[1:], strict=False))


def test_external_runs_keep_the_budget(spark, tmp_path):
    lines = bed6(3000)
    records = bed.read_bed(spark, put(tmp_path / "a.bed", lines))[1]
    few, many = strategy.external(records), strategy.external(records, 8_000)
    assert few.rdd.getNumPartitions() < many.rdd.getNumPartitions()
    largest = max(many.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length("value") + 1 + derive.RECORD_OVERHEAD).alias("n")).collect(), key=lambda r: r["n"])
    assert largest["n"] < 3 * 8_000
    assert [r["value"] for r in many.select("value").collect()] == gnu(lines, "-k1,1", "-k2,2n")


def test_dataset_in_parts(spark, tmp_path):
    lines = bed6(900)
    folder = str(tmp_path / "parts.locus")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cli.run(options(put(tmp_path / "in.bed", ["# kept", *lines]), "--locus-parts", folder), spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    one = pq.read_table(write(spark, tmp_path, lines)).to_pylist()
    files = sorted((tmp_path / "parts.locus").glob("part-*"))
    assert len(files) > 1 and [r for f in files for r in pq.read_table(f).to_pylist()] == one
    manifest = locus_parquet.read_parts_manifest(spark, folder)
    assert manifest["row_count"] == 900 and manifest["user_metadata"]["headers"] == ["# kept"] and [c["name"] for c in manifest["chromosomes"]] == ["chr1", "chr10", "chr2", "chrX"]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    found = region.region(locus_parquet.read_locus(spark, folder), "chr1", 1000, 1010)
    plan = found._jdf.queryExecution().toString()
    assert all(clause in plan for clause in ("EqualTo(Chromosome,chr1)", "LessThan(Start,1010)", "GreaterThan(End,1000)", "GreaterThan(MaxEndSoFar,1000)"))
    assert found.count() == sum(r["Chromosome"] == "chr1" and r["Start"] < 1010 and r["End"] > 1000 for r in one)
    assert not (tmp_path / "parts.locus.tmp").exists()


def test_stored_queries_push_their_clauses(spark, tiny):
    from strandmill.plans import catalog

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = catalog.queries()["region_overlap"](spark, tiny)._jdf.queryExecution().toString()
    assert all(clause in plan for clause in ("EqualTo(Chromosome,chr2)", "LessThan(Start,5000)", "GreaterThan(End,4000)", "GreaterThan(MaxEndSoFar,4000)"))


def test_index_of_a_long_chromosome(spark):
    """A million rows of one chromosome: one sort, no step that copies the list; lookups by halving equal the predicate."""
    n = 1_000_000
    loci = spark.range(n).select(F.lit("chr1").alias("Chromosome"), F.pmod(F.col("id") * 7919, F.lit(n)).cast("int").alias("Start")).withColumn("End", F.col("Start") + 1 + F.pmod(F.col("Start") * 31, F.lit(500)).cast("int"))
    began = time.time()
    index = derive.interval_index(loci).cache()
    assert index.select(F.size("starts")).first()[0] == n
    assert time.time() - began < 60
    for low, high in ((0, 1), (500_000, 500_010), (999_999, 2_000_000), (5_000_000, 5_000_001)):
        got = sorted(tuple(r) for r in region.index_lookup(index, "chr1", low, high).collect())
        want = sorted((r["Start"], r["Start"], r["End"]) for r in loci.where((F.col("Start") < high) & (F.col("End") > low)).collect())
        assert got == want
    index.unpersist()


def test_index_of_version_1_is_read(spark, tmp_path):
    """Without base64, as earlier writers left it."""
    import base64
    import zstandard

    path = write(spark, tmp_path, ["chr1\t5\t9", "chr1\t1\t20", "chr2\t3\t4"], "--locus-index")
    table = pq.read_table(path)
    blob = zstandard.ZstdDecompressor().decompressobj().decompress(base64.b64decode(pq.read_metadata(path).metadata[b"locus_interval_index"]))
    old = str(tmp_path / "old.locus")
    pq.write_table(table.replace_schema_metadata({b"locus_interval_index": zstandard.compress(blob)}), old)
    assert locus_parquet.read_index(old) == locus_parquet.read_index(path)
    pq.write_table(table.replace_schema_metadata({b"locus_interval_index": b"no index"}), old)
    assert locus_parquet.read_index(old) is None


def test_workloads(spark, tmp_path):
    path = tmp_path / "w.tsv"
    path.write_text("chr1\t5\t10\nchr2\t7\n\nchr3\t1\t2\t1000\textra\r\n")
    assert [tuple(r) for r in workload.read_workload(spark, str(path)).collect()] == [("chr1", 5, 10), ("chr3", 1, 2)]
    path.write_text("chr1\tx\t10\n")
    with pytest.raises(Exception, match="no integer"):
        workload.read_workload(spark, str(path)).collect()
    written = write(spark, tmp_path, [f"chr{i}\t1\t{end}" for i, end in enumerate((500, 5_000, 2_000_000, 90_000_000))])
    sizes = workload.chromosome_sizes(spark, locus_parquet.read_manifest(written))
    length = {r["name"]: r["length"] for r in sizes.collect()}
    drawn = workload.drawn(sizes).collect()
    assert [sum(r["size"] == size for r in drawn) for size, _ in workload.SIZES] == [333, 333, 334]
    assert all(r["q_end"] - r["q_start"] == r["size"] and 0 <= r["q_start"] and r["q_end"] < length[r["q_chrom"]] for r in drawn)
    assert {r["q_chrom"] for r in drawn if r["size"] == 1_000} == {"chr1", "chr2", "chr3"} and sorted(drawn) == sorted(workload.drawn(sizes).collect())
    none = workload.drawn(sizes.where("length < 600"))
    assert none.count() == 0
    regions = spark.createDataFrame([("chr0", 0, 100), ("chr0", 400, 500), ("chr9", 0, 50)], "q_chrom string, q_start int, q_end int")
    assert workload.of_size(regions, 100).count() == 2
    hits = region.region_batch(locus_parquet.read_locus(spark, written), regions)
    assert sorted(tuple(r) for r in workload.summary(regions, hits).collect()) == [(50, 1, 0), (100, 2, 2)]


def test_checkpoints_need_a_shared_folder(spark, monkeypatch):
    assert storage.is_local(spark)
    monkeypatch.setattr(storage, "is_local", lambda _: False)
    fake = type("Session", (), {"sparkContext": spark.sparkContext, "conf": spark.conf})
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.shared_folder(fake)
    with pytest.raises(BedError, match="local mode"), bed.spooled_stdin(fake):
        pass


def test_write_parts_and_stream(spark, tmp_path):
    lines = bed6(400)
    records = bed.read_bed(spark, put(tmp_path / "a.bed", lines))[1]
    text.write_parts(order.sort_records(records), str(tmp_path / "parts"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "parts").glob("part-*"))).splitlines() == gnu(lines, "-k1,1", "-k2,2n")


def test_streaming_collapse(spark, tmp_path):
    from strandmill.streaming.collapse_stream import collapsed_stream

    folder = tmp_path / "in"
    folder.mkdir()
    put(folder / "1.bed", ["# x", "chr1\t5\t6\ta\t2\t+"])
    put(folder / "2.bed", ["chr1\t5\t9\tb\t3\t-"])
    query = collapsed_stream(spark, str(folder)).writeStream.outputMode("complete").format("memory").queryName("collapsed").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.table("collapsed").collect()] == [("chr1", 5, 6, 5.0)]


def test_manifest_is_plain_json(spark, tmp_path):
    path = write(spark, tmp_path, ["chr1\t1\t2"], "--key-prefix", "own")
    keys = {k.decode() for k in pq.read_metadata(path).metadata}
    assert "own_manifest" in keys
    manifest = json.loads(pq.read_metadata(path).metadata[b"own_manifest"])
    assert manifest["format_version"] == 2 and manifest["sort_keys"] == schema.SORT_KEYS and manifest["coord_dtype"] == "int32"
