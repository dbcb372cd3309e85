"""Joins of overlapping intervals, row groups chosen for regions, the index in blocks."""

import random

import pytest
from pyspark.sql import functions as F

from strandmill.operators import derive, region
from strandmill.sources import locus_parquet

REGIONS = "q_chrom string, q_start int, q_end int"


def drawn(rng, n, most=3_000_000):
    rows = [(rng.choice(["chr1", "chr2"]), s := rng.randrange(most), s + rng.choice([0, 1, 50, 1023, 1024, 1025, 20_000, 300_000])) for _ in range(n)]
    return rows + [("chr1", 0, 250_000_000), ("chr2", 1024, 2048), ("chr2", 2048, 2049), (None, 1, 2), ("chr1", None, 2)] + rows[:5] * 2


def test_overlap_join_equals_brute_force(spark):
    rng = random.Random(3)
    left, right = drawn(rng, 300), drawn(rng, 200)
    a = spark.createDataFrame([(*r, i) for i, r in enumerate(left)], "Chromosome string, Start int, End int, i int").repartition(4)
    b = spark.createDataFrame([(*r, i) for i, r in enumerate(right)], REGIONS + ", j int").repartition(3)
    joined = region.overlap_join(a, b)
    assert joined.columns == [*a.columns, *b.columns]
    want = sorted((i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x[0] and x[0] == y[0] and None not in (x[1], y[1]) and x[1] < y[2] and x[2] > y[1])
    assert sorted((r["i"], r["j"]) for r in joined.collect()) == want
    assert region.overlap_join(a.limit(0), b).collect() == region.overlap_join(a, b.limit(0)).collect() == []


def test_a_long_interval_lies_in_few_bins(spark):
    levels = list(region.LEVELS)
    rows = spark.createDataFrame([("chr1", 5, 250_000_000), ("chr1", 1000, 1030), ("chr1", 0, 0)], REGIONS)
    binned = region._binned(rows, "q_start", "q_end", levels, "__own", "__first").groupBy("q_end").count().collect()
    assert {r["q_end"]: r["count"] for r in binned} == {250_000_000: 1 + (levels[-1] < 28), 1030: 2 + len(levels) - 1, 0: len(levels)}


def test_only_touched_row_groups_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(locus_parquet, "PART_BLOCK", 20_000)  # many row groups
    monkeypatch.setattr(locus_parquet, "FOOTERS", 3)
    monkeypatch.setattr(locus_parquet, "FEW_REGIONS", 2)
    n = 120_000
    loci = spark.range(n).select(F.concat(F.lit("chr"), (F.col("id") % 3).cast("string")).alias("Chromosome"), (F.col("id") * 40).cast("int").alias("Start"), (F.col("id") * 40 + F.when(F.col("id") == 0, 3_000_000).otherwise(60)).cast("int").alias("End"), F.sha2(F.col("id").cast("string"), 256).alias("Name"))
    folder = str(tmp_path / "d.locus")
    locus_parquet.write_locus_parts(loci, folder)
    groups = locus_parquet.row_groups(spark, folder)
    assert groups.agg(F.sum("rows")).first()[0] == n and groups.count() > 20
    where = [("chr1", s, s + 100) for s in (40_000, 41_000, 4_000_000)] + [("chr2", 900_000, 900_010), ("chr9", 0, 5)]
    regions = spark.createDataFrame(where, REGIONS)
    read = locus_parquet.touched(groups, regions).agg(F.sum("rows")).first()[0]
    assert 0 < read < n / 4
    got = sorted((r["Name"], r["q_start"]) for r in locus_parquet.read_regions(spark, folder, regions).collect())
    rows = loci.collect()
    assert got == sorted((r["Name"], q[1]) for r in rows for q in where if r["Chromosome"] == q[0] and r["Start"] < q[2] and r["End"] > q[1])
    few = regions.limit(2)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = locus_parquet.read_regions(spark, folder, few)._jdf.queryExecution().toString()
    pushed = plan.split("PushedFilters: ", 1)[1].split("ReadSchema")[0]
    assert "Or(" in pushed and "40100" in pushed, pushed
    assert locus_parquet.read_regions(spark, folder, regions.limit(0)).collect() == []
    # The one locus that spans chr0 is found through the running maximum.
    far = spark.createDataFrame([("chr0", 2_900_000, 2_900_001)] * 3, REGIONS)
    assert locus_parquet.read_regions(spark, folder, far).where("End - Start > 60").count() == 3


@pytest.mark.parametrize("rows", [7, 1000])
def test_index_in_blocks(spark, tmp_path, rows):
    rng = random.Random(rows)
    own = [(rng.choice("ab"), s := rng.randrange(2000), s + rng.choice([1, 5, 900])) for _ in range(500)]
    loci = spark.createDataFrame(own, "Chromosome string, Start int, End int").repartition(5)
    folder = str(tmp_path / "index")
    derive.blocked_index(loci, block_rows=rows).write.parquet(folder)
    index = spark.read.parquet(folder)
    assert index.agg(F.max("rows")).first()[0] <= rows and index.agg(F.sum("rows")).first()[0] == 500
    order = sorted(own)
    for chrom, low, high in [("a", 0, 1), ("b", 700, 705), ("a", 1990, 4000), ("b", 0, 3000), ("c", 0, 9)]:
        want = [(i, s, e) for i, (c, s, e) in enumerate(order) if c == chrom and s < high and e > low]
        assert sorted(tuple(r) for r in region.blocked_lookup(index, chrom, low, high).collect()) == want
    if rows == 7:
        named = index.where("chromosome = 'a' and first_start < 60 and most_end > 50").count()
        assert 0 < named < index.where("chromosome = 'a'").count() / 4


def test_sketched_quantiles_keep_their_bound(spark):
    rows = spark.range(60_000).select((F.col("id") % 2).alias("k"), F.pmod(F.hash("id"), F.lit(5000)).cast("double").alias("x")).repartition(9)
    off = derive.quantile_errors(rows, "k", "x", [0.0, 0.1, 0.5, 0.99, 1.0], 500).collect()
    assert len(off) == 2 and all(r[f"off{i}"] <= r["n"] / 500 + 1 for r in off for i in range(5))
    exact = {r["k"]: r["m"] for r in rows.groupBy("k").agg(F.percentile("x", 0.5).alias("m")).collect()}
    assert all(abs(r["quantiles"][0] - exact[r["k"]]) <= 50 for r in derive.quantiles(rows, "k", "x", [0.5]).collect())
