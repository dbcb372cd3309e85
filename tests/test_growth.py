"""Plans whose work must not outgrow their input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandmill.operators import derive, order, ranges
from strandmill.plans import catalog, strategy
from strandmill.sources import bed, ordered, text


def records(spark, n=3000):
    rng = random.Random(11)
    rows = [(rng.choice(["chr1", "chr2", "chr10"]), s := rng.randrange(200_000), s + 5, f"n{i}") for i in range(n)]
    table = spark.createDataFrame(rows, "chrom string, start int, end int, name string")
    return table.withColumn("value", F.concat_ws("\t", *[F.col(c).cast("string") for c in table.columns]))


def test_passes_do_not_grow_with_the_input(spark, monkeypatch):
    """A budget of a hundredth of the input: a bounded number of passes, whole and in order, also with widened buckets."""
    table = records(spark)
    want = [r["value"] for r in table.orderBy("chrom", "start", "value").collect()]
    for most in (strategy.MOST_BUCKETS, 20):
        monkeypatch.setattr(strategy, "MOST_BUCKETS", most)
        pieces = list(strategy.multi_pass(table, 1_500, 8))
        assert 2 <= len(pieces) <= strategy.MOST_PASSES + 2
        assert [r["value"] for p in pieces for r in p.collect()] == want


def test_lines_are_written_by_all_tasks(spark, tmp_path):
    """One file, header first, of which no task writes all."""
    table = records(spark).repartition(6).select("value", F.spark_partition_id().alias("p")).cache()
    written, parts = [], ordered.written_parts
    try:
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(ordered, "written_parts", lambda rows, pack: written.append(parts(rows, pack)) or written[-1])
            text.write_shared(table, f"file:{tmp_path}/lines", ["# a", "track b"])
    finally:
        table.unpersist()
    got = (tmp_path / "lines").read_text().splitlines()
    assert got[:2] == ["# a", "track b"] and sorted(got[2:]) == sorted(r["value"] for r in table.collect())
    assert len(written[0]) == 6 and max(size for _, size, _ in written[0]) < sum(size for _, size, _ in written[0]) / 3
    header, rows = bed.read_bed(spark, f"file:{tmp_path}/lines")
    assert header == ["# a", "track b"] and rows.count() == 3000


def test_ranges_grow_with_the_rows_and_passes_need_no_exchange(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 100)
    rows = ranges.in_order(spark.range(0, 3000, 1, 3).select((F.col("id") * 7919 % 3000).alias("x")), "x", size=3000)
    assert rows.rdd.getNumPartitions() == 30 and spark.conf.get("spark.sql.shuffle.partitions") == "8"
    out = ranges.neighbour(ranges.running(rows, F.sum, inclusive=True, up=F.col("x")), "before", F.struct("x"))
    assert [(r["up"], r["before"] and r["before"]["x"]) for r in out.orderBy("x").collect()] == [(i * (i + 1) // 2, i - 1 if i else None) for i in range(3000)]
    assert "hashpartitioning(__part" not in out._jdf.queryExecution().executedPlan().toString()


def test_inversions_write_nothing(spark, monkeypatch):
    """Counted in one pass, also over range boundaries and with nulls."""
    monkeypatch.setattr(ranges.storage, "cut", lambda df: 1 / 0)
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([1, 2, None])) for i in range(500)]
    table = spark.createDataFrame(rows, "i int, c string, x int").repartition(7)
    key = lambda r: ((r[1] is not None, r[1] or ""), (r[2] is not None, r[2] or 0))
    assert order.inversions(table.orderBy("i"), "c", "x").first()[0] == sum(key(b) < key(a) for a, b in zip(rows, rows[1:], strict=False))
    assert order.inversions(table.where("i < 0"), "c", "x").first()[0] == 0


def test_collapse_locus_sorts_once(spark, tiny):
    assert "Join" not in catalog.collapse_locus(spark, tiny)._jdf.queryExecution().executedPlan().toString()


def test_runs_of_the_external_plan_are_bounded_in_number(spark, monkeypatch):
    """The driver gets a sample of every run."""
    monkeypatch.setattr(strategy, "MOST_RUNS", 10)
    table = records(spark)
    out = strategy.external(table, 1_000)
    assert out.rdd.getNumPartitions() <= 10
    assert [r["value"] for r in out.collect()] == [r["value"] for r in table.orderBy("chrom", "start", "value").collect()]


def test_run_boundaries_move_rows_once(spark):
    out = derive.run_boundaries(records(spark).orderBy("start", "value"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Sort \[__part[^\]]*__id", plan)  # only counts and edges, a row a range, are dealt
    rows = sorted((r["rn"], r["chrom"], r["new_run"]) for r in out.collect())
    assert [n for n, _, _ in rows] == list(range(1, 3001))
    assert [new for _, _, new in rows] == [i == 0 or rows[i - 1][1] != c for i, (_, c, _) in enumerate(rows)]
