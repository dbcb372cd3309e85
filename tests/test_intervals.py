"""Sweeps over ranges against brute force over every base."""

import random

import pytest
from pyspark.sql import functions as F

from strandmill.operators import intervals, ranges

KINDS = "Chromosome string, Start int, End int"


def drawn(rng, n, most=400, whole=True):
    rows = [(rng.choice("abc"), s := rng.randrange(most), s + rng.choice([0, 1, 3, 9, 40])) for _ in range(n)]
    rows += rows[:10] * 3  # equal rows
    if whole:
        rows += [("a", 0, most + 90), ("c", 5, 6), (None, 1, 2), ("b", None, 4), ("b", 9, 4)]  # a chromosome-long one, and rows that cover nothing
    rng.shuffle(rows)
    return rows


def depth(rows):
    found = {}
    for c, s, e in rows:
        if c is not None and s is not None:
            for x in range(s, e):
                found[c, x] = found.get((c, x), 0) + 1
    return found


def stretches(bases):
    """(chromosome, start, end, value) of the longest stretches of equal value."""
    out = []
    for (c, x), v in sorted(bases.items()):
        if out and out[-1][0] == c and out[-1][2] == x and out[-1][3] == v:
            out[-1] = (c, out[-1][1], x + 1, v)
        else:
            out.append((c, x, x + 1, v))
    return out


def frame(spark, rows, kinds=KINDS):
    return spark.createDataFrame(rows, kinds).repartition(5)


@pytest.fixture
def many(spark):
    """More ranges than rows need, so that results carry over boundaries."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("seed", range(3))
def test_coverage_and_sets(many, seed):
    rng = random.Random(seed)
    left, right = drawn(rng, 60, whole=seed != 1), drawn(rng, 40, whole=seed == 2)
    a, b = frame(many, left), frame(many, right)
    mine = lambda df: sorted(tuple(r) for r in df.collect())
    assert mine(intervals.coverage(a)) == stretches(depth(left))
    da, db = depth(left), depth(right)
    only = [x[:3] for x in stretches({k: 1 for k in da if k not in db})]
    both = [x[:3] for x in stretches({k: 1 for k in da if k in db})]
    assert mine(intervals.subtracted(a, b)) == only
    assert mine(intervals.intersected(a, b)) == both
    sizes = {"a": 450, "b": 100, "d": 7}
    free = [x[:3] for x in stretches({(c, x): 1 for c, n in sizes.items() for x in range(n) if (c, x) not in da})]
    assert mine(intervals.complement(a, many.createDataFrame(list(sizes.items()), "name string, length long"))) == free


@pytest.mark.parametrize("gap", [0, 5])
def test_merged(many, gap):
    rng = random.Random(gap)
    for whole in (False, True):
        rows = drawn(rng, 50, most=900, whole=whole)
        want = []
        for c, s, e in sorted(r for r in rows if r[0] is not None and r[1] is not None and r[2] > r[1]):
            if want and want[-1][0] == c and s <= want[-1][2] + gap:
                want[-1] = (c, want[-1][1], max(e, want[-1][2]), want[-1][3] + 1)
            else:
                want.append((c, s, e, 1))
        got = intervals.merged(frame(many, rows), gap).select("Chromosome", "Start", "End", "records").collect()
        assert sorted(tuple(r) for r in got) == want


def test_closest(many):
    rng = random.Random(4)
    left = [(*r, i) for i, r in enumerate(drawn(rng, 70))] + [("only", 3, 4, 999)]
    right = [(*r, f"n{i % 7}") for i, r in enumerate(drawn(rng, 25, whole=False))] + [("a", 0, 2000, "n0"), (None, 1, 2, "x"), ("b", 1, None, "x")]
    got = {r["i"]: tuple(r)[4:] for r in intervals.closest(frame(many, left, KINDS + ", i int"), frame(many, right, KINDS + ", name string")).collect()}
    assert len(got) == len(left)
    for c, s, e, i in left:
        best = (None,) * 4
        if c is not None and s is not None:
            own = [r for r in right if r[0] == c and r[1] is not None and r[2] is not None]
            back = max(((x[2], x[1], x[3]) for x in own if x[1] < e), default=None)
            forth = min(((x[1], x[2], x[3]) for x in own if x[1] >= e), default=None)
            if back and (not forth or max(s - back[0], 0) <= forth[0] - e):
                best = (back[1], back[0], back[2], max(s - back[0], 0))
            elif forth:
                best = (*forth, forth[0] - e)
        assert got[i] == best, (c, s, e)


def test_empty_tables(spark):
    none = spark.createDataFrame([], KINDS)
    some = spark.createDataFrame([("a", 1, 5)], KINDS)
    assert intervals.merged(none).collect() == intervals.coverage(none).collect() == intervals.closest(none, some).collect() == intervals.subtracted(none, some).collect() == []
    assert [tuple(r) for r in intervals.subtracted(some, none).collect()] == [("a", 1, 5)]
    assert [tuple(r) for r in intervals.closest(some, none).collect()] == [("a", 1, 5, None, None, None)]


def test_running_and_neighbours_over_empty_ranges(many):
    rows = ranges.in_order(many.createDataFrame([(i, i % 3) for i in range(20)], "x int, v int"), "x").where("x % 5 = 0 or x > 15")
    out = ranges.running(rows, F.sum, inclusive=True, up=F.col("v"))
    out = ranges.neighbour(ranges.running(out, F.max, reverse=True, later=F.col("v")), "before", F.struct("x"))
    got = sorted(ranges.neighbour(out, "behind", F.struct("x"), 1).collect())
    keep = [i for i in range(20) if i % 5 == 0 or i > 15]
    assert [r["x"] for r in got] == keep
    assert [r["up"] for r in got] == [sum(j % 3 for j in keep if j <= i) for i in keep]
    assert [r["later"] for r in got] == [max((j % 3 for j in keep if j > i), default=None) for i in keep]
    assert [r["before"] and r["before"]["x"] for r in got] == [None, *keep[:-1]]
    assert [r["behind"] and r["behind"]["x"] for r in got] == [*keep[1:], None]


def test_running_maximum_in_order_needs_one_exchange(many):
    """Against the windows' version; a chromosome over all ranges, and many short ones."""
    from strandmill.operators import derive, order
    from strandmill.sources import locus_parquet

    rng = random.Random(6)
    rows = [("long", s := rng.randrange(5000), s + rng.choice([1, 9, 2000])) for _ in range(600)] + [(f"c{rng.randrange(90)}", s := rng.randrange(50), s + 5) for _ in range(300)]
    loci = frame(many, rows)
    sorted_rows = order.sort_records(loci, "b", False, (), chrom="Chromosome", start="Start", end="End")
    got = [tuple(r) for r in derive.max_end_in_order(sorted_rows).collect()]
    want = sorted(tuple(r) for r in derive.max_end_so_far(loci).select("Chromosome", "Start", "End", "MaxEndSoFar").collect())
    assert got == want
    plan = locus_parquet.table_rows(loci)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # the sort's one came before the written rows
    assert derive.max_end_in_order(sorted_rows.limit(0)).collect() == []
