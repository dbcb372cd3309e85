"""Approximate nearest neighbours by inner product over shifted space-filling curves.

Equal vectors are searched once: a group keeps its KEEP least ids, more can't be among the nearest. Each of CURVES
Hilbert curves orders the groups by the cell of a random, variance-weighted projection with a random shift; quantiles of
the keys cut a curve into ranges. A query looks at its own range on every curve first, which gives its least score
worth keeping, then at the WINDOW ranges on either side; the answers of all windows merge and are ranked on the original
vectors in double precision. Cells are (curve, range, piece) in that order, a range of more than PIECE groups being cut into pieces by a
hash; Spark ranges rows by cell, each group lies once on every curve, and a task holds the candidates of one cell and
streams that cell's queries past them, however many there are. A query whose windows hold fewer groups than asked for, though
the table has more, looks at all of the first curve.

The projection is fitted on SAMPLE groups (bounded, by a hash); every vector is indexed. The share of a curve that a query sees sets
recall, and work grows with queries times that share. The number of ranges is the largest at which the sample, searched
by brute force, keeps a recall of RECALL, BLOCKS at least: vectors with few effective dimensions get many narrow ranges; for vectors without any such
structure no share below that of BLOCKS reaches 0.9.

Defined cases: vectors null, zero, or with null or non-finite components take no part, nor do rows with a null id or of
another length than most; rows repeated with the same id count once; ties go to the smaller id; fewer candidates than
asked for are all returned; an empty table gives an empty result; columns other than id and vector are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm import textkit
from strandmill.llm.hilbert import hilbert_keys

CURVES = 6
BLOCKS = 16
WINDOW = 2
DIMS, BITS = 10, 6
LEAST_BLOCK = 64
SAMPLE = 4_096
ASKED = 256  # groups of the sample whose neighbours are searched by brute force, to choose the number of ranges
RECALL = 0.95
PIECE = 32_768
SALTS = 32
SLACK = 1e-9  # matrix products round otherwise than row sums; what is this close is kept and ranked exactly


def _matrix(column) -> np.ndarray:
    """The float vectors of an Arrow list column as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector, gid (the group of equal vectors) of the rows that take part."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("id is not null and vector is not null").where(F.size("vector") > 0)
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    length = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("vector") == F.lit(length["d"] if length else 0))
    return rows.withColumn("gid", F.xxhash64("vector"))


class Curves:
    """The projections of all curves: cells of the projected, scaled and shifted vectors, as Hilbert keys."""

    def __init__(self, sample: np.ndarray):
        self.mean = sample.mean(axis=0)
        d = sample.shape[1]
        dims = min(DIMS, d)
        values, axes = np.linalg.eigh(np.cov(sample.T).reshape(d, d) if len(sample) > 1 else np.eye(d))
        rng = np.random.default_rng(20240607)
        self.axes, self.scale, self.shift = [], [], []
        for _ in range(CURVES):
            q, _ = np.linalg.qr(axes * np.sqrt(np.maximum(values, 1e-12)) @ rng.standard_normal((d, dims)))
            self.axes.append(q)
            self.scale.append(np.maximum(((sample - self.mean) @ q).std(axis=0), 1e-12) * 6)
            self.shift.append(rng.uniform(0.4, 0.6, dims))

    def keys(self, x: np.ndarray, curve: int) -> np.ndarray:
        y = (x - self.mean) @ self.axes[curve] / self.scale[curve] + self.shift[curve]
        return hilbert_keys((np.clip(y, 0, 1 - 1e-9) * (1 << BITS)).astype(np.int64), BITS)


def ranges_for(sample: np.ndarray, curves: Curves, k: int) -> int:
    """The largest number of ranges, doubled from BLOCKS, at which windows find RECALL of the k nearest of each of the first ASKED rows among the sample."""
    n, asked = len(sample), np.arange(min(ASKED, len(sample)))
    if n < 2 * BLOCKS or not 0 < k < n:
        return BLOCKS
    place = np.stack([np.argsort(np.argsort(curves.keys(sample, c), kind="stable")) for c in range(CURVES)])
    scores = sample[asked] @ sample.T
    scores[asked, asked] = -np.inf
    true = np.argpartition(scores, n - k, axis=1)[:, n - k :]
    blocks = BLOCKS
    while 2 * blocks * LEAST_BLOCK <= 8 * n:  # some rows of the sample in each range
        block = place * (2 * blocks) // n
        seen = (np.abs(block[:, asked][:, :, None] - block[:, true]) <= WINDOW).any(axis=0)
        if seen.mean() < RECALL:
            break
        blocks *= 2
    return blocks


def nearest(table: DataFrame, every: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by `every`, the k nearest other rows found."""
    spark = table.sparkSession
    keep = k + 1
    rows = textkit.cut(usable(table, id_col, vector_col))
    asks = F.col("id") % every == 0
    groups = textkit.cut(rows.groupBy("gid").agg(F.first("vector").alias("vector"), F.min("id").alias("least"), F.max(asks).alias("asks")))
    sample = groups.orderBy(F.xxhash64("gid", F.lit("fit")), "gid").limit(SAMPLE).select("vector").collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sample:
        return empty
    curves = Curves(np.array([r["vector"] for r in sample], dtype=np.float64))

    def key_rows(batches):
        for batch in batches:
            x = _matrix(batch.column("vector"))
            for c in range(CURVES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(curves.keys(x, c))], ["curve", "key"])

    n_groups = groups.count()
    fitted = np.array([r["vector"] for r in sample], dtype=np.float64)
    blocks = max(1, min(ranges_for(fitted, curves, -(-k * len(sample) // n_groups)), n_groups // LEAST_BLOCK))
    cuts = [i / blocks for i in range(1, blocks)] or [1.0]
    quantiles = groups.select("vector").mapInArrow(key_rows, "curve int, key long").groupBy("curve").agg(F.percentile_approx("key", cuts, 10_000).alias("bounds")).collect()
    bounds = {r["curve"]: np.array(r["bounds"][: blocks - 1], dtype=np.int64) for r in quantiles}

    def block_of(x, c):
        return np.searchsorted(bounds[c], curves.keys(x, c), side="left")

    def block_rows(batches):
        for batch in batches:
            x = _matrix(batch.column("vector"))
            for c in range(CURVES):
                yield pa.RecordBatch.from_arrays([pa.array((c * blocks + block_of(x, c)).astype(np.int32))], ["block"])

    counts = groups.select("vector").mapInArrow(block_rows, "block int").groupBy("block").agg(F.count("*").alias("n")).collect()
    n_pieces = np.ones(CURVES * blocks, np.int64)
    for r in counts:
        n_pieces[r["block"]] = -(-r["n"] // PIECE)
    first_cell = np.concatenate([[0], np.cumsum(n_pieces)])
    names = ["cell", "asks", "gid", "least", "floor", "vector"]

    def file(batches):
        """Each group under its cell on every curve."""
        for batch in batches:
            x, gid = _matrix(batch.column("vector")), batch.column("gid").to_numpy()
            for c in range(CURVES):
                block = c * blocks + block_of(x, c)
                piece = (textkit.mix(gid.view(np.uint64)) % n_pieces[block].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(first_cell[block] + piece), pa.array(np.zeros(len(x), bool)), batch.column("gid"), batch.column("least"), pa.array(np.zeros(len(x))), batch.column("vector")], names)

    def probe(steps, on):
        """Each query under all cells of its windows."""

        def apply(batches):
            for batch in batches:
                x = _matrix(batch.column("vector"))
                for c in on:
                    home = block_of(x, c)
                    for step in steps:
                        some = np.flatnonzero((home + step >= 0) & (home + step < blocks))
                        block = c * blocks + home[some] + step
                        for p in range(int(n_pieces[block].max()) if len(some) else 0):
                            own = p < n_pieces[block]
                            at = pa.array(some[own])
                            yield pa.RecordBatch.from_arrays([pa.array(first_cell[block[own]] + p), pa.array(np.ones(len(at), bool)), *(batch.column(n).take(at) for n in names[2:])], names)

        return apply

    def compared(q, query, floor, x, gid, least):
        """The candidates x of a cell that are among its `keep` best for a query and reach the query's floor."""
        step = max(1, 2_000_000 // len(x))
        for a in range(0, len(q), step):
            s = q[a : a + step] @ x.T
            limit = floor[a : a + step] - SLACK
            if len(x) > keep:
                limit = np.maximum(limit, np.partition(s, len(x) - keep, axis=1)[:, len(x) - keep] - SLACK)
            i, j = np.nonzero(s >= limit[:, None])
            exact = np.einsum("ij,ij->i", q[a + i], x[j])
            # Ties within rounding of the last place may pass the number asked for; only the first `keep` stay.
            order = np.lexsort((least[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            own = place < keep
            yield pa.RecordBatch.from_arrays([pa.array(query[a + i[own]]), pa.array(gid[j[own]]), pa.array(least[j[own]]), pa.array(exact[own])], ["query", "gid", "least", "score"])

    def answer(batches):
        """Rows come cell by cell, a cell's candidates before its queries."""
        cell, held, joined = None, [], None
        for batch in batches:
            cells, asks = batch.column("cell").to_numpy(), np.asarray(batch.column("asks"))
            cuts = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1]), [True]])).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = batch.slice(a, b - a)
                x, gid, least, floor = _matrix(own.column("vector")), *(own.column(n).to_numpy() for n in ("gid", "least", "floor"))
                if cells[a] != cell:
                    cell, held, joined = cells[a], [], None
                if not asks[a]:
                    held.append((x, gid, least))
                elif held:
                    if joined is None:
                        joined = [np.concatenate(c) for c in zip(*held, strict=True)]
                    yield from compared(x, gid, floor, *joined)

    kind = table.schema[vector_col].dataType.simpleString()
    schema = f"cell long, asks boolean, gid long, least long, floor double, vector {kind}"
    filed = groups.mapInArrow(file, schema)
    parts = max(textkit.partitions(spark), CURVES * n_groups // PIECE)

    def search(queries, steps, on=range(CURVES)):
        probes = queries.select("gid", F.lit(0).cast("long").alias("least"), "floor", "vector").mapInArrow(probe(steps, on), schema)
        ranged = filed.unionByName(probes).repartitionByRange(parts, "cell").sortWithinPartitions("cell", "asks")
        return ranged.mapInArrow(answer, "query long, gid long, least long, score double")

    def best(found):
        order = Window.partitionBy("query").orderBy(F.desc("score"), "least", "gid")
        once = found.groupBy("query", "gid").agg(F.max("score").alias("score"), F.min("least").alias("least"))
        return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)

    queries = groups.where("asks")
    at_home = textkit.cut(best(search(queries.withColumn("floor", F.lit(float("-inf"))), [0])))
    floors = at_home.where(F.col("place") == keep).select(F.col("query").alias("gid"), F.col("score").alias("floor"))
    floored = queries.join(floors, "gid", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = textkit.cut(best(at_home.drop("place").unionByName(search(floored, [s for s in range(-WINDOW, WINDOW + 1) if s]))))
    # A query whose windows hold fewer groups than wanted, though the table has more, looks at all of the first curve.
    short = found.groupBy("query").count().where(F.col("count") < min(keep, n_groups)).select(F.col("query").alias("gid"), F.lit(float("-inf")).alias("floor"))
    if not short.isEmpty():
        again = search(queries.join(short, "gid"), range(1 - blocks, blocks), [0])
        found = textkit.cut(best(found.drop("place").unionByName(again)))

    # The ids of the groups found: no more than `keep` of a group can be wanted; least by salt first, so no task sorts a whole group.
    members = rows.select("gid", "id").distinct()
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    few = salted.withColumn("n", F.row_number().over(Window.partitionBy("gid", "salt").orderBy("id"))).where(F.col("n") <= keep)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("gid").orderBy("id"))).where(F.col("n") <= keep).groupBy("gid").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    named = found.select("query", "gid", "score").join(few, "gid").select("query", "score", F.explode("ids").alias("id"))
    ranked = named.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("place") <= keep)
    answers = textkit.cut(ranked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("found")))
    asked = members.where(asks).select(F.col("gid").alias("query"), F.col("id").alias("query_id"))
    own = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    rows_out = asked.join(answers, "query").select("query_id", F.posexplode(own).alias("at", "hit"))
    return rows_out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
