"""Sharding by sampled splitters, in DataFrame functions only.

Order: records are ranged by key, the 64-bit hash of the text, so equal texts lie together. Splitters are quantiles of a
size-weighted sample of the keys; they deal the records into fine ranges of about equal bytes. Texts of more than 1 /
LARGE_PER_SHARD of a shard are placed first, largest to lightest: their number is bounded by that share. Copies of one text stay together up to half a
shard; beyond, large ones are placed one by one, and small ones get a range of their own, which like every overfull range
is subdivided by a hash of the id, so no range has to fit a hot group. A range is overfull beyond CELL_BYTES too, so what a task sorts is bounded at
any size of the input. Exact byte sums of the parts, a row for each, then place every record at
its offset in the total, and the offset decides the shard: sizes come out equal up to 1 / LARGE_PER_SHARD or so.

Defined cases: a null text has 0 bytes and crc32 0; a null id is an id; repeated rows are separate records with slots
of their own; an empty table gives an empty result; columns other than id and text are not read, so their names never
clash. Copies of one text stay in one shard unless they exceed half of one.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm import textkit
from strandmill.llm.textkit import range_of

RANGES_PER_SHARD = 8
CELL_BYTES = 256_000_000  # of a range, beyond which it is subdivided, so that tasks don't grow with the input
DRAWS_PER_RANGE = 40
LARGE_PER_SHARD = 200
ROW_OVERHEAD = 8


def sample_splitters(base: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantile boundaries of a sample in which each record is drawn in proportion to its size.

    About ranges * DRAWS_PER_RANGE draws are expected whatever the input's size; a hash of the record stands in for a
    random number, so reruns agree.
    """
    luck = F.pmod(F.xxhash64("doc_id", "text_key", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    draws = F.floor(F.col("size") * F.lit(ranges * DRAWS_PER_RANGE / total) + luck)
    rows = base.select("text_key", draws.alias("draws")).where("draws > 0").groupBy("text_key").agg(F.sum("draws").alias("draws")).orderBy("text_key").collect()
    drawn = sum(r["draws"] for r in rows)
    bounds, seen = [], 0
    for r in rows:
        seen += r["draws"]
        if seen * ranges >= drawn * (len(bounds) + 1) and len(bounds) < ranges - 1:
            bounds.append(r["text_key"])
            while len(bounds) < ranges - 1 and seen * ranges >= drawn * (len(bounds) + 1):
                bounds.append(r["text_key"])
    return sorted(set(bounds))


def place_large(units: list[tuple[int, int, int]], total: int, shards: int) -> tuple[list[tuple[int, int, int]], list[float]]:
    """([(key, copy, shard)], room) for (size, key, copy): the largest first, each to the lightest shard; room is what the rest adds to each
    shard so that all come to one level, or to none where a shard is above it already."""
    heap = [(0, i) for i in range(shards)]
    homes, loads = [], [0] * shards
    for size, key, copy in sorted(units, reverse=True):
        load, i = heapq.heappop(heap)
        homes.append((key, copy, i))
        loads[i] = load + size
        heapq.heappush(heap, (loads[i], i))
    rest, level, below = total - sum(loads), 0.0, sorted(loads)
    for k in range(1, shards + 1):
        level = (rest + sum(below[:k])) / k
        if k == shards or level <= below[k]:
            break
    return homes, [max(level - load, 0.0) for load in loads]


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every record; and a column of docs that numbers its rows, if named."""
    own = [carry] if carry else []
    base = textkit.cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + ROW_OVERHEAD).alias("size"),
            F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"),
            *own,
        )
    )
    total = base.agg(F.sum("size").alias("s")).first()["s"]
    if not total:
        return base.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *own)
    ranges = shards * RANGES_PER_SHARD
    most = min(total / ranges, CELL_BYTES)
    # At most shards * LARGE_PER_SHARD texts, copies together, can be so large, whatever the input's size.
    large = base.groupBy("text_key").agg(F.sum("size").alias("s"), F.count("*").alias("n")).where(F.col("s") * (shards * LARGE_PER_SHARD) >= total).collect()
    shard = total / shards
    many = [r for r in large if r["s"] > shard / 2 and r["n"] > 1]  # copies that don't fit one shard well
    apart = [r for r in many if r["s"] / r["n"] * LARGE_PER_SHARD >= shard]  # of large texts: each copy has its own place
    hot = [r["text_key"] for r in many if r not in apart]
    units = [(r["s"], r["text_key"], 0) for r in large if r not in many] + [(r["s"] // r["n"], r["text_key"], i) for r in apart for i in range(r["n"])]
    homes, room = place_large(units, total, shards)
    rest = base
    if homes:
        table = F.broadcast(base.sparkSession.createDataFrame(homes, "text_key long, copy int, home int"))
        number = F.row_number().over(Window.partitionBy("text_key").orderBy("doc_id")) - 1
        rest, chosen = base.join(table.select("text_key").distinct(), "text_key", "left_anti"), base.join(F.broadcast(table.select("text_key").distinct()), "text_key")
        several = F.col("text_key").isin([r["text_key"] for r in apart]) if apart else F.lit(False)
        numbered = chosen.where(several).withColumn("copy", number).unionByName(chosen.where(~several).withColumn("copy", F.lit(0)))
        alone = numbered.join(table, ["text_key", "copy"])
    base, total = rest, sum(room)
    bounds = sorted({*(sample_splitters(base, total, ranges) if total else []), *hot, *(k - 1 for k in hot)})
    ranged = base.withColumn("range", range_of(F.col("text_key"), bounds))
    sums = ranged.groupBy("range").agg(F.sum("size").alias("s"))
    overfull = {r["range"]: int(r["s"] / most) + 1 for r in sums.where(F.col("s") > 1.5 * most).collect()}
    is_hot = F.col("text_key").isin(hot) if hot else F.lit(False)
    parts = F.lit(1)
    for number, into in overfull.items():
        parts = F.when(F.col("range") == number, F.lit(into)).otherwise(parts)
    # An overfull range without a hot text is divided by key, a hot text's range by id.
    luck = F.when(is_hot, F.xxhash64("doc_id", F.lit("part"))).otherwise(F.xxhash64("text_key", F.lit("part")))
    ranged = ranged.withColumn("hot", is_hot).withColumn("part", F.pmod(luck, parts.cast("long")).cast("int"))

    cell = ["range", "part"]
    fore = Window.orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = ranged.groupBy(*cell).agg(F.sum("size").alias("s")).select(*cell, F.coalesce(F.sum("s").over(fore), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*cell).orderBy("text_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(cells), cell).withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    start = F.when(F.col("hot"), F.col("at")).otherwise(F.min("at").over(Window.partitionBy(*cell, "text_key")))
    ends = [sum(room[: i + 1]) for i in range(shards - 1)]  # a shard takes the rest up to its room
    placed = placed.withColumn("shard", F.size(F.filter(F.array(*[F.lit(float(e)) for e in ends]), lambda e: e <= start))) if ends else placed.withColumn("shard", F.lit(0))
    columns = ["doc_id", "size", "text_crc32", "text_key", *cell, "at", "shard", *own]
    placed = placed.select(*columns)
    if homes:
        placed = placed.unionByName(alone.select("doc_id", "size", "text_crc32", "text_key", (-1 - F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(64))).cast("int").alias("range"), F.col("home").alias("part"), F.lit(0).cast("long").alias("at"), F.col("home").alias("shard"), *own))
    placed = textkit.cut(placed)

    # Slots: rows of the shard in the cells before, then the place within the cell.
    cell_in_shard = Window.partitionBy("shard").orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", *cell).agg(F.count("*").alias("n")).select("shard", *cell, F.coalesce(F.sum("n").over(cell_in_shard), F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("shard", *cell).orderBy("at", "text_key", "doc_id"))
    return placed.withColumn("within", within).join(F.broadcast(counts), ["shard", *cell]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("ahead") + F.col("within") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *own
    )


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the documents under path/shard=N, one folder a shard, in the order of slots. Rows are numbered and written first, so that each meets
    its own place whatever its id."""
    opened = tuple(dict.fromkeys((id_col, text_col)))
    rows = textkit.cut(textkit.sealed(docs, opened, number=F.monotonically_increasing_id()))
    placed = shard_by_bytes(rows, shards, id_col, text_col, "number").select("number", F.col("shard").alias("its_shard"), "slot")
    ordered = rows.join(placed, "number").repartitionByRange("its_shard", "slot").sortWithinPartitions("its_shard", "slot")
    named = textkit.unsealed(ordered, docs.columns, opened, F.col("its_shard").alias("shard"))
    named.write.partitionBy("shard").parquet(path)
