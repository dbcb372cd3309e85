"""The trie of conversation prefixes, by smallest-member ownership.

A node is a distinct sequence of first turns; the conversations that start with it are its members. A node belongs to its smallest
member. Members only get fewer going down, so the nodes that a conversation owns are a suffix of its path: one depth says which. Each node has one
owner, which is a member of all nodes above it, so whatever is to be summed once for each node of a subtree can be summed over a node's members
instead: with the tokens of a member's path below a node less those of the nodes it owns, a subtree's repeated tokens are one sum by
prefix, as are its leaves and the node's children. No node is compared with another, and no list of members is built.

(1) One range sort on (conversation, turn, role, text) numbers the turns; from there on rows carry 128 bits of role and text, and the length
of the text. (2) Rebuilt paths get their prefixes' keys: a running exclusive or of hashes of (depth, turn). Windows and joins by conversation run over
blocks of BLOCK turns, whose totals carry over, so one conversation may hold any share of the rows. (3) A first group-by over prefixes
finds owners, (4) windows' running sums and the owned depth mark what each conversation adds at each depth, (5) a second group-by sums it. Both
group-bys only sum and take minima, so a prefix that a third of all conversations share arrives as one row a task. (6) A node's parent is
its owner's too, but where the owned suffix begins: there it is looked up, parents with very many children (at most HOT times the partitions) by
broadcast. (7) The digest of the members that end in a node takes them in order, as SHA-256 does: ranges of (prefix, conversation) pack
them into chunks of text, and a stream over the chunks of a prefix digests them, holding one batch at a time.

Defined cases: a null role or text is empty, a null turn comes first, equal turns follow by role and text, repeated rows are repeated
turns; rows of a null conversation belong to none; remainders have the sign of the conversation; a rebuilt path may be empty; an empty table has no node;
extra columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm import textkit
from strandmill.operators import order

BLOCK_SHIFT = 16  # turns of a block, as a power of two
MOST_HEAD = 8  # turns that a rebuilt conversation takes at most from another
GROUP = 5
HOT = 8
CHUNK = 1 << 20  # bytes of conversation numbers digested at once
NODE = ["p1", "p2"]


def _hashed(*columns) -> list:
    return [F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """c, i (from 0), t1, t2, w, last: the turns of each conversation in order, and whether none follows; written."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), "turn", *[F.coalesce(x, F.lit("")).alias(x) for x in ("role", "text")])
    t1, t2 = _hashed("role", "text")
    placed = order.numbered(rows.orderBy("c", F.asc_nulls_first("turn"), "role", "text").select("c", t1.alias("t1"), t2.alias("t2"), F.octet_length("text").cast("long").alias("w")))
    # Places are dealt by blocks of the whole order, so that a long conversation is many groups; the first place of each carries over.
    first = placed.groupBy("c").agg(F.min("rn").alias("first"), F.count("*").alias("n"))
    return textkit.cut(placed.withColumn("cell", F.shiftright("rn", BLOCK_SHIFT)).join(_cells(first), ["c", "cell"]).select("c", (F.col("rn") - F.col("first")).alias("i"), "t1", "t2", "w", "n"))


def _cells(first: DataFrame) -> DataFrame:
    """c, cell, first, n: each conversation once for every block of places that it has turns in."""
    ends = [F.shiftright(x, BLOCK_SHIFT) for x in (F.col("first"), F.col("first") + F.col("n") - 1)]
    return first.withColumn("cell", F.explode(F.sequence(*ends)))


def _blocks(table: DataFrame) -> DataFrame:
    """table (c, len and others), each conversation once for every block of its depths 0 to len."""
    return table.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("len", BLOCK_SHIFT))))


def rebuilt(turns: DataFrame) -> DataFrame:
    """c, depth, t1, t2, w, len: the paths that the query asks for. A conversation c takes its first h turns, h by its crc32, from c - c % GROUP."""
    h = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(MOST_HEAD + 1))
    own = turns.where("i = 0").select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % GROUP).alias("base"))
    sizes = own.select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    head = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = own.join(sizes, "base", "left").withColumn("head", head).withColumn("len", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = textkit.cut(convs.select("c", "base", "n", "h", "head", "len"))
    taken = turns.where(F.col("i") < MOST_HEAD).select(F.col("c").alias("base"), "i", "t1", "t2", "w").join(convs, "base").where("i < h")
    kept = turns.withColumn("block", F.shiftright("i", BLOCK_SHIFT)).drop("n").join(_blocks(convs.withColumn("path_len", F.col("len")).withColumn("len", F.col("n"))), ["c", "block"]).where("i >= h")
    root = convs.select("c", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(x) for x in ("t1", "t2", "w")], "len")
    return root.unionByName(taken.select("c", (F.col("i") + 1).alias("depth"), "t1", "t2", "w", "len")).unionByName(
        kept.select("c", (F.col("i") - F.col("h") + F.col("head") + 1).alias("depth"), "t1", "t2", "w", F.col("path_len").alias("len"))
    )


def prefixes(paths: DataFrame) -> DataFrame:
    """c, depth, len, block, p1, p2 (the prefix), a1, a2 (the one above), before (tokens above), tokens (down to here), from written rows."""
    at_root = F.col("depth") == 0
    steps = [F.when(at_root, F.lit(0).cast("long")).otherwise(s).alias(n) for s, n in zip(_hashed("depth", "t1", "t2"), ("s1", "s2"), strict=True)]
    rows = paths.select("c", "depth", "len", "w", *steps, F.shiftright("depth", BLOCK_SHIFT).alias("block"))
    so_far = Window.partitionBy("c", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = textkit.cut(rows.select("*", F.bit_xor("s1").over(so_far).alias("p1"), F.bit_xor("s2").over(so_far).alias("p2"), F.sum("w").over(so_far).alias("tokens")))
    long = rows.where((F.col("len") >= 1 << BLOCK_SHIFT) & ((F.col("depth") == F.col("len")) | (F.shiftright(F.col("depth") + 1, BLOCK_SHIFT) > F.col("block"))))
    if not long.isEmpty():  # the last row of each block holds its totals
        earlier = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        carry = long.select("c", "block", F.bit_xor("p1").over(earlier).alias("x1"), F.bit_xor("p2").over(earlier).alias("x2"), F.sum("tokens").over(earlier).alias("x")).where("block > 0")
        carried = rows.join(carry, ["c", "block"], "left")
        add = lambda a, b: F.col(a).bitwiseXOR(F.coalesce(b, F.lit(0)))
        rows = carried.withColumns({"p1": add("p1", "x1"), "p2": add("p2", "x2"), "tokens": F.col("tokens") + F.coalesce("x", F.lit(0))})
    above = [F.col(p).bitwiseXOR(F.col(s)).alias(a) for p, s, a in (("p1", "s1", "a1"), ("p2", "s2", "a2"))]
    rows = rows.select("c", "depth", "len", "block", *NODE, *above, (F.col("tokens") - F.col("w")).alias("before"), "tokens")
    return rows


def marked(rows: DataFrame) -> DataFrame:
    """rows with what each adds to its node: saves, children, leaf; and first, the depth from which on the conversation owns its path."""
    nodes = rows.groupBy(*NODE).agg(F.min("c").alias("c"), F.max("len").alias("deepest"), F.min("depth").alias("depth"), F.min("before").alias("before"))
    owners = nodes.groupBy("c").agg(F.min(F.struct("depth", "before")).alias("top"), F.max((F.col("depth") == F.col("deepest")).cast("long")).alias("leaf"))
    # A conversation's last row knows all its tokens; one that owns nothing repeats them all.
    whole = rows.where("depth = len").select("c", "len", F.col("tokens").alias("all"))
    convs = whole.join(owners, "c", "left").select("c", "len", F.col("top.depth").alias("first"), F.coalesce("top.before", "all").alias("unowned"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    told = rows.join(_blocks(convs).drop("len"), ["c", "block"])
    child = (F.col("depth") + 1 >= F.col("first")) & (F.col("depth") < F.col("len"))
    return told.withColumns({"saves": F.greatest(F.col("unowned") - F.col("before"), F.lit(0)), "children": F.coalesce(child, F.lit(False)).cast("long")})


def _parents(nodes: DataFrame) -> DataFrame:
    """nodes with parent_conv_id: the owner's where the owner owns the parent too, looked up elsewhere."""
    inherits = F.col("depth") > F.col("first")
    known = nodes.where(inherits).withColumn("parent_conv_id", F.col("conv_id"))
    rest = nodes.where(~inherits)
    parents = nodes.where("n_children > 0").select(F.col("p1").alias("a1"), F.col("p2").alias("a2"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") * (HOT * textkit.partitions(nodes.sparkSession)) > nodes.count()).alias("hot"))
    above = ["a1", "a2"]
    few = textkit.small(textkit.cut(parents.where("hot").drop("hot")))
    met = rest.where("depth > 0").join(few, above, "left")
    found = met.where("parent_conv_id is not null")
    looked = met.where("parent_conv_id is null").drop("parent_conv_id").join(parents.where("not hot").drop("hot"), above, "left")
    root = rest.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return known.unionByName(found).unionByName(looked).unionByName(root)


def end_digests(rows: DataFrame) -> DataFrame:
    """p1, p2, ends_sha256 of the prefixes in which conversations end."""
    n = textkit.partitions(rows.sparkSession)

    def pack(batches):
        """Chunks of the numbers of a prefix in order, from rows in order."""
        key, first, parts, size = None, None, [], 0
        for batch in batches:
            out = []
            for p1, p2, c in zip(*(batch.column(x).to_pylist() for x in ("p1", "p2", "c")), strict=True):
                if (p1, p2) != key or size >= CHUNK:
                    if parts:
                        out.append((*key, first, ",".join(parts)))
                    key, first, parts, size = (p1, p2), c, [], 0
                parts.append(str(c))
                size += len(parts[-1]) + 1
            yield chunks(out)
        if parts:
            yield chunks([(*key, first, ",".join(parts))])

    def chunks(out):
        return pa.RecordBatch.from_pylist([dict(zip(("p1", "p2", "c", "ids"), r, strict=True)) for r in out], pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("c", pa.int64()), ("ids", pa.string())]))

    def digest(batches):
        """The digest of each prefix's chunks, which come in order."""
        key, state = None, None
        for batch in batches:
            out = []
            for p1, p2, ids in zip(*(batch.column(x).to_pylist() for x in ("p1", "p2", "ids")), strict=True):
                if (p1, p2) == key:
                    state.update(b",")
                else:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = (p1, p2), hashlib.sha256()
                state.update(ids.encode())
            yield digests(out)
        if key:
            yield digests([(*key, state.hexdigest())])

    def digests(out):
        return pa.RecordBatch.from_pylist([dict(zip(("p1", "p2", "ends_sha256"), r, strict=True)) for r in out], pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("ends_sha256", pa.string())]))

    ends = rows.where("depth = len").select(*NODE, "c").repartitionByRange(n, *NODE, "c").sortWithinPartitions(*NODE, "c")
    packed = ends.mapInArrow(pack, "p1 long, p2 long, c long, ids string").repartition(n, *NODE).sortWithinPartitions(*NODE, "c")
    return packed.mapInArrow(digest, "p1 long, p2 long, ends_sha256 string")


def nodes(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node of the rebuilt conversations."""
    rows = prefixes(rebuilt(numbered_turns(conversations)))
    sums = marked(rows).groupBy(*NODE).agg(
        F.min(F.struct("c", "first")).alias("owner"), F.min("depth").alias("depth"), F.min("a1").alias("a1"), F.min("a2").alias("a2"), F.count("*").alias("n_convs"),
        F.sum("children").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saves").alias("saved_tokens"),
    )
    found = textkit.cut(sums.select(*NODE, "a1", "a2", F.col("owner.c").alias("conv_id"), F.col("owner.first").alias("first"), "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"))
    full = _parents(found).join(end_digests(rows), NODE, "left")
    empty = hashlib.sha256(b"").hexdigest()
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
