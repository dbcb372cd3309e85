"""Blocked files by ranges of bytes, against serial reads; files put together from parts."""

import gzip
import os
import random
import struct

import pytest

from strandmill.operators import order
from strandmill.sources import bam, bed, bgzf, blocks, ordered, text


def blocked(raw, rng, most=300, empty=0.1):
    """raw as blocks of any sizes, some of them empty."""
    out, at = [], 0
    while at < len(raw):
        if rng.random() < empty:
            out.append(bgzf.block(b""))
        n = rng.randint(1, most)
        out.append(bgzf.block(raw[at : at + n], 0 if rng.random() < 0.2 else 6))
        at += n
    return b"".join([*out, bgzf.END_OF_FILE])


@pytest.mark.parametrize("end", ["\n", ""])
def test_lines_of_any_ranges_equal_a_serial_read(spark, tmp_path, end):
    rng = random.Random(len(end))
    lines = [f"chr{rng.randint(1, 3)}\t{i}\t{i + 1}\t{'x' * rng.choice([0, 1, 40, 900])}é" for i in range(400)]
    lines[7:7] = ["", ""]
    path = str(tmp_path / "a.bed.gz")
    with open(path, "wb") as f:
        f.write(blocked(("\n".join(lines) + end).encode(), rng))
    size = os.path.getsize(path)
    for split in (size + 1, size // 3, 997, 211):
        rows = bgzf.read_lines(spark, path, split)
        assert rows.rdd.getNumPartitions() == -(-size // split)
        got = rows.collect()
        assert [r["value"] for r in got] == lines
        assert [r["line_id"] for r in got] == sorted({r["line_id"] for r in got})
    header, records = bed.read_bed(spark, str(path)) if end else ([], None)
    assert records is None or records.count() == 400


def test_a_block_is_found_from_any_byte(tmp_path):
    rng = random.Random(5)
    parts = [bgzf.block(bytes(rng.choices(blocks.MAGIC, k=rng.randint(0, 60))), 0) for _ in range(60)]  # stored blocks full of false beginnings
    path = tmp_path / "m.gz"
    path.write_bytes(b"".join(parts))
    begins = [sum(map(len, parts[:i])) for i in range(len(parts))]
    filled = [b for b, p in zip(begins, parts, strict=True) if gzip.decompress(p)]
    with blocks.BlockFile(str(path)) as file:
        for at in range(0, file.size, 7):
            assert file.first_block(at) == next((b for b in filled if b >= at), file.size)


def test_damage_is_named(tmp_path, spark):
    raw = bytearray(bgzf.block(b"chr1\t1\t2\n" * 50, 0) + bgzf.END_OF_FILE)
    raw[60] ^= 1
    path = tmp_path / "d.gz"
    path.write_bytes(raw)
    with pytest.raises(Exception, match="damaged"):
        with blocks.BlockFile(str(path)) as file:
            file.block(0)


def alignment(rng, references, name=None):
    """A record as the format has it."""
    name = name or bytes(rng.choices(b"abcdefgh", k=rng.randint(1, 12))) + b"\0"
    bases, cigar, tags = rng.randint(0, 90), rng.randint(0, 3), bytes(rng.choices(range(256), k=rng.randint(0, 40)))
    rest = bytes(rng.choices(range(256), k=4 * cigar + (bases + 1) // 2 + bases))
    place = rng.choice([-1, rng.randrange(references)]), rng.choice([-1, rng.randrange(10_000)])
    return struct.pack("<iiBBHHHiiii", *place, len(name), 30, 4680, cigar, 0, bases, -1, -1, 0) + name + rest + tags


def bam_file(path, records, rng, names=(b"chr1", b"chr2"), most=400):
    table = struct.pack("<i", len(names)) + b"".join(struct.pack("<i", len(n) + 1) + n + b"\0" + struct.pack("<i", 10_000) for n in names)
    head = b"@HD\tVN:1.6\tSO:unsorted\n"
    raw = b"BAM\1" + struct.pack("<i", len(head)) + head + table + b"".join(struct.pack("<i", len(r)) + r for r in records)
    path.write_bytes(blocked(raw, rng, most))
    return str(path)


@pytest.mark.parametrize("kind", ["usual", "opaque", "long"])
def test_records_of_any_ranges_equal_a_serial_read(spark, tmp_path, kind):
    """Usual records, ones whose bytes no guess fits, and a record over several ranges."""
    rng = random.Random(kind)
    records = [alignment(rng, 2) for _ in range(500)]
    if kind == "opaque":
        records = [struct.pack("<ii", i % 2, i) + bytes(rng.choices(range(256), k=rng.randint(0, 80))) for i in range(120)]
    if kind == "long":
        records[250] = alignment(rng, 2)[:32] + bytes(rng.choices(range(256), k=30_000))
        # A text of records inside a record: guesses within it are wrong.
        records[300] = struct.pack("<ii", 0, 0) + b"".join(struct.pack("<i", len(r)) + r for r in records[:60])
    path = bam_file(tmp_path / "a.bam", records, rng)
    size = os.path.getsize(path)
    for split in (size + 1, size // 4, 1500):
        got = bam.read_bam(spark, path, split).collect()
        assert [bytes(r["raw"]) for r in got] == records
        assert [(r["tid"], r["pos"]) for r in got] == [struct.unpack_from("<ii", r) for r in records]
        assert [r["input_ord"] for r in got] == sorted({r["input_ord"] for r in got})
    if kind == "usual":
        ranges = bam.record_ranges(spark, path, 1500)
        assert len(ranges) == -(-size // 1500) > 10
        bounds, (_, references) = blocks.ranges(path, 1500), bam.header_end(path)
        with blocks.BlockFile(path) as file:  # the guesses alone would do for usual records
            guesses = [bam.guessed(file, file.first_block(b), references) for b in bounds[1:-1] if file.first_block(b) < size]
        assert sum(g == r[0] for g, r in zip(guesses, ranges[1:], strict=False)) >= 0.9 * len(guesses)


def test_a_cut_file_is_refused(spark, tmp_path):
    rng = random.Random(9)
    path = bam_file(tmp_path / "c.bam", [alignment(rng, 2) for _ in range(50)], rng)
    raw = open(path, "rb").read()
    at = [i for i in range(len(raw)) if raw.startswith(blocks.MAGIC, i)]
    open(path, "wb").write(raw[: at[len(at) // 2]])
    with pytest.raises(Exception, match="within a record|damaged|no chain"):
        bam.read_bam(spark, path, 700).count()


def test_bam_without_records(spark, tmp_path):
    path = bam_file(tmp_path / "e.bam", [], random.Random(1))
    assert bam.read_bam(spark, path).collect() == []
    bam.write_bam(bam.sort_bam(bam.read_bam(spark, path)), path, str(tmp_path / "o.bam"))
    assert bam.read_bam(spark, str(tmp_path / "o.bam")).collect() == []


def test_sorted_bam_from_parts(spark, tmp_path):
    rng = random.Random(2)
    records = [alignment(rng, 2) for _ in range(900)]
    path, out = bam_file(tmp_path / "a.bam", records, rng), str(tmp_path / "o.bam")
    bam.write_bam(bam.sort_bam(bam.read_bam(spark, path, 4000)), path, out)
    key = lambda r: tuple(x & 0xFFFFFFFF for x in struct.unpack_from("<ii", r))
    assert [bytes(r["raw"]) for r in bam.read_bam(spark, out, 3000).collect()] == sorted(records, key=key)
    assert open(out, "rb").read().endswith(bgzf.END_OF_FILE)


def test_tabix_from_parts_and_fetch_reads_few_blocks(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(f"chr{rng.randint(1, 2)}", s := rng.randrange(3_000_000), s + rng.choice([1, 50, 40_000]), i) for i in range(20_000)]
    lines = spark.createDataFrame([(f"{c}\t{s}\t{e}\tr{i}", c, s, e) for c, s, e, i in rows], "value string, chrom string, start long, end long")
    path = str(tmp_path / "t.bed.gz")
    ranged = lines.repartitionByRange(7, "chrom", "start", "value").sortWithinPartitions("chrom", "start", "value")
    bgzf.write(ranged, path, ["#head"], tabix=True)
    want = [r["value"] for r in order.sort_records(lines).collect()]
    assert gzip.open(path, "rt").read().splitlines() == ["#head", *want]
    assert ranged.rdd.getNumPartitions() == 7
    for chrom, low, high in [("chr1", 0, 1), ("chr2", 1_000_000, 1_000_500), ("chr1", 2_990_000, 4_000_000), ("chr1", 0, 3_000_000), ("chr3", 0, 9)]:
        got = [r["value"] for r in bgzf.fetch(spark, path, chrom, low, high).collect()]
        assert got == [x for x in want if (f := x.split("\t"))[0] == chrom and int(f[1]) < high and int(f[2]) > low]
    size = os.path.getsize(path)
    assert sum((b >> 16) - (a >> 16) for a, b in bgzf.index_chunks(path, "chr2", 1_000_000, 1_000_500)) < size / 10
    monkeypatch.setattr(blocks, "SPLIT", 1000)  # many tasks
    many = bgzf.fetch(spark, path, "chr1", 0, 3_000_000)
    assert [r["value"] for r in many.collect()] == [x for x in want if x.startswith("chr1\t") and int(x.split("\t")[1]) < 3_000_000]


def test_text_file_from_parts(spark, tmp_path):
    lines = spark.createDataFrame([(f"{i:06d}",) for i in range(5000)], "value string").repartition(5).orderBy("value")
    path = str(tmp_path / "x.txt")
    text.write_file(lines, path, ["# a", "# b"])
    assert open(path).read().splitlines() == ["# a", "# b", *(f"{i:06d}" for i in range(5000))]
    text.write_file(lines.limit(0), path, ["# a"])
    assert open(path).read() == "# a\n"
    assert os.listdir(tmp_path) == ["x.txt"]


def test_a_file_that_tasks_do_not_see_is_streamed(spark, tmp_path, monkeypatch):
    """As where the driver's folder is not shared: the parts come through it one by one."""
    seen = []
    monkeypatch.setattr(ordered, "_copied", lambda spark, todo, target, mark: seen.append(len(todo)) or todo)
    monkeypatch.setattr(ordered, "COPY", 100)
    lines = spark.createDataFrame([(f"{i:06d}",) for i in range(3000)], "value string").repartitionByRange(4, "value").sortWithinPartitions("value")
    path = str(tmp_path / "x.txt")
    text.write_file(lines, path, ["# a"])
    assert open(path).read().splitlines() == ["# a", *(f"{i:06d}" for i in range(3000))] and seen == [4]


def test_a_write_that_fails_leaves_the_old_file(spark, tmp_path):
    path = tmp_path / "x.txt"
    path.write_text("old")
    bad = spark.range(5).selectExpr("if(id = 3, raise_error('no'), cast(id as string)) as value")
    with pytest.raises(Exception, match="no"):
        text.write_file(bad, str(path))
    assert path.read_text() == "old" and os.listdir(tmp_path) == ["x.txt"]
