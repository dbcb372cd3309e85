"""Command line: sort BED or BAM, collapse, write text, blocked gzip or a locus dataset."""

from __future__ import annotations

import argparse
import contextlib
import sys
import time
import warnings

from pyspark.sql import functions as F

from strandmill import __version__
from strandmill.functions import scalar
from strandmill.operators import collapse, order
from strandmill.plans import strategy
from strandmill.schema import BedError
from strandmill.sources import bam, bed, bgzf, locus_parquet, ordered, text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandmill", description="Sort BED records by locus, on Spark.")
    p.add_argument("input", help="input file; - reads standard input; .gz files are decompressed")
    p.add_argument("-s", "--sort", default="s", choices=order.MODES, help="s: start, b: start and end, 5: strand-aware five-prime end")
    p.add_argument("--collapse", action="store_true", help="sum the scores of records that share chromosome and start")
    p.add_argument("--low-mem-ssd", action="store_true", help="sort chromosomes in parallel")
    p.add_argument("--external-merge", action="store_true", help="bounded memory: ranges of at most --max-mem, which spill and merge where a task has less")
    p.add_argument("--multi-pass", action="store_true", help="several passes over the input, each sorting what fits --max-mem")
    p.add_argument("--merge-codec", default="zstd", help="codec of spilled blocks: raw, lz4, zstd")
    p.add_argument("--tmpdir", help="folder for spilled blocks")
    p.add_argument("-t", "--threads", type=int, default=0, help="0: all cores")
    p.add_argument("-n", "--natural-sort", action="store_true", help="chr2 before chr10")
    p.add_argument("--max-mem", default="", help="memory budget: 4G, 500M, 1024K")
    p.add_argument("-o", "--output", help="output file; standard output without it")
    p.add_argument("--bgzip", action="store_true", help="blocked gzip output; needs -o")
    p.add_argument("--tabix", action="store_true", help="a .tbi index beside the output; implies --bgzip")
    p.add_argument("--locus-output", help="write a sorted locus dataset (Parquet) instead of text")
    p.add_argument("--locus-parts", help="write the dataset as a folder of ordered parts, by all tasks at once")
    p.add_argument("--locus-index", action="store_true", help="with --locus-output: embed the interval index")
    p.add_argument("--coord-dtype", default="int32", choices=["int32", "int64"])
    p.add_argument("--key-prefix", default=locus_parquet.KEY_PREFIX, help="prefix of the dataset's footer keys")
    p.add_argument("--strict-compat", action="store_true", help="also reject combinations that only other record layouts can't do")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-V", "--version", action="version", version=__version__)
    return p


def is_bam(path: str) -> bool:
    return path.endswith((".bam", ".BAM"))


def check_options(o: argparse.Namespace) -> None:
    """Raises BedError for combinations that make no sense; strict_compat adds those which this engine's one sort could do."""
    rules = [
        (o.tabix or o.bgzip, not o.output, "--bgzip needs -o"),
        (o.tabix or o.bgzip, bool(o.locus_output), "--bgzip and --locus-output exclude each other"),
        (o.locus_output or o.locus_parts, o.sort != "s", "--locus-output sorts by start only"),
        (o.locus_parts, bool(o.locus_output or o.output or o.bgzip or o.tabix or o.multi_pass), "--locus-parts is an output of its own"),
        (o.locus_output, bool(o.output), "--locus-output and -o exclude each other"),
        (o.collapse, o.sort != "s", "--collapse groups by start and needs --sort=s"),
        (is_bam(o.input), o.sort != "s" or o.collapse or o.low_mem_ssd or o.natural_sort, "BAM input has the coordinate order only"),
        (is_bam(o.input), not o.output, "BAM output needs -o"),
        (o.multi_pass, o.sort != "s" or o.collapse or o.low_mem_ssd or o.external_merge or o.natural_sort or o.locus_output or o.bgzip or o.tabix, "--multi-pass has the default order only"),
        (o.multi_pass, o.input == "-", "--multi-pass reads its input several times and can't take standard input"),
        (o.external_merge, o.low_mem_ssd, "--external-merge and --low-mem-ssd exclude each other"),
        (o.max_mem, o.max_mem and not scalar.memory_size(o.max_mem), f"--max-mem {o.max_mem} is no size"),
    ]
    if o.strict_compat:
        rules += [
            (o.external_merge, o.sort != "s" or o.collapse, "--external-merge has the default order only"),
            (o.external_merge, o.input == "-", "--external-merge can't take standard input"),
            (o.locus_output and o.collapse, o.low_mem_ssd or o.external_merge or o.multi_pass, "--collapse with --locus-output has the default plan only"),
        ]
    for when, wrong, message in rules:
        if when and wrong:
            raise BedError(message)
    strategy.spill_settings(o.merge_codec)
    if o.locus_index and not o.locus_output:
        warnings.warn("--locus-index has no effect without --locus-output", stacklevel=2)


def run(o: argparse.Namespace, spark=None) -> None:
    check_options(o)
    began = time.time()
    spark = spark or strategy.session(o.threads, strategy.spill_settings(o.merge_codec, o.tmpdir))
    say = (lambda *x: print(*x, file=sys.stderr)) if o.verbose else (lambda *x: None)
    if is_bam(o.input):
        bam.write_bam(bam.sort_bam(bam.read_bam(spark, o.input)), o.input, o.output)
        return
    with bed.spooled_stdin(spark) if o.input == "-" else contextlib.nullcontext(o.input) as path:
        _sort(spark, path, o, say, began)


def _sort(spark, path: str, o: argparse.Namespace, say, began: float) -> None:
    header, records = bed.read_bed(spark, path)
    if o.verbose:  # phases: a scan of its own, then the sort with its output
        seen = records.agg(F.count("*").alias("n"), F.countDistinct("chrom").alias("c"), F.sum(F.octet_length("value") + 1).alias("bytes")).first()
        say(f"scan: {seen['n']} records on {seen['c']} chromosomes, {seen['bytes'] or 0} bytes, {len(header)} header lines, {time.time() - began:.2f} s")
    scanned = time.time()
    if o.locus_output or o.locus_parts:
        if o.collapse:
            rows = collapse.as_locus(collapse.collapse(collapse.with_weight(records)))
        else:
            rows = bed.typed(records, bed.detect_flavor(records))
        if o.locus_parts:
            locus_parquet.write_locus_parts(rows, o.locus_parts, o.natural_sort, o.coord_dtype, header)
        else:
            locus_parquet.write_locus(rows, o.locus_output, o.natural_sort, o.locus_index, o.coord_dtype, header, o.key_prefix)
    elif o.multi_pass:
        pieces = list(strategy.multi_pass(records, scalar.memory_size(o.max_mem) or strategy.DEFAULT_BUDGET))
        _write_pieces(pieces, header, o)
    else:
        if o.collapse:
            lines = collapse.rendered(collapse.collapse(collapse.with_weight(records)))
            out = order.sort_records(bed.parsed3(lines), "s", o.natural_sort, ())
        elif o.low_mem_ssd:
            out = strategy.per_chromosome(records, o.sort, o.natural_sort)
        elif o.external_merge:
            out = strategy.external(records, scalar.memory_size(o.max_mem) or strategy.DEFAULT_BUDGET, o.sort, o.natural_sort)
        else:
            out = order.sort_records(records, o.sort, o.natural_sort)
        if o.bgzip or o.tabix:
            bgzf.write(out, o.output, header, o.tabix)
        elif o.output:
            text.write_file(out, o.output, header)
        else:
            text.write_stream(out, header)
    say(f"sort and output: {time.time() - scanned:.2f} s")
    say(f"done in {time.time() - began:.2f} s")


def _write_pieces(pieces, header, o) -> None:
    if o.output:
        with ordered.atomic(o.output) as out:
            text.write_stream_to(pieces, header, out)
    else:
        text.write_stream_to(pieces, header, sys.stdout.buffer)


def main(argv: list[str] | None = None) -> int:
    try:
        run(parser().parse_args(argv))
    except BedError as e:
        print(f"strandmill: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
