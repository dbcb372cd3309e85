"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from strandmill.llm import fingerprints, linededup, mixing, neighbours, pieces, ppm, prefixtrie, quality, runs, sharding, simhash, substring, toxicity


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ppm_trie(spark, sf_dir):
    return ppm.report(_table(spark, sf_dir, "documents"))


def op2_systematic_mix(spark, sf_dir):
    return mixing.report(_table(spark, sf_dir, "documents"))


def op3_iblt_fingerprints(spark, sf_dir):
    return fingerprints.report(_table(spark, sf_dir, "documents"))


def op4_countmin_windows(spark, sf_dir):
    return substring.report(_table(spark, sf_dir, "documents"), 35)


def op5_shifted_hilbert(spark, sf_dir):
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), 20, 20)


def op6_piece_viterbi(spark, sf_dir):
    return pieces.report(_table(spark, sf_dir, "documents"))


def op7_quality_ftrl(spark, sf_dir):
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_toxicity_noisy_or(spark, sf_dir):
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_sampled_splitters(spark, sf_dir):
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), 24)


def op10_simhash_pigeonhole(spark, sf_dir):
    return simhash.linked(_table(spark, sf_dir, "documents"))


def op11_lz_runs(spark, sf_dir):
    return runs.report(_table(spark, sf_dir, "documents"))


def op12_line_bitmaps(spark, sf_dir):
    return linededup.report(_table(spark, sf_dir, "documents"))


def op13_prefix_ownership(spark, sf_dir):
    return prefixtrie.nodes(_table(spark, sf_dir, "conversations"))


def queries():
    return {f.__name__: f for f in (op1_ppm_trie, op2_systematic_mix, op3_iblt_fingerprints, op4_countmin_windows, op5_shifted_hilbert, op6_piece_viterbi, op7_quality_ftrl, op8_toxicity_noisy_or, op9_sampled_splitters, op10_simhash_pigeonhole, op11_lz_runs, op12_line_bitmaps, op13_prefix_ownership)}


# Windows by the digest of their words joined by one space, which no word holds; a word is removed if a repeated window covers it.
WINDOWS_SQL = r"""with docs as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
 starts as (select r, words, unnest(range(1, len(words) - 33)) as i from docs where len(words) >= 35),
 windows as (select r, i, md5(array_to_string(words[i:i + 34], ' ')) as digest from starts),
 repeated as (select r, i from windows where digest in (select digest from windows group by digest having count(*) > 1)),
 gone as (select distinct r, unnest(range(i, i + 35)) as i from repeated),
 each_word as (select r, unnest(range(1, len(words) + 1)) as i, unnest(words) as word from docs where len(words) > 0),
 kept as (select w.r, string_agg(w.word, ' ' order by w.i) as text, count(*) as n from each_word w anti join gone g on w.r = g.r and w.i = g.i group by w.r)
 select doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(text, '')) as kept_sha256 from docs left join kept using (r)"""

# Keys by their text; a document is an id, null an id of its own below all others.
LINES_SQL = r"""with docs as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
 each_line as (select r, doc_id, unnest(range(1, len(lines) + 1)) as i, unnest(lines) as line from docs),
 keyed as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from each_line),
 many as (select k, max(doc_id) as last from keyed where length(k) >= 20 group by k having count(distinct coalesce(cast(doc_id as varchar), '')) >= 3),
 marked as (select r, i, line, m.k is not null and e.doc_id is distinct from m.last as gone from keyed e left join many m on e.k = m.k),
 kept as (select r, count(*) as n_lines, count(*) filter (gone) as n_dropped, string_agg(line, chr(10) order by i) filter (not gone) as text from marked group by r)
 select doc_id, n_lines, n_dropped, sha256(coalesce(text, '')) as kept_sha256 from docs join kept using (r)"""

# crc32 of a decimal: bytes (0 to 255) are folded in, and each of the eight steps behind a byte (-1) shifts.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(cast(c as varchar), ''),
 lambda d: list_prepend(cast(ascii(d) as bigint), [-1, -1, -1, -1, -1, -1, -1, -1])))), lambda a, x:
 case when x >= 0 then xor(a, x) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end))"""
TURNS = "list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) order by turn nulls first, coalesce(role, ''), coalesce(text, ''))"
NODES_SQL = f"""with conv as (select conv_id as c, {TURNS} as turns from conversations where conv_id is not null group by conv_id),
 heads as (select c, turns, cast({CRC32} as bigint) % 9 as h from conv),
 rebuilt as (select a.c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) as path from heads a left join conv b on b.c = a.c - a.c % 5),
 steps as (select c, path, len(path) as n, unnest(range(0, len(path) + 1)) as depth from rebuilt),
 members as (select c, n, depth, path[1:depth] as prefix, path[1:depth - 1] as above, coalesce(octet_length(encode(path[depth].text)), 0) as w from steps),
 nodes as (select prefix, depth, any_value(above) as above, any_value(w) as w, min(c) as conv_id, count(*) as n_convs,
  string_agg(cast(c as varchar), ',' order by c) filter (n = depth) as ends from members group by prefix, depth),
 children as (select above, depth - 1 as depth, count(*) as n from nodes where depth > 0 group by all),
 full_nodes as (select v.*, p.conv_id as parent_conv_id, coalesce(k.n, 0) as n_children from nodes v
  left join nodes p on p.depth = v.depth - 1 and p.prefix = v.above left join children k on k.depth = v.depth and k.above = v.prefix),
 subtree as (select prefix[1:t] as prefix, t as depth, sum((n_convs - 1) * w) as saved, count(*) filter (n_children = 0) as leaves
  from (select *, unnest(range(0, depth + 1)) as t from full_nodes) group by all)
 select v.conv_id, cast(v.depth as bigint) as depth, v.parent_conv_id, v.n_convs, v.n_children, s.leaves as n_leaves, cast(s.saved as bigint) as saved_tokens,
  sha256(coalesce(v.ends, '')) as ends_sha256 from full_nodes v join subtree s on s.depth = v.depth and s.prefix = v.prefix"""


def oracle_sql():
    """SQL over the whole tables, for what it can express."""
    return {"op4_countmin_windows": WINDOWS_SQL, "op12_line_bitmaps": LINES_SQL, "op13_prefix_ownership": NODES_SQL}
