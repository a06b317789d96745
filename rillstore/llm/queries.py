"""Thin queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_transducer, chat_format, exact_dedup, line_dedup, masked_lm, quality_bands, secret_grammar, simhash_vptree, suffix_dedup, temperature_mix
from .common import read


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    more = spark.sql(f"select * from values (-1L, 0L, 'user', '{probe}'), (-1L, 1L, 'assistant', '{probe}') as t(conv_id, turn, role, text)")
    out = chat_format.format_chats(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))
    out = out.select("*", chat_format.read_back(F.col("formatted")).alias("turns"))
    out = out.select("*", chat_format.loss_text(F.col("turns")).alias("loss"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(joined).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), digest(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", F.col("bad_turn").cast("long").alias("bad_turn"), "end_state")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_vptree.near_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_grammar.scan(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bands.calibrated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read(spark, sf_dir, "documents"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_transducer.encode_decode(read(spark, sf_dir, "documents"), vocabulary())


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temperature_mix.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", F.col("__n_tokens").alias("n_tokens"), F.col("__pass").alias("pass_no"), F.col("__block").alias("block_no"), F.col("__rank").alias("block_rank"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score_documents(read(spark, sf_dir, "documents"))


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that SQL can express, from the same operator."""
    return secret_grammar.scan(read(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 that SQL can express, from the same operator."""
    return quality_bands.measure(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_chat_format, op3_simhash_near_dedup, op4_secret_scan, op5_quality_rules, op6_suffix_dedup, op7_line_dedup, op8_temperature_mix, op9_bpe_encode, op10_lm_score, secret_base_counts, quality_counts)}

ORACLE_SQL: dict[str, str] = {}
ORACLE_SQL["op1_exact_dedup"] = r"""
with n as (select doc_id, length(coalesce(text, '')) as n_cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as h from documents),
g as (select h, count(*) as group_size, max(n_cp) as best from n group by h),
k as (select n.h, min(n.doc_id) as keep_id from n join g on n.h = g.h and n.n_cp = g.best group by n.h)
select n.doc_id, k.keep_id, g.group_size, n.doc_id = k.keep_id as kept, n.h as text_sha256
from n join g on n.h = g.h join k on n.h = k.h
"""
ORACLE_SQL["op2_chat_format"] = r"""
with recursive c as (select conv_id, turn, role, coalesce(text, '') as t from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, row_number() over (partition by conv_id order by turn, role, t) - 1 as i, length(t) + 2 * len(regexp_extract_all(t, '<<SYS>>|<</SYS>>|<<ROLE>>|<<TEXT>>|<</ROLE>>|\[INST\]|\[/INST\]|</s>|<s>'))
  + (length(t) - length(replace(t, chr(57344), ''))) + case role when 'system' then 17 when 'user' then 15 else 9 end as f from c),
moves(state, role, next) as (values ('start', 'system', 'briefed'), ('start', 'user', 'asked'), ('briefed', 'user', 'asked'), ('asked', 'assistant', 'answered'), ('answered', 'user', 'asked')),
m(conv_id, i, state, bad) as (select conv_id, cast(0 as bigint), 'start', cast(null as bigint) from (select distinct conv_id from c) union all
  select m.conv_id, m.i + 1, coalesce(v.next, m.state), case when m.bad is null and v.next is null then m.i else m.bad end
  from m join e on e.conv_id = m.conv_id and e.i = m.i left join moves v on v.state = m.state and v.role = e.role),
z as (select conv_id, arg_max(state, i) as end_state, max(bad) as bad_turn from m group by 1),
g as (select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' order by i)) as turns_sha256,
  cast(coalesce(sum(length(t)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(t, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(f) as bigint) as formatted_chars
  from e group by conv_id)
select g.*, bad_turn is null and end_state in ('answered', 'asked') as valid, bad_turn, end_state from g join z on g.conv_id = z.conv_id
"""
ORACLE_SQL["op7_line_dedup"] = r"""
with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as a from documents),
w as (select doc_id, p, a[p] || chr(10) || a[p + 1] || chr(10) || a[p + 2] as w from (select doc_id, a, unnest(range(1, len(a) - 1)) as p from l where len(a) >= 3)),
r as (select doc_id, p, row_number() over (partition by w order by doc_id, p) as k from w where regexp_matches(w, '[^\x20\x09-\x0D]')),
c as (select distinct doc_id, p + d as p from r, (values (0), (1), (2)) as x(d) where k > 1),
s as (select l.doc_id, len(a) as n_lines, unnest(a) as line, unnest(range(1, len(a) + 1)) as p from l)
select s.doc_id, any_value(n_lines) as n_lines, count(c.p) as n_removed,
  sha256(coalesce(string_agg(line, chr(10) order by s.p) filter (c.p is null), '')) as kept_sha256
from s left join c on s.doc_id = c.doc_id and s.p = c.p group by s.doc_id
"""
ORACLE_SQL["op8_temperature_mix"] = r"""
with recursive t as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n,
  cast('0x' || substr(md5('17:block:' || doc_id), 1, 15) as bigint) as hb, cast('0x' || substr(md5('17:doc:' || doc_id), 1, 15) as bigint) as hd from documents),
per as (select source, cast(sum(n) as bigint) as n from t group by 1 having sum(n) > 0),
tot as (select cast(sum(n) as double) as total from per),
sh as (select source, n, n / total as p, total from per, tot),
bis(i, lo, hi) as (select 0, cast(0 as double), cast(1 as double) union all
  select i + 1, case when e > goal then m else lo end, case when e > goal then hi else m end from (
    select i, lo, hi, (lo + hi) / 2 as m, ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) as e, 0.95 * ln(count(*)) as goal
    from bis, sh where i < 60 group by i, lo, hi)),
ent as (select (lo + hi) / 2 as a from bis where i = 60),
lim(i, lo, hi) as (select 0, a, cast(1 as double) from ent union all
  select i + 1, case when r > 4 then m else lo end, case when r > 4 then hi else m end from (
    select i, lo, hi, (lo + hi) / 2 as m, max(pow(p, (lo + hi) / 2) * total / n) / sum(pow(p, (lo + hi) / 2)) as r from lim, sh where i < 60 group by i, lo, hi)),
al as (select case when (select max(pow(p, ent.a) * total / n) / sum(pow(p, ent.a)) from sh) > 4 then (select (lo + hi) / 2 from lim where i = 60) else ent.a end as a from ent),
ex as (select source, n, pow(p, a) / (select sum(pow(p, al.a)) from sh) * total as x, total from sh, al),
bud as (select source, n, floor(x) + case when row_number() over (order by floor(x) - x, source) <= total - sum(floor(x)) over () then 1 else 0 end as budget, greatest(1, (n + 1048575) // 1048576) as blocks from ex),
doc as (select t.*, bud.n as total_n, cast(budget as bigint) as budget, hb % blocks as block_no from t join bud on t.source = bud.source),
blk as (select source, block_no, any_value(total_n) as total_n, any_value(budget) as budget, cast(sum(n) as bigint) as bn from doc group by 1, 2),
pas as (select *, unnest(range(0, budget // total_n + 1)) as pass_no from blk),
ran as (select *, row_number() over w as block_rank, sum(bn) over w as cum from pas
  window w as (partition by source, pass_no order by cast('0x' || substr(md5('17:pass:' || pass_no || ':' || source || ':' || block_no), 1, 15) as bigint), block_no rows unbounded preceding)),
tak as (select *, case when pass_no = budget // total_n and cum > budget % total_n then budget % total_n - (cum - bn) end as need from ran where pass_no < budget // total_n or cum - bn < budget % total_n),
got as (select d.doc_id, d.source, d.n as n_tokens, k.pass_no, d.block_no, k.block_rank, k.need,
  sum(d.n) over (partition by d.source, d.block_no, k.pass_no order by d.hd, d.doc_id rows unbounded preceding) as upto from doc d join tak k on d.source = k.source and d.block_no = k.block_no)
select doc_id, source, n_tokens, pass_no, block_no, block_rank from got where need is null or upto <= need
"""
ORACLE_SQL["op6_suffix_dedup"] = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as hx from documents),
c as (select doc_id, c, substr(hx, 2000 * c + 1, 2198) as piece from (select doc_id, hx, unnest(range(0, length(hx) // 2000 + 1)) as c from d)),
w as (select doc_id, 1000 * c + j as j, md5(substr(piece, 2 * j + 1, 200)) as s from (select *, unnest(range(0, least(1000, length(piece) // 2 - 99))) as j from c)),
f as (select s, min((doc_id, j)) as first from w group by s having count(*) > 1),
rep as (select w.doc_id, w.j from w join f on w.s = f.s where (w.doc_id, w.j) > f.first),
o as (select *, case when j <= lag(j) over (partition by doc_id order by j) + 100 then 0 else 1 end as fresh from rep),
i as (select doc_id, run, min(j) as a, max(j) + 100 as b from (select *, sum(fresh) over (partition by doc_id order by j) as run from o) group by 1, 2),
g as (select i.doc_id, a, b, coalesce(lag(b) over (partition by i.doc_id order by a), 0) as before from i),
k as (select g.doc_id, sum(b - a) as removed, count(*) as spans, string_agg(substr(hx, 2 * before + 1, 2 * (a - before)), '' order by a) || substr(any_value(hx), 2 * max(b) + 1) as kept from g join d on g.doc_id = d.doc_id group by 1)
select d.doc_id, length(hx) // 2 as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(kept, hx))) as kept_sha256
from d left join k on d.doc_id = k.doc_id
"""
ORACLE_SQL["secret_base_counts"] = r"""
with d as (select doc_id, coalesce(text, '') as t from documents)
select doc_id,
  len(list_filter(regexp_extract_all(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) as n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) as n_access,
  len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) as n_hex
from d
"""
ORACLE_SQL["quality_counts"] = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] as gram from (select doc_id, w, unnest(range(1, len(w) - 1)) as p from d where len(w) >= 3)),
twice as (select *, count(*) over (partition by doc_id, gram) as n from g),
marked as (select doc_id, count(distinct p + o) as n_repeat from twice, (values (0), (1), (2)) as x(o) where n > 1 group by 1),
l as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
c as (select d.doc_id, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
  len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n_repeat, 0) as n_repeat_words from d join l on d.doc_id = l.doc_id left join marked m on d.doc_id = m.doc_id)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c
"""
