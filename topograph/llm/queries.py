"""The registered queries of this package, thin over its operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topograph.llm.common import partitions, scratch_path, table

SPACES = r"[\x20\x09-\x0D]"


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topograph.llm.mixing import write_mix

    mixed = write_mix(table(spark, sf_dir, "documents"), scratch_path(spark, "shards"), partitions(spark))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topograph.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topograph.llm.lm_score import score

    return score(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topograph.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topograph.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topograph.llm.quality import quality

    return quality(table(spark, sf_dir, "documents")).drop("n_lost_words")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topograph.llm.near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topograph.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topograph.llm.warc import archive

    records = archive(table(spark, sf_dir, "pages")).filter(F.col("gap_start").isNull())
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topograph.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topograph.llm.fill_middle import fill_middle

    return fill_middle(table(spark, sf_dir, "documents"), digests=True)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topograph.llm.periodic_runs import periodic_runs, periodic_tail

    return periodic_runs(table(spark, sf_dir, "documents"), rewrite=periodic_tail, digests=True)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topograph.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_bpe, op3_lm_score, op4_exact_dedup, op5_token_counts, op6_quality_rules, op7_near_dedup,
        op8_html_extract, op9_warc, op10_substring_dedup, op11_fill_middle, op12_periodic_runs, op13_license_scan,
    )
}

ORACLE: dict[str, str] = {}

ORACLE["op1_mix_sources"] = r"""
with recursive w as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         cast(('0x' || substr(md5('7|' || coalesce(cast(doc_id as varchar), '')), 1, 15)) as bigint) as place
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size,
             cast((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1 as double) as weight from w group by source),
rounds as (
  select source, source_size, weight, false as stopped, 0 as round, sum(source_size) over () as total from s
  union all
  select source, source_size, weight,
         stopped or 3.0 * source_size < weight * (total - sum(case when stopped then 3.0 * source_size else 0 end) over ())
                                        / nullif(sum(case when stopped then 0 else weight end) over (), 0), round + 1, total
  from rounds where round < (select count(*) from s)),
t as (
  select source, source_size,
         case when stopped then cast(3.0 * source_size as double)
              else least(3.0 * source_size, weight * (total - sum(case when stopped then 3.0 * source_size else 0 end) over ())
                                            / nullif(sum(case when stopped then 0 else weight end) over (), 0)) end as target
  from rounds where round = (select count(*) from s)),
p as (select *, case when source_size > 0 then cast(round_even(target, 0) as bigint) // source_size else 0 end as passes from t),
q as (select *, cast(round_even(target, 0) as bigint) - passes * source_size as rest from p),
c as (
  select w.*, q.source_size, q.target, q.passes, q.rest,
         sum(size) over (partition by w.source order by place range between unbounded preceding and current row) as upto,
         sum(size) over (partition by w.source, place) as here
  from w join q on w.source is not distinct from q.source)
select doc_id, size, source_size, cast(target as double) as target,
       cast(passes * size + case when upto <= rest then size when upto - here < rest then (size * (rest - (upto - here))) // here else 0 end as bigint) as taken
from c
"""

ORACLE["op4_exact_dedup"] = r"""
with n as (select doc_id, coalesce(length(text), 0) as len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
g as (select doc_id, first_value(doc_id) over (partition by norm order by len desc, doc_id nulls last) as keep_id,
             count(*) over (partition by norm) as group_size, row_number() over (partition by norm order by len desc, doc_id nulls last) as rn,
             sha256(norm) as text_sha256 from n)
select doc_id, keep_id, cast(group_size as bigint) as group_size, rn = 1 as kept, text_sha256 from g
"""

ORACLE["op6_quality_rules"] = r"""
with d as (
  select row_number() over () as k, doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
win as (select k, i, list_slice(words, i, i + 4) as g from (select k, words, unnest(range(1, len(words) - 3)) as i from d)),
rep as (select k, i from (select k, i, count(*) over (partition by k, g) as c from win) where c > 1),
cov as (select k, count(distinct i + o) as n_repeat_words from rep, (select unnest(range(0, 5)) as o) group by k),
l0 as (select k, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from d),
l1 as (select k, line, i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n from l0),
l2 as (select *, row_number() over (partition by k, line order by i) > 1 as again,
              len(regexp_extract_all(line, '[#*$%&|<>]')) as sym,
              regexp_matches(line, '[.!?"'':;)…”’»。！？][\x20\x09-\x0D]*$') as closed,
              len(regexp_extract_all(line, '[A-ZÀ-Þ]')) as up, len(regexp_extract_all(line, '[a-zß-ÿ]')) as low
       from l1 where n > 0),
l3 as (select k, sum(again::int) as n_dup_lines,
              sum(case when sym * 5 > n or (n <= 3 and not closed) or (n >= 4 and up > low) or again then n else 0 end) as lost from l2 group by k),
f as (
  select doc_id, cast(len(words) as bigint) as n_words, cast(len(list_aggregate(words, 'string_agg', '')) as bigint) as word_chars,
         cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
         cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, coalesce(lost, 0) as lost
  from d left join cov using (k) left join l3 using (k))
select doc_id, n_words, coalesce(word_chars, 0) as word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * lost <= 50 * n_words as kept
from f
"""

ORACLE["op9_warc"] = r"""
with p as (select page_id, coalesce(html, '') as html, cast(octet_length(encode(coalesce(html, ''))) as bigint) as n from pages),
r as (select *, max(page_id) over (partition by html) as head, row_number() over (partition by html order by page_id desc nulls last) as rn from p)
select page_id, n as payload_bytes, sha1(html) as payload_digest,
       case when n >= 1000 and rn > 1 then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and rn > 1 then head end as refers_to
from r
"""

ORACLE["op10_substring_dedup"] = r"""
with d as (select row_number() over () as k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
w as (select k, doc_id, unnest(words) as word, generate_subscripts(words, 1) as i, len(words) as n from d),
win as (select k, doc_id, i, md5(list_aggregate(list_slice(words, i, i + 19), 'string_agg', chr(10))) as g
        from (select k, doc_id, words, unnest(range(1, len(words) - 18)) as i from d)),
dup as (select k, i from (select k, i, row_number() over (partition by g order by doc_id, i) as rn from win) where rn > 1),
ends as (select k, i, max(i) over (partition by k order by i rows between unbounded preceding and current row) as upto from dup),
cov as (select w.k, w.doc_id, w.word, w.i, e.upto is not null and w.i <= e.upto + 19 as gone
        from w asof left join ends e on w.k = e.k and w.i >= e.i)
select doc_id, cast(count(i) as bigint) as n_words, cast(coalesce(sum(gone::int), 0) as bigint) as n_removed,
       sha256(coalesce(string_agg(word, ' ' order by i) filter (where not gone), '')) as kept_sha256
from (select d.k, d.doc_id, c.word, c.i, c.gone from d left join cov c using (k)) group by k, doc_id
"""

ORACLE["op7_near_dedup"] = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (select doc_id, unnest(list_distinct(case when len(words) = 0 then [] when len(words) < 5 then [words]
             else list_transform(range(1, len(words) - 3), lambda i: list_slice(words, i, i + 4)) end)) as g from d),
n as (select d.doc_id, count(g) as n from d left join s using (doc_id) group by d.doc_id),
e as (select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g and a.doc_id < b.doc_id
      join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
      group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
l as (select a as u, b as v from e union all select b, a from e),
c as (select doc_id as u, doc_id as r from n union select l.v, c.r from c join l on l.u = c.u where c.r < l.v),
m as (select u, min(r) as component_id from c group by u)
select n.doc_id, cast(n.n as bigint) as n_shingles, m.component_id, n.doc_id = m.component_id as kept from n join m on m.u = n.doc_id
"""

ORACLE["op11_fill_middle"] = r"""
with d as (select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (select *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as units,
             cast(('0x' || substr(h, 1, 8)) as bigint) as h1, cast(('0x' || substr(h, 9, 8)) as bigint) as h2, cast(('0x' || substr(h, 25, 8)) as bigint) as h4 from d),
c as (select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
             case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from u),
p as (select *, coalesce(list_aggregate(list_slice(units, 1, a), 'string_agg', ''), '') as pre, coalesce(list_aggregate(list_slice(units, a + 1, b), 'string_agg', ''), '') as mid,
             coalesce(list_aggregate(list_slice(units, b + 1, n), 'string_agg', ''), '') as suf from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars,
       case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
       sha256(text) as restored_sha256
from p
"""


def _op13_sql() -> str:
    from topograph.llm.license_scan import NOTICES, PHRASES

    known = ", ".join(f"({i}, '{label}', '{text}', {i < len(PHRASES)})" for i, (label, text) in enumerate([*PHRASES, *NOTICES]))
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
with d as (select row_number() over () as k, doc_id, {words} as words from documents),
tw as (select template, label, phrase, {words} as words from (values {known}) as v(template, label, text, phrase)),
tg as (select template, label, phrase, len(words) as size, i - 1 as t, list_slice(words, i, i + 2) as gram from (select *, unnest(range(1, len(words) - 1)) as i from tw)),
g as (select k, i - 1 as p, list_slice(words, i, i + 2) as gram from (select k, words, unnest(range(1, len(words) - 1)) as i from d)),
lines as (select k, template, label, phrase, size, p - t as diagonal, list(t) as hits from g join tg using (gram) group by all),
held as (select *, list_distinct(flatten(list(hits) over w)) as near_hits, min(diagonal + list_min(hits)) over w as first
         from lines window w as (partition by k, template order by diagonal range between 4 preceding and 4 following)),
merged as (select k, template, label, diagonal, first, len(hits) as own,
                  len(list_distinct(flatten(list_transform(near_hits, lambda x: [x, x + 1, x + 2])))) / cast(size as double) as share,
                  phrase and len(hits) = size - 2 as base from held),
ranked as (select *, max({{'s': share, 'o': own, 'd': -diagonal}}) over (partition by k, template order by diagonal range between 4 preceding and 4 following)
                     = {{'s': share, 'o': own, 'd': -diagonal}} and share >= 0.8 as good from merged),
kept as (select *, base or (good and share >= max(case when good then share end) over (partition by k order by first range between 8 preceding and 8 following)) as span from ranked),
r as (select k, count(*) filter (where base) as n_base, min(diagonal) filter (where base) as first_word, max(diagonal) filter (where base) as last_word,
             list_sort(list_distinct(list(label) filter (where base))) as base_labels, list_sort(list_distinct(list(label) filter (where span))) as labels,
             max(share) filter (where span) as score from kept group by k)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
       coalesce(array_to_string(base_labels, ','), '') as base_labels, coalesce(array_to_string(labels, ','), '') as labels, coalesce(score, 0.0) as score
from d left join r using (k)
"""


ORACLE["op13_license_scan"] = _op13_sql()
