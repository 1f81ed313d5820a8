"""One query for each operator, over the whole of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotide.llm import decontamination, licences, line_dedup, mixing, neighbours, sharding, simhash, tokens, toxicity, url_filters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence names and templates in every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = licences.with_licences(documents).select("doc_id", "n_words", "licences")
    phrases = F.filter("licences", lambda m: m["is_phrase"])

    def names(found) -> F.Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")

    return rows.select(
        "doc_id",
        "n_words",
        F.size(phrases).cast("long").alias("n_base"),
        F.array_min(F.transform(phrases, lambda m: m["start_word"])).alias("first_word"),
        F.array_max(F.transform(phrases, lambda m: m["start_word"])).alias("last_word"),
        names(phrases).alias("base_labels"),
        names(F.col("licences")).alias("labels"),
        F.coalesce(F.array_max(F.transform("licences", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


def op2_shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards, shuffled; row counts at most one apart."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    rows = sharding.shuffled_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), size, 24)
    return rows.select(
        "doc_id",
        size.alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept and dropped in every document with lines."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that stand in documents: a row for each document and item."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decontamination.with_leaks(documents, table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    rows = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learnt from the labels that are not held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.trained(documents, table(spark, sf_dir, "labels"))
    rows = toxicity.toxicity(documents, model).select("doc_id", "score")
    return rows.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def list_events(captures: DataFrame) -> DataFrame:
    """A dated list over all keys of the captured URLs, drawn from each key's hash."""
    keys = captures.select(url_filters.host_of(F.col("url")).alias("host"), url_filters.segment_of(F.col("url")).alias("segment")).distinct()
    keys = keys.select(F.explode(url_filters.keys_of(F.col("host"), F.col("segment"))).alias("k")).select(F.col("k.key").alias("key")).distinct()
    draw = F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("int")
    rows = keys.withColumn("draw", draw).where("draw % 3 <> 0")
    listed = F.pmod(F.col("draw"), F.lit(200))

    def event(days, action: str) -> F.Column:
        return F.struct(F.date_add(F.lit("2024-01-01").cast("date"), days).alias("date"), F.lit(action).alias("action"))

    events = F.array(event(listed, "block"), event(listed + 30 + F.pmod(F.col("draw"), F.lit(97)), "off"), event(listed + 150, "review"))
    return rows.select("key", F.explode(F.when(F.col("draw") % 2 == 0, events).otherwise(F.slice(events, 1, 2))).alias("e")).select(
        "key", "e.date", "e.action"
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list entries active on the day it was fetched."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched_on"))
    rows = url_filters.filtered(captures, list_events(captures))
    return rows.select(
        "page_id",
        "host",
        F.col("fetched_on").cast("string").alias("fetched_on"),
        "n_active",
        "verdict",
        "matched_key",
        F.col("active_since").cast("string").alias("active_since"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = tokens.with_token_counts(documents, public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op10_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_shard_shuffle,
        op3_line_dedup,
        op4_inverted_multi_index,
        op5_decontaminate,
        op6_mix_sources,
        op7_toxicity,
        op8_url_filter,
        op9_token_counts,
        op10_simhash_near_dup,
    )
}

_LINES = r"""
with recursive cut as (
  select doc_id as doc, string_split(text, chr(10)) as parts from documents where text is not null
), numbered as (
  select doc, unnest(parts) as line, unnest(range(len(parts))) as line_no from cut
), lines as (
  select * from numbered where length(trim(line, ' ')) > 0
), long_lines as (
  select distinct line, length(line) as size from lines where length(line) >= 24
), segments as (
  select line, size, n, (size // 3) * n + greatest(n - (3 - size % 3), 0) as start, size // 3 + case when n < 3 - size % 3 then 0 else 1 end as width
  from long_lines, (values (0), (1), (2)) as v(n)
), own as (
  select line, size, n, substring(line, start + 1, width) as piece from segments
), asked as (
  select l.line, l.size - f as wanted, n, ((l.size - f) // 3) * n + greatest(n - (3 - (l.size - f) % 3), 0) + s as start,
         (l.size - f) // 3 + case when n < 3 - (l.size - f) % 3 then 0 else 1 end as width
  from long_lines l, (values (0), (1), (2)) as v(n), (values (0), (1), (2)) as w(f), (values (-2), (-1), (0), (1), (2)) as x(s)
), met as (
  select distinct least(o.line, a.line) as a, greatest(o.line, a.line) as b
  from asked a join own o on o.size = a.wanted and o.n = a.n and o.piece = substring(a.line, a.start + 1, a.width)
  where a.start >= 0 and o.line <> a.line
), coded as (
  -- one byte for each character outside ASCII, so that distances count characters
  select a, b, {code_a} as x, {code_b} as y from met
), links as (
  select a, b from coded where levenshtein(x, y) <= 2
), edges as (
  select a, b from links union select b, a from links
), reach(node, other) as (
  select a, a from edges union select r.node, e.b from reach r join edges e on r.other = e.a
), classes as (
  select node, min(other) as component from reach group by node
), degrees as (
  select a as node, count(*) as links from edges group by a
), firsts as (
  select line, min((doc * 1000000 + line_no)::hugeint) as first from lines group by line
), named as (
  select f.line, f.first, coalesce(c.component, f.line) as component, coalesce(d.links, 0) as links
  from firsts f left join classes c on c.node = f.line left join degrees d on d.node = f.line
), leads as (
  select component, min(first) as lead from named group by component
)
select l.doc as doc_id, count(*) as n_lines, count(*) filter (l.doc * 1000000 + l.line_no = x.lead) as n_kept, sum(n.links)::bigint as n_links,
       coalesce(string_agg(case when l.doc * 1000000 + l.line_no <> x.lead then l.line_no::varchar end, ',' order by l.line_no), '') as dropped
from lines l join named n on n.line = l.line join leads x on x.component = n.component
group by l.doc
"""


_MIX = r"""
with d as (
  select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, case when source is null then '1' else '0' || source end as s,
         md5('mix-1:' || coalesce(doc_id::varchar, '~')) as draw
  from documents
), src as (
  select s, sum(size)::bigint as source_size from d group by s
), w as (
  select *, case (row_number() over (order by s) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w from src
), shares as (
  select *, (sum(source_size) over () - 3 * coalesce(sum(source_size) over before, 0))::double / (sum(w) over () - coalesce(sum(w) over before, 0))::double as share
  from w window before as (order by source_size::double / w, s rows between unbounded preceding and 1 preceding)
), t as (
  select s, source_size, least(3::double * source_size, greatest(max(share) over (), 0) * w) as target from shares
), q0 as (
  select *, ceil(source_size / 32::double)::bigint as blocks, round(sum(source_size) over ()::double / 32)::bigint as seats, sum(target) over () as total, count(*) over () as n from t
), q1 as (
  select *, case when seats > n and total > 0 then floor(target / (total / (seats - n)) + 0.5::double) else 0 end::bigint as low,
         case when total > 0 then floor(target / (total / (seats + n)) + 0.5::double) else 0 end::bigint as high
  from q0
), q2 as (
  select *, seats - sum(low) over () as open from q1
), candidates as (
  select s, target, open, unnest(range(low + 1, high + 1)) as k from q2
), won as (
  select s, count(*) as won from (select s, open, row_number() over (order by target / (2 * k - 1) desc, s, k) as r from candidates) x where r <= open group by s
), plan as (
  select q2.s, source_size, target, blocks, least(low + coalesce(won, 0), 3 * blocks)::bigint as quota,
         case when blocks > 0 then ('0x' || substr(md5('mix-1:start:' || q2.s), 1, 8))::bigint % blocks else 0 end as start
  from q2 left join won on won.s = q2.s
), placed as (
  select *, sum(size) over (partition by s order by draw, size rows unbounded preceding) as e from d
), cut as (
  select doc_id, size, p.source_size, target, e, e - size as b, case when blocks > 0 then quota // blocks else 0 end as passes,
         case when blocks > 0 then quota % blocks else 0 end as rest, start, blocks
  from placed join plan p on p.s = placed.s
)
select doc_id, size, source_size, target, (passes * size + greatest(least(e, (start + rest) * 32, source_size) - greatest(b, start * 32), 0)
       + greatest(least(e, greatest((start + rest - blocks) * 32, 0)) - b, 0))::bigint as taken
from cut
"""

_URLS = r"""
with c as (
  select page_id, date '2024-01-01' + ((page_id * 37) % 366)::int as day,
         regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '') as host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^/?#]+)', 1) as segment
  from pages
), parts as (
  select *, string_split(host, '.') as labels from c
), lengths as (
  select *, unnest(range(2, len(labels) + 1)) as n from parts
), plain as (
  select page_id, day, host, segment, array_to_string(labels[len(labels) - n + 1:], '.') as key, (n - 2) * 2 as rank from lengths
), keys as (
  select page_id, day, key, rank from plain union all select page_id, day, key || segment, rank + 1 from plain where segment <> ''
), drawn as (
  select key, ('0x' || substr(md5(key), 1, 6))::bigint as draw from (select distinct key from keys) x
), events as (
  select key, date '2024-01-01' + (draw % 200)::int as day, 'block' as action from drawn where draw % 3 <> 0
  union all select key, date '2024-01-01' + (draw % 200 + 30 + draw % 97)::int, 'off' from drawn where draw % 3 <> 0
  union all select key, date '2024-01-01' + (draw % 200 + 150)::int, 'review' from drawn where draw % 3 <> 0 and draw % 2 = 0
), daily as (
  select key, day, max(action) as action from events group by key, day
), spans as (
  select key, action, day as valid_from, lead(day) over (partition by key order by day) as valid_to from daily
), active as (
  select k.page_id, k.rank, s.* from keys k join spans s on s.key = k.key and s.action <> 'off' and s.valid_from <= k.day and (s.valid_to is null or k.day < s.valid_to)
), best as (
  select *, count(*) over (partition by page_id) as n, row_number() over (partition by page_id order by rank desc, valid_from desc, key) as r from active
)
select c.page_id, c.host, c.day::date::varchar as fetched_on, coalesce(b.n, 0) as n_active, coalesce(b.action, 'none') as verdict, b.key as matched_key, b.valid_from::date::varchar as active_since
from c left join best b on b.page_id = c.page_id and b.r = 1
"""

#: Letters outside ASCII in the tables, each put as one control character so that bytes are characters.
_LETTERS = "éèêàçùâîôûëïüöäßñíóúáÉÈÊÀÇÙÂÎÔÛËÏÜÖÄÑÍÓÚÁ"


def _single_bytes(column: str) -> str:
    marks = [c for c in range(1, 128) if not (chr(c).isalnum() or chr(c) in " .,!?#&*%|-+()@:/=\"'_\t\n\r")][: len(_LETTERS)]
    return f"translate({column}, '{_LETTERS[: len(marks)]}', {' || '.join(f'chr({c})' for c in marks)})"


ORACLES: dict[str, str] = {
    "op3_line_dedup": _LINES.format(code_a=_single_bytes("a"), code_b=_single_bytes("b")),
    "op6_mix_sources": _MIX,
    "op8_url_filter": _URLS,
}
