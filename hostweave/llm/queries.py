"""One query for each operator over the test tables, with its SQL where SQL can express it."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from hostweave.llm import (
    divergence as dv, exact_dedup as ed, fingerprint as fp, language as lg, license_scan as ls, mixing as mx, ngram_join as nj, packing as pk, prefix_trie as pt, sharding as sh, suffix_dedup as sd, token_count as tc, url_filter as uf,
)
from hostweave.session import prepare_session

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def prepare(spark: SparkSession) -> None:
    """Session settings of the corpus operators."""
    prepare_session(spark)
    # texts may be long: Arrow batches of few rows keep a Python worker small
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    # workers import this package from where the driver has it, whatever folder the driver runs in
    home, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, home])


def query(name: str, sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(spark, sf_dir)

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_url_filter", r"""
with page as (
  select page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
marks as (select doc_id, min(cast(quality as int)) as outcome from labels where doc_id is not null and quality is not null group by doc_id),
hosts as (
  select host, sum(case when outcome = 1 then 1 else 0 end) as good, count(outcome) as labelled,
         regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', ''),
           '^.*?((?:[^.]+\.(?:ac|co|com|edu|gov|net|org)\.[^.]{2})|(?:[^.]+\.[^.]+))$', '\1') as domain
  from page left join marks on page_id = doc_id group by host),
domains as (select domain, sum(good) as dk, sum(labelled) as dn, regexp_replace(domain, '^[^.]*\.', '') as suffix from hosts group by domain),
suffixes as (select suffix, sum(dk) as sk, sum(dn) as sn from domains group by suffix),
total as (select (coalesce(sum(sk), 0) + 0.5::double) / (coalesce(sum(sn), 0) + 1.0::double) as top from suffixes),
s0 as (select suffix, sk::double as k, sn::double as n, top as p from suffixes, total),
s1 as (select sum(case when n > 0 then n * (k / n - p) * (k / n - p) end) as s, sum(case when n > 0 then p * (1 - p) end) as q,
              sum(case when n > 0 then p * (1 - p) * (n - 1) end) as d from s0),
s2 as (select 1 / least(greatest(coalesce(case when d > 0 then (s - q) / d end, 1e-6), 1e-6), 1 - 1e-6) - 1 as m from s1),
s3 as (select suffix, (k + m * p) / (n + m) as s_mean from s0, s2),
d0 as (select domain, dk::double as k, dn::double as n, s_mean as p from domains join s3 using (suffix)),
d1 as (select sum(case when n > 0 then n * (k / n - p) * (k / n - p) end) as s, sum(case when n > 0 then p * (1 - p) end) as q,
              sum(case when n > 0 then p * (1 - p) * (n - 1) end) as d from d0),
d2 as (select 1 / least(greatest(coalesce(case when d > 0 then (s - q) / d end, 1e-6), 1e-6), 1 - 1e-6) - 1 as m from d1),
d3 as (select domain, (k + m * p) / (n + m) as d_mean from d0, d2),
h0 as (select host, good::double as k, labelled::double as n, d_mean as p from hosts join d3 using (domain)),
h1 as (select sum(case when n > 0 then n * (k / n - p) * (k / n - p) end) as s, sum(case when n > 0 then p * (1 - p) end) as q,
              sum(case when n > 0 then p * (1 - p) * (n - 1) end) as d from h0),
h2 as (select 1 / least(greatest(coalesce(case when d > 0 then (s - q) / d end, 1e-6), 1e-6), 1 - 1e-6) - 1 as m from h1),
h3 as (select host, k + m * p as a, n + m as n from h0, h2),
rep as (select host, a / n + 1.645 * sqrt(a * (n - a) / (n * n * (n + 1))) as bound from h3),
rules(verdict, rule_host, rule_path) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits as (
  select distinct host, path, first_value(verdict) over w as verdict, first_value(rule_host || rule_path) over w as rule
  from (select distinct host, path from page) p
  join rules on (host = rule_host or suffix(host, '.' || rule_host)) and starts_with(path, rule_path)
  window w as (partition by host, path order by length(rule_host || rule_path) desc, rule_host || rule_path))
select page_id, page.host, page.path, rule, coalesce(fits.verdict, case when bound < 0.5 then 'block' else 'allow' end) as verdict
from page join rep on page.host = rep.host left join fits on page.host = fits.host and page.path = fits.path
""")
def op5_url_filter(spark, d):
    """Rules, then host reputation; a page is good if the document with its number has quality 1."""
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("outcome"))
    judged = uf.filter_urls(table(spark, d, "pages"), labels, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op9_exact_dedup", r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
g as (select norm, min(doc_id) as keep_id, count(*) as group_size, sha256(norm) as text_sha256 from n group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from n join g using (norm)
""")
def op9_exact_dedup(spark, d):
    return ed.exact_dedup(table(spark, d, "documents"))


def vocabulary() -> str:
    """The word tokenizer's file; tokenizers are given, never trained or copied here."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark, d):
    return pk.pack_documents(table(spark, d, "documents"), vocabulary(), 2048)


@query("op6_token_count")
def op6_token_count(spark, d):
    return tc.count_tokens(table(spark, d, "documents"), vocabulary(), limit=2048)


@query("op7_fingerprint")
def op7_fingerprint(spark, d):
    return fp.fingerprint_edits(table(spark, d, "documents"))


@query("op1_license_scan")
def op1_license_scan(spark, d):
    return ls.scan_licenses(table(spark, d, "documents"))


def split_held_out(docs: DataFrame) -> DataFrame:
    """``docs`` with held_out: the crc32 of the id as text, modulo 4, is 2."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))


@query("op3_language_id")
def op3_language_id(spark, d):
    """Labels of held-out documents are never read; only text and id enter a prediction."""
    docs = split_held_out(table(spark, d, "documents"))
    model = lg.learn_languages(docs.filter("not held_out"))
    found = lg.identify_languages(docs.select("doc_id", "text"), model)
    return split_held_out(found).select("doc_id", "held_out", "lang_pred", "score", "languages", "shares")


@query("op8_source_mixing")
def op8_source_mixing(spark, d):
    """95 % of the largest entropy, no source repeated more than four times, as many words as there are."""
    return mx.mix_sources(table(spark, d, "documents"), target_entropy=0.95, most_repeats=4.0)


@query("op10_ngram_jaccard_join", r"""with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents),
k as (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0),
s as (select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as g from k),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as common from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * common >= 80 * (p.n + q.n - common)),
e as (select x, y from l union all select y, x from l),
r(doc_id, seen) as (select doc_id, doc_id from w union select r.doc_id, e.y from r join e on e.x = r.seen)
select w.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id from w left join n on n.doc_id = w.doc_id
join (select doc_id, min(seen) as component_id from r group by doc_id) m on m.doc_id = w.doc_id
""")
def op10_ngram_jaccard_join(spark, d):
    return nj.ngram_jaccard_join(table(spark, d, "documents"))


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark, d):
    return sd.remove_repeats(table(spark, d, "documents")).drop("spans")


@query("op11_sharding")
def op11_sharding(spark, d):
    """Sixteen shards of near equal bytes; documents with equal texts are linked."""
    return sh.shard_documents(table(spark, d, "documents"), shards=16)


@query("op12_source_divergence", r"""
with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*) as n from w group by lang, term having count(distinct i) >= 10),
cells as (select w.lang, w.source, w.term, count(*) as n from w join kept on w.lang = kept.lang and w.term = kept.term group by w.lang, w.source, w.term),
langs as (select lang, count(*) as v, sum(n) as total from kept group by lang),
grp as (select g.lang, g.source, coalesce(v, 0)::hugeint as v, coalesce(langs.total, 0)::hugeint as lang_total, coalesce(t.total, 0)::hugeint as total
        from (select distinct lang, source from d) g left join langs on g.lang = langs.lang
        left join (select lang, source, sum(n) as total from cells group by lang, source) t on g.lang = t.lang and g.source = t.source),
grid as (select grp.lang, grp.source, kept.term, coalesce(cells.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(cells.n, 0) + 2)) // (grp.total + 2 * v) as p,
                1 + (1000000000::hugeint * (kept.n + 2)) // (lang_total + 2 * v) as q
         from grp join kept on grp.lang = kept.lang left join cells on grp.lang = cells.lang and grp.source = cells.source and kept.term = cells.term),
pv as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
       from grid a join grid b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
          from grp a join grp b on a.lang = b.lang and a.source <> b.source left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // (p + q) as value from grid where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 10
""")
def op12_source_divergence(spark, d):
    """Terms in at least ten documents of their language; all sources, ten terms each."""
    return dv.source_divergence(table(spark, d, "documents"), least_docs=10, top=10)


@query("op13_prefix_trie", r"""
with turns as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) as j,
                      sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) as h,
                      length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g')) as words
               from conversations where conv_id is not null),
convs as (select c, list(h order by j) as hs, list(words order by j) as ws,
                 (4294967295 - list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ord(x)::bigint)), lambda s, b:
                   list_reduce(list_prepend(xor(s, b), range(8)::bigint[]), lambda a, k: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end))) % 4 as h
          from turns group by c),
seqs as (select x.c, coalesce(list_slice(b.hs, 1, x.h), []) || coalesce(list_slice(x.hs, x.h + 1, len(x.hs)), []) as hs,
                coalesce(list_slice(b.ws, 1, x.h), []) || coalesce(list_slice(x.ws, x.h + 1, len(x.ws)), []) as ws
         from convs x left join convs b on b.c = x.c - x.c % 20),
prefixes as (select c, d, list_slice(hs, 1, d) as k, list_slice(hs, 1, d - 1) as u, case when d > 0 then ws[d] else 0 end as words, d = len(hs) as ends
             from (select c, hs, ws, unnest(range(0, len(hs) + 1)) as d from seqs)),
nodes as (select d, k, any_value(u) as u, min(c) as conv_id, count(*) as n_convs, any_value(words) as words,
                 sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where ends), '')) as ends_sha256 from prefixes group by d, k),
kids as (select u, count(*) as n from nodes where d > 0 group by u),
full_nodes as (select nodes.*, coalesce(kids.n, 0) as n_children, (n_convs - 1) * words as own from nodes left join kids on kids.u = nodes.k),
sums as (select a.k, count(*) filter (where b.n_children = 0) as n_leaves, sum(b.own) as saved_tokens
         from full_nodes a join full_nodes b on b.d >= a.d and list_slice(b.k, 1, a.d) = a.k group by a.k)
select f.conv_id::bigint as conv_id, f.d::bigint as depth, p.conv_id::bigint as parent_conv_id, f.n_convs::bigint as n_convs, f.n_children::bigint as n_children,
       n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, f.ends_sha256
from full_nodes f join sums on sums.k = f.k left join full_nodes p on f.d > 0 and p.k = f.u
""")
def op13_prefix_trie(spark, d):
    """Conversation c takes over the first crc32(c) % 4 turns of conversation c - c % 20."""
    c = F.col("conv_id")
    return pt.conversation_trie(table(spark, d, "conversations"), base=c - c % 20, taken=F.crc32(c.cast("string")) % 4)
