"""Registered queries of the operators, and the SQL that must give the same rows."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from ..operators.staging import shared_dir
from . import bpe, collocations, divergence, suffix_dedup, fingerprint, language_model, neighbours, ngram_join, packing, quality, shards, substring, toxicity
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


_WORDS = r"list_filter(regexp_split_to_array({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP5_SQL = f"""with t as (select doc_id, {_WORDS.format(t="coalesce(text, '')")} as w from documents),
  words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from t),
  windows as (select doc_id, p, count(*) over following as n, string_agg(word, ' ') over following as k from words
    window following as (partition by doc_id order by p rows between current row and 19 following)),
  later as (select doc_id, p from (select *, row_number() over (partition by k order by doc_id, p) as r from windows where n = 20) where r > 1),
  gone as (select distinct doc_id, unnest(range(p, p + 20)) as p from later),
  kept as (select words.doc_id, count(gone.p) as n_removed, string_agg(word, ' ' order by words.p) filter (where gone.p is null) as k
    from words left join gone on words.doc_id = gone.doc_id and words.p = gone.p group by words.doc_id)
  select t.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(k, '')) as kept_sha256
  from t left join kept using (doc_id)"""

# A-Z alone are lower-cased, as the words are compared in that form
OP9_SQL = f"""with recursive t as (select doc_id, {_WORDS.format(t="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
  words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p, len(w) as total from t),
  grams as (select doc_id, total, count(*) over following as n, p, string_agg(word, ' ') over following as g from words
    window following as (partition by doc_id order by p rows between current row and 4 following)),
  sets as materialized (select distinct doc_id, g from grams where n = 5 or (total < 5 and p = 1)),
  sizes as materialized (select doc_id, count(*) as n from sets group by doc_id),
  links as materialized (select a.doc_id as a, b.doc_id as b from sets a join sets b on a.g = b.g and a.doc_id < b.doc_id
    join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
    group by a.doc_id, b.doc_id having 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))),
  ways as materialized (select a, b from links union all select b, a from links),
  reach(doc_id, other) as (select distinct a, a from ways union select reach.doc_id, ways.b from reach join ways on reach.other = ways.a)
  select t.doc_id, coalesce(sizes.n, 0) as n_shingles, coalesce(c.component_id, t.doc_id) as component_id
  from t left join sizes on sizes.doc_id = t.doc_id left join (select doc_id, min(other) as component_id from reach group by doc_id) c on c.doc_id = t.doc_id"""


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


@query("op1_bpe_chunks")
def _(spark, d):
    return bpe.encode_decode(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


@query("op2_id_shards")
def _(spark, d):
    path = f"{shared_dir(spark)}/sheetloom/ids-{uuid.uuid4().hex}"
    shards.write_shards(table(spark, d, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return shards.read_shards(spark, path).drop("ids")


@query("op10_packing")
def _(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


@query("op6_minhash")
def _(spark, d):
    return fingerprint.fingerprint_documents(table(spark, d, "documents"))


@query("op9_ngram_join", OP9_SQL)
def _(spark, d):
    return ngram_join.join_sets(table(spark, d, "documents"))


@query("op5_substring_dedup", OP5_SQL)
def _(spark, d):
    return substring.remove_repeats(table(spark, d, "documents")).drop("text", "spans")


@query("op3_quality")
def _(spark, d):
    docs = table(spark, d, "documents")
    return quality.score(docs, quality.fit(docs))


@query("op7_toxicity")
def _(spark, d):
    docs = table(spark, d, "documents")
    model = toxicity.fit_labels(docs, table(spark, d, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query("op4_neighbours")
def _(spark, d):
    return neighbours.nearest(table(spark, d, "embeddings"))


@query("op8_eftrie_lm")
def _(spark, d):
    return language_model.score_documents(table(spark, d, "documents"))


_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13_SQL = f"""with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
  t as (select r, lang, source, {_LOWER.format(t="unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'))")} as term from d),
  kept as (select lang, term from t group by lang, term having count(distinct r) >= 10),
  v as (select lang, count(*) as v from kept group by lang),
  g as (select distinct lang, source from d),
  gc as (select lang, source, term, count(*)::hugeint as c from t join kept using (lang, term) group by all),
  gn as (select g.lang, g.source, coalesce(sum(gc.c), 0)::hugeint as n from g left join gc using (lang, source) group by all),
  gp as (select k.lang, gn.source, k.term, coalesce(gc.c, 0) as c,
      1 + ((coalesce(gc.c, 0) + 2) * 1000000000) // (gn.n + 2 * v.v) as p
    from kept k join v using (lang) join gn using (lang) left join gc on gc.lang = k.lang and gc.source = gn.source and gc.term = k.term),
  lc as (select lang, term, sum(c) as c from gc group by all),
  lp as (select lang, term, 1 + ((c + 2) * 1000000000) // (sum(c) over (partition by lang) + 2 * v.v) as q from lc join v using (lang)),
  ps as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
    from gp a join gp b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
  pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(ps.value, 0) as value
    from g a join g b on a.lang = b.lang and a.source <> b.source left join ps on ps.lang = a.lang and ps.source = a.source and ps.item = b.source),
  terms as (select gp.lang, gp.source, 'term' as part, gp.term as item, (p - q) * (p - q) // (p + q) as value
    from gp join lp using (lang, term) where gp.c > 0 and p > q),
  ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms))
  select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 10"""


@query("op13_source_divergence", OP13_SQL)
def _(spark, d):
    return divergence.audit(table(spark, d, "documents"))


OP11_SQL = f"""with d as (select coalesce(lang, 'und') as lang, {_LOWER.format(t="coalesce(text, '')")} as t from documents),
  p as (select lang, row_number() over () as pid, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws
    from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d)),
  g as (select lang, ws, unnest(generate_series(1, len(ws))) as i from p),
  grams as (select lang, n, array_to_string(ws[i:i + n - 1], ' ') as phrase from g join (values (1), (2), (3)) v(n) on i + n - 1 <= len(ws)),
  f as (select lang, n, phrase, count(*) as f from grams group by all),
  tot as (select lang, count(*) as words from grams where n = 1 group by lang),
  c as (select lang, n, phrase, f as a, ws[1] as h1, array_to_string(ws[2:], ' ') as r1, ws[1] || ' ' || ws[2] as h2, ws[3] as r2,
      ws[2] || ' ' || ws[3] as tail
    from (select *, string_split(phrase, ' ') as ws from f where n >= 2 and f >= 10)),
  cuts as (select c.lang, c.phrase, c.a, 1 as k, l.f as l, r.f as r from c
      join f l on l.lang = c.lang and l.phrase = c.h1 join f r on r.lang = c.lang and r.phrase = c.r1
    union all select c.lang, c.phrase, c.a, 2, l.f, r.f from c
      join f l on l.lang = c.lang and l.phrase = c.h2 join f r on r.lang = c.lang and r.phrase = c.r2 where c.n = 3),
  scored as (select *, (a::hugeint * a * 1000000) // (l::hugeint * r) as score from cuts),
  best as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as o from scored) where o = 1),
  inside as (select lang, h2 as phrase, a from c where n = 3 union all select lang, tail, a from c where n = 3),
  outer_ as (select lang, phrase, max(a) as outer_a from inside group by all),
  kept as (select b.* from best b left join outer_ o using (lang, phrase) where o.outer_a is null or 100 * o.outer_a < 50 * b.a),
  ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
  select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, tot.words::bigint as n, score::bigint as score
  from ranked join tot using (lang) where rank <= 2000"""


@query("op11_collocations", OP11_SQL)
def _(spark, d):
    return collocations.collocations(table(spark, d, "documents"))


@query("op12_suffix_dedup")
def _(spark, d):
    return suffix_dedup.remove_repeats(table(spark, d, "documents").select("doc_id", "text")).drop("text")
