"""Fingerprints, similarity, family matching and promotion."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sheetloom.operators import families as FM
from sheetloom.operators import fingerprint as FP
from sheetloom.operators import profile as P
from sheetloom.operators.staging import shared_dir
from sheetloom.sources.families import read_families, write_families
from sheetloom.sources.grid import to_cells

from . import query
from .fixtures import LINES_SQL, SHEET_SQL, _once, lines, read, sheet, sql_blank, sql_cell, typed_cells
from .tables import KEYS_SQL

DIM = 64

# ---- a family store from the embeddings: a label is a family, a vector a member ------------

MEMBERS_SQL = """members as (select cast(label as varchar) as name, cast(vec_id as varchar) as job_id, vec_id, embedding as v from embeddings),
elems as (select name, unnest(v) as x, generate_subscripts(v, 1) as pos from members),
centers as (select name, pos, round(avg(cast(x as double)), 6) as x from elems group by all),
fams as (select name, list(x order by pos) as v from centers group by name)"""
_COS = "list_cosine_similarity(cast({a} as double[]), {b})"
SCORED_SQL = f"""{MEMBERS_SQL},
scored as (select vec_id, fams.name, {_COS.format(a='members.v', b='fams.v')} as score from members, fams),
ranked as (select *, row_number() over (partition by vec_id order by score desc, name) as r from scored)"""
_TIER = "case when {s} is null then 'no-families' when {s} >= 0.95 then 'near-duplicate' when {s} >= 0.65 then 'same-family' else 'unrelated' end"


def members(spark, d):
    return read(spark, d, "embeddings").select(
        F.col("label").cast("string").alias("name"), F.col("vec_id").cast("string").alias("job_id"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("vec_id") % 28 + 1).cast("string"), 2, "0")).alias("added"),
        F.lit(1).cast("bigint").alias("built_against"), F.col("embedding").cast("array<double>").alias("vector"))


def fams(spark, d):
    means = FM.centroid(members(spark, d), size=DIM)
    return means.select("name", F.lit(1).cast("bigint").alias("canonical_version"),
                        F.concat(F.lit("none-"), "name").alias("canonical_source"), "vector", "n_members")


def vectors(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))


@query("family_centroids", f"""with {MEMBERS_SQL} select name, cast(pos as integer) as pos, x, (select count(*) from members m where m.name = centers.name) as n_members from centers""")
def _(spark, d):
    out = FM.centroid(members(spark, d), size=DIM).select("name", "n_members", F.posexplode("vector").alias("p", "x"))
    return out.select("name", (F.col("p") + 1).alias("pos"), "x", "n_members")


@query("cosine_to_families", f"with {SCORED_SQL} select vec_id, r as rank, name, round(score, 6) + 0.0 as score from ranked")
def _(spark, d):
    out = FM.top_matches(vectors(spark, d), fams(spark, d), n=None, key="vec_id")
    return out.select("vec_id", "rank", "name", F.round("score", 6).alias("score"))


@query("score_against_all", f"""with {SCORED_SQL} select vec_id, count(*) as n_families, round(min(score), 6) + 0.0 as worst, round(max(score), 6) + 0.0 as best from scored group by vec_id""")
def _(spark, d):
    out = FM.top_matches(vectors(spark, d), fams(spark, d), n=None, key="vec_id", block_rows=4)
    return out.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n_families"), F.round(F.min("score"), 6).alias("worst"),
                                     F.round(F.max("score"), 6).alias("best"))


@query("top_matches", f"with {SCORED_SQL} select vec_id, r as rank, name, round(score, 6) + 0.0 as score, {_TIER.format(s='score')} as tier from ranked where r <= 5")
def _(spark, d):
    out = FM.top_matches(vectors(spark, d), fams(spark, d), n=5, key="vec_id", block_rows=3)
    return out.withColumn("score", F.round("score", 6))


@query("reuse_tier", f"with {SCORED_SQL} select vec_id, name as best, round(score, 3) + 0.0 as score, {_TIER.format(s='score')} as verdict from ranked where r = 1")
def _(spark, d):
    return FM.match(vectors(spark, d), fams(spark, d), key="vec_id")


@query("family_store", f"""with {MEMBERS_SQL} select name, cast(1 as bigint) as canonical_version, concat('none-', name) as canonical_source,
  round(list_sum(v), 4) as total, (select count(*) from members m where m.name = fams.name) as n_members from fams""")
def _(spark, d):
    path = f"{shared_dir(spark)}/sheetloom/store-{uuid.uuid4().hex}"
    write_families(fams(spark, d), members(spark, d), path)
    # one unreadable record per family, which the reader must skip
    members(spark, d).select(F.concat(F.lit('{"name": '), "name").alias("value")).distinct().write.mode("append").text(f"{path}/families")
    families, stored = read_families(spark, path)
    counted = stored.groupBy("name").agg(F.count(F.lit(1)).alias("n_members"))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return families.drop("n_members").join(counted, "name").select(
        "name", "canonical_version", "canonical_source", F.round(total, 4).alias("total"), "n_members")


# ---- promotion ---------------------------------------------------------------------------------

@query("new_members", "select cast(doc_id as varchar) as job_id, lang as name from documents where not exists (select 1 from labels l where l.doc_id = documents.doc_id)")
def _(spark, d):
    known = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id").select(
        F.col("doc_id").cast("string").alias("job_id"), F.col("lang").alias("name"))
    cand = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("job_id"), F.col("lang").alias("name"))
    return FM.new_members(cand, known)


_SPLIT = """all_m as (select cast(label as varchar) as name, cast(vec_id as varchar) as job_id, vec_id,
  concat('2024-01-', lpad(cast(vec_id % 28 + 1 as varchar), 2, '0')) as added, embedding as v from embeddings),
old_m as (select * from all_m where vec_id % 2 = 0 and name <> '3'), cand as (select * from all_m where vec_id % 2 = 1 or name = '3'),
turns as (select *, row_number() over (partition by name order by added, job_id) as turn, name <> '3' as known from cand)"""


def _promoted(spark, d, mode, **kw):
    every = members(spark, d)
    is_new = (F.col("job_id").cast("bigint") % 2 == 1) | (F.col("name") == "3")
    old, cand = every.filter(~is_new), every.filter(is_new).drop("built_against")
    families = FM.centroid(old, size=DIM).select(
        "name", F.lit(1).cast("bigint").alias("canonical_version"), F.lit("0").alias("canonical_source"), "vector", "n_members")
    return FM.promote(families, old, cand, mode, size=DIM, **kw)


@query("promote_members", f"""with {_SPLIT}, m as (select name, job_id, added, cast(1 as bigint) as built_against from old_m
    union all select name, job_id, added, cast(1 as bigint) from turns)
  select * from m""")
def _(spark, d):
    return _promoted(spark, d, "add")[1].drop("vector")


@query("promote_evolve", f"""with {_SPLIT}, latest as (select name, max(turn) as t, arg_max(job_id, turn) as job, bool_or(known) as known from turns group by name)
  select all_m.name, cast(any_value(case when known then 1 + t else t end) as bigint) as canonical_version, any_value(job) as canonical_source, count(*) as n_members
  from all_m join latest using (name) group by all_m.name""")
def _(spark, d):
    return _promoted(spark, d, "evolve")[0].select("name", "canonical_version", "canonical_source", "n_members")


@query("promote_strict", f"""with {_SPLIT}, e as (select name, unnest(v) as x, generate_subscripts(v, 1) as pos from old_m),
  c as (select name, pos, round(avg(cast(x as double)), 6) as x from e group by all), f as (select name, list(x order by pos) as v from c group by name)
  select cand.name, cand.job_id from cand left join f using (name) where f.v is null or {_COS.format(a='cand.v', b='f.v')} >= 0.3
  union all select name, job_id from old_m""")
def _(spark, d):
    return _promoted(spark, d, "add", min_score=0.3)[1].select("name", "job_id")


@query("canonical_member", f"""with m as (select cast(label as varchar) as name, cast(vec_id as varchar) as job_id, vec_id % 28 as added,
    case when label % 2 = 0 then 'none' else cast(max(vec_id) over (partition by label) as varchar) end as source from embeddings)
  select name, arg_min(job_id, struct_pack(a := case when job_id = source then 0 else 1 end, b := added, c := job_id)) as job_id from m group by name""")
def _(spark, d):
    m = members(spark, d)
    last = read(spark, d, "embeddings").groupBy("label").agg(F.max("vec_id").cast("string").alias("m"))
    families = last.select(F.col("label").cast("string").alias("name"),
                           F.when(F.col("label") % 2 == 0, "none").otherwise(F.col("m")).alias("canonical_source"))
    return FM.canonical(m, families).select("name", "job_id")


@query("backfill_vectors", "select cast(vec_id as varchar) as job_id, round(list_sum(cast(embedding as double[])), 6) as total from embeddings")
def _(spark, d):
    m = members(spark, d)
    holes = m.withColumn("vector", F.when(F.col("job_id").cast("bigint") % 3 != 0, F.col("vector")))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return FM.backfill(holes, m.select("job_id", "vector")).select("job_id", F.round(total, 6).alias("total"))


# ---- features of the typed tables and of the text sheets -------------------------------------------

PROF_SQL = f"""{KEYS_SQL},
stats as (select table_id, col_idx, header, round(sum(case when key is not null then n else 0 end) / sum(n), 3) as fill_rate,
  least(count(key), 200) as di, coalesce(max(case when key is not null then chars end), 0) as max_len, cast(sum(n) as bigint) as n_rows from counted group by all),
kinds as (select table_id, col_idx, any_value(cell_type) as kind from keys group by all),
prof as (select stats.*, kind from stats join kinds using (table_id, col_idx))"""


def typed_profile(spark, d):
    return _once("typed_profile", spark, d, lambda: P.profile(typed_cells(spark, d)))


def typed_features(spark, d):
    dims = typed_cells(spark, d).groupBy("table_id").agg(F.max("row_idx").alias("max_row"))
    return FP.features(typed_profile(spark, d), dims)


# fill rates that differ: the sheets of lines have two columns, the order sheets six
SHEET_PROF_SQL = f"""{SHEET_SQL},
cells as ({' union all '.join(f"select table_id, row_idx, {i} as col_idx, c{i} as value from sheet" for i in range(6))}),
keys as (select table_id, col_idx, row_idx, case when not {sql_blank('value')} then {sql_cell('value', 40)} end as key, length(value) as chars,
  case when value is null then null when regexp_matches(value, '^[0-9]+$') then 'int' else 'str' end as cell_type from cells),
counted as (select table_id, col_idx, key, count(*) as n, min(row_idx) as first_row from keys group by all),
kinds as (select table_id, col_idx, arg_max(cell_type, struct_pack(n := n, a := -f)) as kind from (
  select table_id, col_idx, cell_type, count(*) as n, min(row_idx) as f from keys where key is not null group by all) group by all),
stats as (select table_id, col_idx, round(count(key) / count(*), 3) as fill_rate, least(count(distinct key), 200) as di,
  coalesce(max(case when key is not null then chars end), 0) as max_len, count(*) as n_rows from keys group by all),
prof as (select stats.*, kind from stats left join kinds using (table_id, col_idx)),
tops as (select * from (select *, row_number() over (partition by table_id, col_idx order by n desc, first_row, key) as r from counted where key is not null) where r <= 8),
styles as (select t.table_id, t.col_idx, {', '.join(f"bool_or(regexp_matches(key, '{p}')) as s{i}" for i, p in enumerate((
  '^\\s*\\d+\\.', '^\\s*[a-z]\\.', '^\\s*\\d+\\)', '^\\s*[a-z]\\)')))} from tops t join kinds using (table_id, col_idx) where kind = 'str' group by all),
gap as (select table_id, count(*) as gaps from sheet where c0 is null and c1 is null and c2 is null and c3 is null and c4 is null and c5 is null group by table_id),
base as (select table_id, count(*) as ncol, max(n_rows) as max_row, min(fill_rate) as min_fill, case when min(fill_rate) > 0 then round(1 / min(fill_rate), 1) else 0.0 end as rows_per_entry,
  count(*) filter (where kind = 'str' and di between 2 and 15 and fill_rate > 0.1) as enum_cols, count(*) filter (where kind = 'int' and di > 20) as code_cols,
  count(*) filter (where max_len > 100) as longtext_cols, count(*) filter (where fill_rate < 0.1) as b0, count(*) filter (where fill_rate >= 0.1 and fill_rate < 0.25) as b1,
  count(*) filter (where fill_rate >= 0.25 and fill_rate < 0.5) as b2, count(*) filter (where fill_rate >= 0.5 and fill_rate < 0.75) as b3,
  count(*) filter (where fill_rate >= 0.75) as b4 from prof group by table_id),
numb as (select table_id, count(*) filter (where s0 or s1 or s2 or s3) as numbering_cols,
  cast(max(cast(s0 as int)) + max(cast(s1 as int)) + max(cast(s2 as int)) + max(cast(s3 as int)) as bigint) as num_styles from styles group by table_id),
feat as (select base.*, coalesce(numbering_cols, 0) as numbering_cols, coalesce(num_styles, 0) as num_styles, round(coalesce(gaps, 0) / max_row, 3) as gap_density
  from base left join numb using (table_id) left join gap using (table_id))"""


def sheet_features(spark, d):
    def build():
        grid = sheet(spark, d)
        return FP.features(P.profile(to_cells(grid, infer=True)), P.dims(grid), P.blank_gaps(grid))
    return _once("sheet_features", spark, d, build)


def _buckets(df):
    return df.select("*", *[F.col("fill_buckets")[i].alias(f"b{i}") for i in range(5)]).drop("fill_buckets")


@query("fill_buckets", f"with {SHEET_PROF_SQL} select table_id, b0, b1, b2, b3, b4 from feat")
def _(spark, d):
    prof = P.column_stats(P.key_counts(to_cells(sheet(spark, d))))
    return _buckets(prof.groupBy("table_id").agg(FP.fill_buckets().alias("fill_buckets")))


@query("rows_per_entry", f"with {SHEET_PROF_SQL} select table_id, min_fill, rows_per_entry from feat")
def _(spark, d):
    prof = P.column_stats(P.key_counts(to_cells(sheet(spark, d))))
    return prof.groupBy("table_id").agg(F.min("fill_rate").alias("min_fill")).withColumn(
        "rows_per_entry", FP.rows_per_entry(F.col("min_fill")))


@query("column_kind_counts", f"""with {PROF_SQL} select table_id, count(*) filter (where kind = 'str' and di between 2 and 15 and fill_rate > 0.1) as enum_cols,
  count(*) filter (where kind = 'int' and di > 20) as code_cols, count(*) filter (where max_len > 100) as longtext_cols from prof group by table_id""")
def _(spark, d):
    return typed_features(spark, d).select("table_id", "enum_cols", "code_cols", "longtext_cols")


@query("numbering_features", f"with {SHEET_PROF_SQL} select table_id, num_styles, numbering_cols from feat")
def _(spark, d):
    return sheet_features(spark, d).select("table_id", "num_styles", "numbering_cols")


@query("gap_density", f"""with {LINES_SQL} select table_id, round(count(*) filter (where {sql_blank('c0')} and {sql_blank('c1')}) / max(row_idx), 3) as gap_density from lines group by table_id""")
def _(spark, d):
    grid = lines(spark, d)
    both = P.dims(grid).join(P.blank_gaps(grid).select("table_id", "gaps"), "table_id", "left")
    return both.select("table_id", FP.gap_density(F.coalesce("gaps", F.lit(0)), F.col("max_row")).alias("gap_density"))


_FEATURES = "ncol, max_row, min_fill, rows_per_entry, num_styles, numbering_cols, enum_cols, code_cols, longtext_cols"


@query("feature_row", f"""with {SHEET_PROF_SQL} select table_id, {_FEATURES}, cast(0 as bigint) as merged, gap_density, b0, b1, b2, b3, b4, 'c0,c1,c2,c3,c4,c5' as headers from feat""")
def _(spark, d):
    return _buckets(sheet_features(spark, d)).withColumn("headers", F.array_join("headers", ","))


VECTOR_SQL = f"""{SHEET_PROF_SQL},
vecs as (select table_id, [b0 / ncol, b1 / ncol, b2 / ncol, b3 / ncol, b4 / ncol, least(num_styles, 4) / 4, least(enum_cols, 4) / 4, least(code_cols, 3) / 3,
  least(longtext_cols, 5) / 5, least(rows_per_entry / 4, 1.0), least(gap_density * 10, 1.0)] as v from feat)"""


@query("fingerprint_vector", f"with {VECTOR_SQL} select table_id, cast(i as integer) as pos, round(cast(v[i] as double), 6) as x from vecs, range(1, 12) r(i)")
def _(spark, d):
    out = FP.fingerprint(sheet_features(spark, d)).select("table_id", F.posexplode("vector").alias("p", "x"))
    return out.select("table_id", (F.col("p") + 1).alias("pos"), F.round("x", 6).alias("x"))


# ---- comparison with the first sheet, taken as canonical ---------------------------------------------

def _canon(df):
    """Per table width, the first table stands in for the canonical member."""
    rest = [c for c in df.columns if c not in ("table_id", "ncol")]
    first = df.groupBy("ncol").agg(F.min_by(F.struct(*rest), "table_id").alias("c"))
    return first.select("ncol", "c.*")


@query("feature_delta", f"""with {SHEET_PROF_SQL}, long as (unpivot (select table_id, cast(ncol as double) as ncol, cast(rows_per_entry as double) as rows_per_entry,
    cast(num_styles as double) as num_styles, cast(enum_cols as double) as enum_cols, cast(code_cols as double) as code_cols,
    cast(longtext_cols as double) as longtext_cols, cast(gap_density as double) as gap_density from feat) on columns(* exclude table_id) into name feature value v)
  select l.table_id, l.feature, l.v as table_value, c.v as canonical_value, round(l.v - c.v, 2) as delta from long l join long c using (feature)
  where c.table_id = (select min(table_id) from feat)""")
def _(spark, d):
    feats = sheet_features(spark, d)
    return FP.feature_delta(feats, feats.select("table_id", "ncol").join(_canon(feats), "ncol"))


@query("header_diff", """with a as (select column_name as header from information_schema.columns where table_name = 'orders'),
    b as (select case when ordinal_position % 2 = 0 then replace(column_name, 'l_', 'o_') else column_name end as header from information_schema.columns where table_name = 'lineitem')
  select coalesce(a.header, b.header) as header, case when a.header is not null and b.header is not null then 'matched' when a.header is not null then 'new' else 'missing' end as state
  from a full join b on a.header = b.header""")
def _(spark, d):
    def heads(name, rename):
        cells = typed_cells(spark, d).filter(F.col("table_id") == name)
        return cells.select(F.when((F.col("col_idx") % 2 == 1) & F.lit(rename), F.replace("header", F.lit("l_"), F.lit("o_")))
                            .otherwise(F.col("header")).alias("header"))
    return FM.header_diff(heads("orders", False), heads("lineitem", True))


@query("header_jaccard", f"""with docs_h as (select doc_id, list_distinct(regexp_extract_all(split_part(text, chr(10), 1), '[\\p{{L}}\\p{{N}}_]+')) as a,
    list_distinct(regexp_extract_all(reverse(split_part(reverse(text), chr(10), 1)), '[\\p{{L}}\\p{{N}}_]+')) as b from documents)
  select doc_id, round(case when len(a) + len(b) = 0 then 0 else len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) end, 6) as similarity from docs_h""")
def _(spark, d):
    first, last = F.split_part("text", F.lit("\n"), F.lit(1)), F.split_part("text", F.lit("\n"), F.lit(-1))
    return read(spark, d, "documents").select("doc_id", F.round(FM.header_jaccard(F.array(first), F.array(last)), 6).alias("similarity"))


@query("union_of_word_sets", """with w as (select d.doc_id, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]{3,}')) as a,
    list_distinct(regexp_extract_all(lower(d.source), '[a-z0-9]{3,}')) as b from documents d)
  select doc_id, len(list_distinct(list_concat(a, b))) as n_union, len(list_intersect(a, b)) as n_shared from w""")
def _(spark, d):
    from sheetloom.functions.text import word_set
    rows = read(spark, d, "documents").select("doc_id", word_set(F.col("text")).alias("a"), word_set(F.col("source")).alias("b"))
    return rows.select("doc_id", F.size(F.array_union("a", "b")).cast("bigint").alias("n_union"),
                       F.size(F.array_intersect("a", "b")).cast("bigint").alias("n_shared"))


@query("conformance", f"""with {MEMBERS_SQL}, canon as (select name, arg_min(v, vec_id) as cv from members group by name),
  t as (select vec_id, name, v, case vec_id % 4 when 0 then ['no', 'title'] when 1 then ['no', 'title', 'extra'] when 2 then ['no'] else ['other'] end as h from members),
  s as (select t.vec_id, t.name, round({_COS.format(a='t.v', b='cast(canon.cv as double[])')}, 3) + 0.0 as cosine, h, list_filter(h, lambda x: not list_contains(['no', 'title'], x)) as new,
    list_filter(['no', 'title'], lambda x: not list_contains(h, x)) as missing from t join canon using (name))
  select cast(vec_id as varchar) as table_id, name, cosine, array_to_string(list_sort(new), ',') as new_headers, array_to_string(list_sort(missing), ',') as missing_headers,
    case when cosine >= 0.95 and len(new) = 0 and len(missing) <= 1 then 'conforms' when cosine >= 0.65 then 'same-family-with-delta' else 'divergent' end as verdict from s""")
def _(spark, d):
    heads = F.expr("""case cast(job_id as bigint) % 4 when 0 then array('no', 'title') when 1 then array('no', 'title', 'extra')
                      when 2 then array('no') else array('other') end""")
    tables = members(spark, d).select(F.col("job_id").alias("table_id"), "name", "vector", heads.alias("headers"))
    canon = members(spark, d).groupBy("name").agg(F.min_by("vector", F.col("job_id").cast("bigint")).alias("vector"))
    out = FM.conformance(tables, canon.withColumn("headers", F.array(F.lit("no"), F.lit("title"))))
    return out.select("table_id", "name", "cosine", F.array_join("new_headers", ",").alias("new_headers"),
                      F.array_join("missing_headers", ",").alias("missing_headers"), "verdict")
