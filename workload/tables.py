"""Grids, profiles, header rows and column suggestions."""
from __future__ import annotations

from pyspark.sql import functions as F

from sheetloom.operators import header as H
from sheetloom.operators import profile as P
from sheetloom.plans.inspect import inspect
from sheetloom.sources.grid import catalog, to_cells, to_grid

from . import query
from .fixtures import LINES_SQL, SHEET_SQL, TYPED_SQL, lines, read, sheet, sql_blank, sql_cell, typed_cells

_ORDER = "o_orderdate, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
_GRID = "o_orderpriority as table_id, cast(row_number() over (partition by o_orderpriority order by {o}) as bigint) as row_idx"
_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


@query("to_grid", f"select {_GRID.format(o=_ORDER)}, {_COLS} from orders")
def _(spark, d):
    return to_grid(read(spark, d, "orders"), F.col("o_orderpriority"), ["o_orderdate", "o_orderkey"], max_cols=4)


@query("to_grid_scan_window", f"select * from (select {_GRID.format(o=_ORDER)}, {_COLS} from orders) where row_idx <= 200")
def _(spark, d):
    # the scan window is the feature: a bounded look at the first rows of every sheet
    return to_grid(read(spark, d, "orders"), F.col("o_orderpriority"), ["o_orderdate", "o_orderkey"], max_cols=4, scan_rows=200)


@query("to_cells", f"with {TYPED_SQL} select table_id, row_idx, cast(col_idx as integer) as col_idx, header, value, cell_type from cells")
def _(spark, d):
    return typed_cells(spark, d)


ALL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
       "pages", "benchmark", "labels", "conversations")


@query("catalog", " union all ".join(
    f"select '{t}' as table_name, count(*) as n_rows, (select count(*) from information_schema.columns where table_name = '{t}') as n_cols from {t}"
    for t in ALL))
def _(spark, d):
    return catalog({t: read(spark, d, t) for t in ALL})


# ---- blank rows -------------------------------------------------------------------

_BLANK = f"blanks as (select table_id, row_idx from lines where {sql_blank('c0')} and {sql_blank('c1')})"


@query("blank_row_gaps", f"""with {LINES_SQL}, {_BLANK}, first_rows as (select *, row_number() over (partition by table_id order by row_idx) as n from blanks)
  select table_id, count(*) as gaps, string_agg(cast(row_idx as varchar), ',' order by row_idx) filter (where n <= 30) as rows from first_rows group by table_id""")
def _(spark, d):
    gaps = P.blank_gaps(lines(spark, d))
    return gaps.select("table_id", "gaps", F.array_join(F.col("rows").cast("array<string>"), ",").alias("rows"))


@query("blank_bands", f"""with {LINES_SQL}, {_BLANK}, islands as (
    select table_id, row_idx, row_idx - row_number() over (partition by table_id order by row_idx) as band from blanks)
  select table_id, min(row_idx) as start_row, count(*) as n_rows from islands group by table_id, band having count(*) >= 2""")
def _(spark, d):
    return P.blank_bands(lines(spark, d))


# ---- table dimensions ----------------------------------------------------------------

@query("table_dimensions", f"""with {LINES_SQL} select table_id, max(row_idx) as max_row, cast(max(case when c1 is not null then 2 when c0 is not null then 1 else 0 end) as bigint) as max_col,
  least(max(row_idx), 20) as scanned_rows from lines group by table_id""")
def _(spark, d):
    return P.dims(lines(spark, d), scan_rows=20).drop("truncated")


@query("truncation_flag", f"""with {SHEET_SQL} select table_id, max(row_idx) > 1000 as truncated from sheet group by table_id""")
def _(spark, d):
    return P.dims(sheet(spark, d), scan_rows=1000).select("table_id", "truncated")


# ---- column profile ---------------------------------------------------------------------

KEYS_SQL = f"""{TYPED_SQL},
keys as (select table_id, cast(col_idx as integer) as col_idx, header, case when not {sql_blank('value')} then {sql_cell('value', 40)} end as key,
  cell_type, row_idx, length(value) as chars from cells),
counted as (select table_id, col_idx, header, key, count(*) as n, min(row_idx) as first_row, max(chars) as chars from keys group by all)"""
SHEET_KEYS_SQL = f"""{SHEET_SQL},
cells as ({' union all '.join(f"select table_id, row_idx, {i} as col_idx, 'c{i}' as header, c{i} as value from sheet" for i in range(6))}),
keys as (select table_id, cast(col_idx as integer) as col_idx, header, row_idx, case when not {sql_blank('value')} then {sql_cell('value', 40)} end as key,
  case when value is null then null when regexp_matches(value, '^[0-9]+$') then 'int' else 'str' end as cell_type, length(value) as chars from cells),
counted as (select table_id, col_idx, header, key, count(*) as n, min(row_idx) as first_row, max(chars) as chars from keys group by all)"""
_COL = "table_id, col_idx, header"


@query("fill_rate", f"""with {SHEET_KEYS_SQL} select {_COL}, round(count(key) / count(*), 3) as fill_rate, count(key) as nonempty from keys group by all""")
def _(spark, d):
    return P.column_stats(P.key_counts(to_cells(sheet(spark, d)))).select("table_id", "col_idx", "header", "fill_rate", "nonempty")


_TYPES = ("bool", "int", "float", "date", "str")


@query("type_mix", f"""with {SHEET_KEYS_SQL}, t as (select {_COL}, cell_type, count(*) as n, min(row_idx) as seen_at from keys where key is not null group by all),
  ranked as (select *, row_number() over (partition by table_id, col_idx order by n desc, seen_at) as r from t)
  select {_COL}, max(case when r = 1 then cell_type end) as inferred_type, {', '.join(f"cast(coalesce(max(n) filter (where cell_type = '{t}'), 0) as bigint) as n_{t}" for t in _TYPES)}
  from ranked group by all""")
def _(spark, d):
    stats = P.column_stats(P.key_counts(to_cells(sheet(spark, d), infer=True)))
    return stats.select("table_id", "col_idx", "header", "inferred_type", *[
        F.coalesce(F.try_element_at("type_mix", F.lit(t)), F.lit(0).cast("bigint")).alias(f"n_{t}") for t in _TYPES])


@query("distinct_capped", f"""with {KEYS_SQL} select {_COL}, count(key) as distinct_n, count(key) > 200 as distinct_capped,
  case when count(key) > 200 then '200+' else cast(count(key) as varchar) end as shown from counted group by all""")
def _(spark, d):
    stats = P.column_stats(P.key_counts(typed_cells(spark, d)))
    shown = F.when(F.col("distinct_capped"), "200+").otherwise(F.col("distinct_n").cast("string"))
    return stats.select("table_id", "col_idx", "header", "distinct_n", "distinct_capped", shown.alias("shown"))


_TOP = "select {c}, cast(r as integer) as rank, key as value, n from (select *, row_number() over (partition by table_id, col_idx order by n desc, first_row, key) as r from {t}) where r <= 8"


@query("top_values", f"with {KEYS_SQL}, filled as (select * from counted where key is not null) " + _TOP.format(c=_COL, t="filled"))
def _(spark, d):
    return P.top_values(P.key_counts(typed_cells(spark, d)))


@query("top_values_first_keys", f"""with {KEYS_SQL}, seen as (select * from (select *, row_number() over (partition by table_id, col_idx order by first_row, key) as s
    from counted where key is not null) where s <= 200) """ + _TOP.format(c=_COL, t="seen"))
def _(spark, d):
    return P.top_values(P.key_counts(typed_cells(spark, d)), cap_keys=200)


@query("max_text_length", f"with {LINES_SQL} select table_id, cast(c as integer) as col_idx, cast(coalesce(max(case when not {sql_blank('v')} then length(v) end), 0) as integer) as max_len from (select table_id, unnest([0, 1]) as c, unnest([c0, c1]) as v from lines) group by all")
def _(spark, d):
    stats = P.column_stats(P.key_counts(to_cells(lines(spark, d))))
    return stats.select("table_id", "col_idx", "max_len")


@query("column_profile", f"""with {KEYS_SQL},
  types as (select {_COL}, cell_type, count(*) as n, min(row_idx) as seen_at from keys where key is not null group by all),
  inferred as (select table_id, col_idx, arg_max(cell_type, struct_pack(n := n, a := -seen_at)) as inferred_type, string_agg(concat(cell_type, '=', n), ',' order by cell_type) as type_mix from types group by all),
  top as (select table_id, col_idx, string_agg(concat(key, '=', n), ';' order by n desc, first_row, key) as top_values from (
    select *, row_number() over (partition by table_id, col_idx order by n desc, first_row, key) as r from counted where key is not null) where r <= 8 group by all)
  select c.table_id, c.col_idx, c.header, cast(sum(n) as bigint) as rows, round(sum(case when key is not null then n else 0 end) / sum(n), 3) as fill_rate,
    cast(sum(case when key is not null then n else 0 end) as bigint) as nonempty, count(key) as distinct_n, count(key) > 200 as distinct_capped,
    any_value(inferred_type) as inferred_type, any_value(type_mix) as type_mix, cast(coalesce(max(case when key is not null then chars end), 0) as integer) as max_len, any_value(top_values) as top_values
  from counted c left join inferred using (table_id, col_idx) left join top using (table_id, col_idx) group by all""")
def _(spark, d):
    mix = F.transform(F.array_sort(F.map_entries("type_mix")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    top = F.transform("top_values", lambda x: F.concat(x["value"], F.lit("="), x["count"].cast("string")))
    return P.profile(typed_cells(spark, d)).withColumn("type_mix", F.array_join(mix, ",")).withColumn("top_values", F.array_join(top, ";"))


@query("column_profile_sketched")
def _(spark, d):
    # sketches: no SQL gives the same estimates
    return P.profile(typed_cells(spark, d), exact=False).drop("type_mix", "top_values")


@query("null_runs", f"""with {SHEET_SQL}, long as ({' union all '.join(f"select table_id, row_idx, cast({i} as bigint) as col_idx, c{i} as v from sheet" for i in range(6))}),
  runs as (select *, count(v) over (partition by table_id, col_idx order by row_idx) as run from long)
  select table_id, col_idx, min(row_idx) as start_row, count(*) as n_rows from runs where run > 0 group by table_id, col_idx, run having count(*) >= 2""")
def _(spark, d):
    return P.null_runs(sheet(spark, d))


# ---- header rows and samples ---------------------------------------------------------------

def _one(c):
    return f"case when {sql_blank(c)} then 0 else 1 end"


HEAD_SQL = f"""scored as (select table_id, row_idx, 3 * ({_one('c0')} + {_one('c1')}) as score from lines where row_idx <= 15),
head as (select table_id, cast(arg_max(row_idx, struct_pack(s := score, r := -row_idx)) as bigint) as header_row, cast(max(score) as bigint) as score from scored group by table_id)"""


@query("header_row", f"with {LINES_SQL}, {HEAD_SQL} select * from head")
def _(spark, d):
    return H.detect_header(lines(spark, d))


@query("split_at_header", f"with {LINES_SQL}, {HEAD_SQL} select table_id, row_idx, header_row, c0, c1 from lines join head using (table_id) where row_idx > header_row")
def _(spark, d):
    return H.split_header(lines(spark, d))


@query("header_override", f"with {LINES_SQL} select table_id, row_idx, c0 from lines where row_idx > 2")
def _(spark, d):
    return H.split_header(lines(spark, d), 2).select("table_id", "row_idx", "c0")


@query("sample_rows", f"""with {LINES_SQL}, {HEAD_SQL}, data as (select table_id, row_idx, c0, c1, row_number() over (partition by table_id order by row_idx) as n
    from lines join head using (table_id) where row_idx > header_row and not ({sql_blank('c0')} and {sql_blank('c1')}))
  select table_id, row_idx, {sql_cell('c0', 60)} as c0, {sql_cell('c1', 60)} as c1 from data where n <= 10""")
def _(spark, d):
    rows = H.sample_rows(H.split_header(lines(spark, d)))
    return rows.select("table_id", "row_idx", F.col("cells")[0].alias("c0"), F.col("cells")[1].alias("c1"))


# ---- suggestions ------------------------------------------------------------------------------

_SUGGEST = f"""{SHEET_KEYS_SQL},
prof as (select {_COL}, round(count(key) / count(*), 3) as fill_rate, count(key) as nonempty, count(distinct key) as distinct_n from keys group by all),
ints as (select table_id, col_idx, row_idx, case when cell_type = 'int' then cast(key as bigint) end as v from keys),
steps as (select table_id, col_idx, v, lag(v) over (partition by table_id, col_idx order by row_idx) as before from ints where v is not null),
mono as (select table_id, col_idx, count(*) as ints, count(*) filter (where v <= before) as breaks from steps group by all),
cand as (select prof.*, coalesce(ints = nonempty and breaks = 0, false) as rising, distinct_n = nonempty as uniq from prof left join mono using (table_id, col_idx)
  where nonempty > 1 and fill_rate < 1),
bound as (select * from (select {_COL}, fill_rate, case when rising then 'rising-number' else 'identifier' end as reason,
  row_number() over (partition by table_id order by case when rising then 0 else 1 end, fill_rate, col_idx) as r from cand where rising or uniq) where r = 1)"""


def _profile_and_boundary(spark, d):
    cells = to_cells(sheet(spark, d), infer=True)
    prof = P.column_stats(P.key_counts(cells))
    return prof, P.suggest_boundary(prof, P.monotonic_columns(cells))


@query("suggest_boundary", f"with {_SUGGEST} select {_COL}, fill_rate, reason from bound")
def _(spark, d):
    return _profile_and_boundary(spark, d)[1]


@query("suggest_roles", f"""with {_SUGGEST} select p.table_id, p.col_idx, p.header, p.fill_rate, case when p.col_idx = b.col_idx then 'boundary' when p.nonempty = 0 then 'empty'
    when p.fill_rate / b.fill_rate <= 1.5 then 'header' when p.fill_rate / b.fill_rate <= 4 and p.distinct_n <= 15 then 'subgroup' else 'detail' end as role
  from prof p join bound b on p.table_id = b.table_id""")
def _(spark, d):
    return P.suggest_roles(*_profile_and_boundary(spark, d))


@query("enum_candidates", f"""with {KEYS_SQL}, kinds as (select table_id, col_idx, count(*) filter (where cell_type = 'str') * 2 > count(*) as text from keys where key is not null group by all)
  select {_COL}, count(*) as distinct_n, string_agg(key, '|' order by key) as "values" from counted join kinds using (table_id, col_idx)
  where key is not null and text group by all having count(*) between 2 and 15""")
def _(spark, d):
    return P.enum_candidates(P.key_counts(typed_cells(spark, d))).withColumn("values", F.array_join("values", "|"))


_STYLES = (("1.", "^\\s*\\d+\\."), ("a.", "^\\s*[a-z]\\."), ("1)", "^\\s*\\d+\\)"), ("a)", "^\\s*[a-z]\\)"))


@query("numbering_styles", f"""with {SHEET_SQL}, found as (select table_id, {', '.join(f"case when bool_or(regexp_matches(c4, '{p}')) then '{n}' end as s{i}" for i, (n, p) in enumerate(_STYLES))}
    from sheet where c4 is not null group by table_id) select table_id, cast(4 as integer) as col_idx, concat_ws('|', s0, s1, s2, s3) as styles from found""")
def _(spark, d):
    cells = to_cells(sheet(spark, d).select("table_id", "row_idx", "c0", "c1", "c2", "c3", "c4")).filter("value is not null")
    return P.numbering_styles(cells).withColumn("styles", F.array_join("styles", "|"))


@query("sheet_report")
def _(spark, d):
    # nested report of every sheet; its parts are compared one by one above
    return inspect(lines(spark, d)).report().select(
        "table_id", "max_row", "header_row", "gaps", "merged", F.size("columns").alias("n_columns"),
        F.size("sample_rows").alias("n_samples"))
