"""Text scalars and row predicates."""
from __future__ import annotations

from pyspark.sql import functions as F

from sheetloom.functions import text as T

from . import query
from .fixtures import (DIRTY_SQL, LINES_SQL, MESSY_SQL, SHEET_SQL, SPACE, WORD, dirty, lines, messy, read, sheet,
                       sql_blank, sql_cell, sql_clean, sql_dehyphenate, sql_strip)

CELLS = [f"c{i}" for i in range(6)]
LISTED = "('-', '–', '—', 'N/A', 'n/a', 'null', 'NULL')"


@query("clean_text", f"with {DIRTY_SQL} select doc_id, {sql_clean('t')} as cleaned from dirty")
def _(spark, d):
    return dirty(spark, d).select("doc_id", T.clean(F.col("t")).alias("cleaned"))


@query("dehyphenate_linebreak", f"with {DIRTY_SQL} select doc_id, {sql_dehyphenate(sql_clean('t'))} as joined from dirty")
def _(spark, d):
    return dirty(spark, d).select("doc_id", T.dehyphenate(T.clean(F.col("t"))).alias("joined"))


_PAIR = f"'{WORD}+-{WORD}+'"


@query("dehyphenate_keep_reduplication", f"""with {DIRTY_SQL},
  parts as (select doc_id, {sql_dehyphenate(sql_clean('t'))} as s from dirty),
  cut as (select doc_id, regexp_extract_all(s, {_PAIR}) as hits, regexp_split_to_array(s, {_PAIR}) as rest from parts),
  fixed as (select doc_id, rest, list_transform(hits, lambda h: case
      when lower(split_part(h, '-', 1)) = lower(split_part(h, '-', 2)) then h
      when length(split_part(h, '-', 1)) >= 3 and length(split_part(h, '-', 2)) >= 3 and (
        starts_with(lower(split_part(h, '-', 1)), lower(split_part(h, '-', 2)))
        or ends_with(lower(split_part(h, '-', 1)), lower(split_part(h, '-', 2)))
        or starts_with(lower(split_part(h, '-', 2)), lower(split_part(h, '-', 1)))
        or ends_with(lower(split_part(h, '-', 2)), lower(split_part(h, '-', 1)))) then h
      else replace(h, '-', '') end) as hits from cut)
  select doc_id, array_to_string(list_transform(range(len(rest)),
      lambda i: concat(rest[i + 1], coalesce(hits[i + 1], ''))), '') as joined from fixed""")
def _(spark, d):
    return dirty(spark, d).select("doc_id", T.dehyphenate(T.clean(F.col("t")), merge_no_space=True).alias("joined"))


@query("dehyphenate_all", f"""with {DIRTY_SQL} select doc_id,
  regexp_replace({sql_dehyphenate(sql_clean('t'))}, '({WORD}+)-({WORD}+)', '\\1\\2', 'g') as joined from dirty""")
def _(spark, d):
    return dirty(spark, d).select("doc_id", T.dehyphenate(T.clean(F.col("t")), True, False).alias("joined"))


@query("strip_trailing_words", f"""with {DIRTY_SQL} select doc_id, nullif(regexp_replace(regexp_replace(t,
  '(?i){SPACE}+(?:dan|atau|and|or){SPACE}*$', ''), '{SPACE}+$', ''), '') as stripped from dirty""")
def _(spark, d):
    return dirty(spark, d).select("doc_id", T.strip_trailing_words(F.col("t")).alias("stripped"))


@query("code_to_text", """select p_partkey, case when p_retailprice = floor(p_retailprice)
    then cast(cast(p_retailprice as bigint) as varchar) else cast(p_retailprice as varchar) end as price_code,
  lpad(cast(p_size as varchar), 4, '0') as size_code, nullif(trim(p_brand), '') as brand_code from part""")
def _(spark, d):
    return read(spark, d, "part").select(
        "p_partkey", T.as_int_str(F.col("p_retailprice"), "double").alias("price_code"),
        F.lpad(T.as_int_str(F.col("p_size")), 4, "0").alias("size_code"), T.as_int_str(F.col("p_brand")).alias("brand_code"))


@query("strip_hidden", f"""with {DIRTY_SQL} select doc_id,
  regexp_replace(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]|\\p{{Cf}}', '', 'g') as visible from dirty""")
def _(spark, d):
    return dirty(spark, d).select("doc_id", T.strip_hidden(F.col("t")).alias("visible"))


@query("cell_display_text", f"with {DIRTY_SQL} select doc_id, {sql_cell('t', 60)} as shown from dirty")
def _(spark, d):
    return dirty(spark, d).select("doc_id", T.cell_str(F.col("t")).alias("shown"))


@query("strip_bullet", f"""select l_orderkey, l_partkey, l_linenumber,
    nullif({sql_strip("regexp_replace(concat('-  ', l_returnflag, ' - ', l_linestatus), '^-' || '" + SPACE + "+', '')")}, '') as item,
    nullif(ltrim(concat('- - ', case when l_linenumber = 3 then '' else l_linestatus end), '- '), '') as bare from lineitem""")
def _(spark, d):
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        T.strip_bullet(F.concat(F.lit("-  "), "l_returnflag", F.lit(" - "), "l_linestatus")).alias("item"),
        T.strip_dashes(F.concat(F.lit("- - "), F.when(F.col("l_linenumber") == 3, "").otherwise(F.col("l_linestatus")))).alias("bare"))


FIXES = [("thth", "th"), ("eaueau", "eau"), ("ionion", "ion"), ("th the", "the"), ("ouou", "ou")]


def _fixed_sql(x: str) -> str:
    for old, new in FIXES:
        x = f"replace({x}, '{old}', '{new}')"
    return x


@query("replace_fix_list", f"select doc_id, {_fixed_sql('text')} as fixed from documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", T.replace_all(F.col("text"), FIXES).alias("fixed"))


@query("canonicalize_labels", f"""with raw as (select o_orderkey, concat(o_orderstatus, '/', case when o_orderkey % 2 = 0
    then o_orderpriority else 'Head  office' end) as label from orders),
  folded as (select o_orderkey, regexp_replace({sql_clean('label')}, 'Head +office', 'Head Office', 'g') as s from raw)
  select o_orderkey, case when starts_with(s, 'F/') then 'Filled' when starts_with(s, 'O/') then 'Open' else s end as label from folded""")
def _(spark, d):
    raw = F.concat("o_orderstatus", F.lit("/"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("Head  office"))
    return read(spark, d, "orders").select("o_orderkey", T.canonicalize(
        raw, {"F/": "Filled", "O/": "Open"}, [("Head +office", "Head Office")]).alias("label"))


@query("parse_marked_names", f"""with raw as (select c_custkey, {sql_clean('''case c_custkey % 4 when 0 then concat('*', c_name)
    when 1 then concat('(*applies to ', c_mktsegment, ')') when 2 then concat('* ', c_name, ' ') else c_name end''')} as s from customer)
  select c_custkey, case when regexp_matches(s, '^\\(\\*(.+?)\\)$') then null when starts_with(s, '*') then trim(substr(s, 2)) else s end as name,
    starts_with(s, '*') and not regexp_matches(s, '^\\(\\*(.+?)\\)$') as flagged,
    case when regexp_matches(s, '^\\(\\*(.+?)\\)$') then trim(regexp_extract(s, '^\\(\\*(.+?)\\)$', 1)) end as note from raw""")
def _(spark, d):
    m, name = F.col("c_custkey") % 4, F.col("c_name")
    raw = (F.when(m == 0, F.concat(F.lit("*"), name)).when(m == 1, F.concat(F.lit("(*applies to "), "c_mktsegment", F.lit(")")))
           .when(m == 2, F.concat(F.lit("* "), name, F.lit(" "))).otherwise(name))
    return read(spark, d, "customer").select("c_custkey", T.parse_marked(raw).alias("m")).select("c_custkey", "m.*")


@query("split_section_header", """with raw as (select n_nationkey, concat(case r_regionkey when 0 then 'I. ' when 1 then 'IV. ' when 2 then 'XII. '
    when 3 then '' else 'v. ' end, r_name, ' ', n_name) as s from nation join region on n_regionkey = r_regionkey)
  select n_nationkey, nullif(regexp_extract(s, '^([IVX]+)\\.\\s+(.+)$', 1), '') as section_id,
    nullif(regexp_extract(s, '^([IVX]+)\\.\\s+(.+)$', 2), '') as title from raw""")
def _(spark, d):
    mark = (F.when(F.col("r_regionkey") == 0, "I. ").when(F.col("r_regionkey") == 1, "IV. ")
            .when(F.col("r_regionkey") == 2, "XII. ").when(F.col("r_regionkey") == 3, "").otherwise("v. "))
    rows = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", T.split_section(F.concat(mark, "r_name", F.lit(" "), "n_name")).alias("s")).select(
        "n_nationkey", "s.*")


@query("numbering_level", f"""with {SHEET_SQL} select table_id, row_idx, cast(case when regexp_matches(c4, '^\\d+\\.') then 0
  when regexp_matches(c4, '^[a-z]\\.') then 1 when regexp_matches(c4, '^\\d+\\)') then 2 else -1 end as integer) as level from sheet where c4 is not null""")
def _(spark, d):
    return sheet(spark, d).filter("c4 is not null").select("table_id", "row_idx", T.level_of(F.col("c4")).alias("level"))


@query("normalized_headers", f"with {LINES_SQL} select table_id, row_idx, lower(coalesce(c1, '')) as header from lines")
def _(spark, d):
    return lines(spark, d).select("table_id", "row_idx", T.norm_header(F.col("c1")).alias("header"))


@query("word_sets", """select doc_id, cast(len(w) as integer) as n_words, array_to_string(list_sort(w), ' ') as words
  from (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) as w from documents)""")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", T.word_set(F.col("text")).alias("w")).select(
        "doc_id", F.size("w").alias("n_words"), F.array_join(F.array_sort("w"), " ").alias("words"))


@query("estimated_tokens", "select doc_id, cast(length(text) // 4 as bigint) as tokens from documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", T.est_tokens(F.col("text")).alias("tokens"))


# ---- predicates ------------------------------------------------------------------

@query("blank_row_test", f"with {LINES_SQL} select table_id, row_idx, {sql_blank('c0')} and {sql_blank('c1')} as blank from lines")
def _(spark, d):
    return lines(spark, d).select("table_id", "row_idx", T.is_blank([F.col("c0"), F.col("c1")]).alias("blank"))


@query("cell_types", """with raw as (select event_id, case event_id % 9 when 0 then 'TRUE' when 1 then cast(user_id as varchar)
    when 2 then concat('00', cast(user_id as varchar)) when 3 then cast(cast(value * 100 as bigint) / 100.0 as varchar)
    when 4 then '2024-02-0' || cast(1 + user_id % 9 as varchar) when 5 then '' when 6 then null when 7 then event_type
    else '1e' || cast(user_id % 9 as varchar) end as cell from events)
  select event_id, case when cell is null then null when lower(cell) in ('true', 'false') then 'bool'
    when regexp_matches(cell, '^[+-]?(0|[1-9][0-9]*)$') then 'int'
    when regexp_matches(cell, '^[0-9]{4}-') and try_cast(cell as date) is not null then 'date'
    when regexp_matches(cell, '^[+-]?0[0-9]') then 'str' when try_cast(cell as double) is not null then 'float' else 'str' end as tag from raw""")
def _(spark, d):
    m, u = F.col("event_id") % 9, F.col("user_id")
    cents = F.concat(F.call_function("div", (F.col("value") * 100).cast("bigint"), F.lit(100)).cast("string"), F.lit(".5"))
    cell = (F.when(m == 0, "TRUE").when(m == 1, u.cast("string")).when(m == 2, F.concat(F.lit("00"), u.cast("string")))
            .when(m == 3, cents).when(m == 4, F.concat(F.lit("2024-02-0"), (1 + u % 9).cast("string"))).when(m == 5, "")
            .when(m == 7, F.col("event_type")).when(m == 8, F.concat(F.lit("1e"), (u % 9).cast("string"))))
    return read(spark, d, "events").select("event_id", T.cell_type(cell).alias("tag"))


@query("placeholder_test", f"""with {MESSY_SQL} select c_custkey, {sql_clean('v')} is null or {sql_clean('v')} in {LISTED} as placeholder from messy""")
def _(spark, d):
    return messy(spark, d).select("c_custkey", T.is_placeholder(F.col("v")).alias("placeholder"))


@query("drop_placeholder_items", f"with {SHEET_SQL} select table_id, row_idx, c5 as item from sheet where {sql_clean('c5')} not in {LISTED}")
def _(spark, d):
    return sheet(spark, d).filter(~T.is_placeholder(F.col("c5"))).select("table_id", "row_idx", F.col("c5").alias("item"))


@query("label_and_heading_test", f"""with {SHEET_SQL}, items as (select table_id, row_idx, case when row_idx % 11 = 0 then concat('(', c4, ')') else c4 end as t from sheet)
  select table_id, row_idx, coalesce(regexp_matches(t, '^(\\d+\\.|[a-z]\\.|[A-Z]\\.|\\d+\\))'), false) as numbered,
    coalesce(t <> '' and not regexp_matches(t, '^(\\d+\\.|[a-z]\\.|[A-Z]\\.|\\d+\\))') and not starts_with(t, '('), false) as heading from items""")
def _(spark, d):
    t = F.when(F.col("row_idx") % 11 == 0, F.concat(F.lit("("), "c4", F.lit(")"))).otherwise(F.col("c4"))
    return sheet(spark, d).select("table_id", "row_idx", T.is_numbered(t).alias("numbered"), T.is_heading(t).alias("heading"))
