"""JSON documents: walking, validating, scanning."""
from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from sheetloom.operators import nodes as ND
from sheetloom.operators import quality as Q
from sheetloom.operators import validate as V
from sheetloom.operators.staging import shared_dir, stage
from sheetloom.plans.check import check
from sheetloom.sources import documents as D
from sheetloom.sources import rules as R

from . import query
from .fixtures import (DIRTY_SQL, DOCS_SQL, MESSY_SQL, SHEET_SQL, SPACE, WORD, dirty, docs, messy, read, sheet, sql_strip)
from .segments import spec

SCHEMA = {
    "$schema": "https://json-schema.org/draft/2020-12/schema",
    "type": "object", "required": ["id", "type", "props"], "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 10},
        "type": {"enum": ["click", "purchase", "view", "signup"]},
        "note": {"type": ["string", "null"], "minLength": 1},
        "tags": {"type": "array", "minItems": 1, "items": {"type": "string", "pattern": "^[a-z]$"}},
        "items": {"type": "array", "items": {"$ref": "#/$defs/Item"}},
        "props": {"type": "object", "required": ["k"], "additionalProperties": False,
                  "properties": {"k": {"type": "integer", "minimum": 5}}},
    },
    "$defs": {"Item": {"type": "object", "required": ["text"], "additionalProperties": False,
                       "properties": {"text": {"type": "string", "const": "one"},
                                      "sub": {"type": "array", "items": {"$ref": "#/$defs/Item"}}}}},
}


def parsed(spark, d):
    return D.parse_documents(docs(spark, d))


def tree(spark, d):
    return ND.nodes(parsed(spark, d))


# ---- reading and writing ---------------------------------------------------------------

@query("read_json_documents", f"""with {DOCS_SQL} select doc_id, json_valid(text) as readable,
  case when json_valid(text) then json_extract_string(text, '$.type') end as type, case when json_valid(text) then try_cast(json_extract_string(text, '$.props.k') as bigint) end as k from docs""")
def _(spark, d):
    return parsed(spark, d).select("doc_id", F.col("doc").isNotNull().alias("readable"),
                                   F.expr("try_variant_get(doc, '$.type', 'string')").alias("type"),
                                   F.expr("try_variant_get(doc, '$.props.k', 'bigint')").alias("k"))


@query("write_json_documents", f"""with {SHEET_SQL} select table_id, count(*) as n_docs from sheet where c0 is not null group by table_id""")
def _(spark, d):
    from sheetloom.plans.convert import convert
    path = f"{shared_dir(spark)}/sheetloom/docs-{uuid.uuid4().hex}"
    nested = convert(sheet(spark, d), spec())
    D.write_documents(nested.select(F.struct(*nested.columns).alias("doc")), path)
    back = spark.read.text(path).select(F.try_parse_json("value").alias("doc"))
    return back.select(F.expr("variant_get(doc, '$.table_id', 'string')").alias("table_id"),
                       F.expr("variant_get(doc, '$.part', 'bigint')").alias("part")).filter("part = 0").groupBy("table_id").agg(
        F.count(F.lit(1)).alias("n_docs"))


@query("merged_check_rules", """with o as (select cast(l_linestatus as varchar) as check_name, cast(l_returnflag as varchar) as param, cast(min(l_tax) as varchar) as value from lineitem group by all),
    dft as (select o_orderstatus as check_name, case when o_custkey % 2 = 0 then 'A' else 'N' end as param, cast(min(o_custkey) as varchar) as value from orders group by all)
  select coalesce(o.check_name, dft.check_name) as check_name, coalesce(o.param, dft.param) as param, coalesce(o.value, dft.value) as value
  from dft full join o on dft.check_name = o.check_name and dft.param = o.param""")
def _(spark, d):
    over = read(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("check_name"), F.col("l_returnflag").alias("param")).agg(
        F.min("l_tax").cast("string").alias("value"))
    dft = read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("check_name"), F.when(
        F.col("o_custkey") % 2 == 0, "A").otherwise("N").alias("param")).agg(F.min("o_custkey").cast("string").alias("value"))
    return R.merge_rule_tables(dft, over)


# ---- walking -------------------------------------------------------------------------------

@query("json_leaves", f"with {DOCS_SQL} select doc_id, path, rule_path, kind, value from tree where kind not in ('object', 'array')")
def _(spark, d):
    return ND.leaves(tree(spark, d))


@query("json_array_items", f"""with {DOCS_SQL} select doc_id, regexp_replace(path, '/\\d+$', '') as array_path, cast(regexp_extract(path, '\\d+$') as bigint) as pos,
  path, kind, cast(node as varchar) as item from tree where regexp_matches(path, '/(tags|items|sub)/\\d+$')""")
def _(spark, d):
    return ND.array_items(tree(spark, d))


@query("json_array_sizes", f"""with {DOCS_SQL} select doc_id, substr(path, 2) as name, cast(json_array_length(node) as bigint) as size from tree
  where kind = 'array' and regexp_matches(path, '^/[a-z]+$')""")
def _(spark, d):
    return ND.array_counts(parsed(spark, d))


_TURN = """concat('{"id":', cast(conv_id as {t}), ',"note":"', role, '","props":{"k":', cast(turn as {t}), ',"turn":true}}')"""


@query("field_drift", f"""with {DOCS_SQL}, a as (select distinct rule_path from tree where path <> ''),
  turns as (select {_TURN.replace('{t}', 'varchar')} as text from conversations),
  b as (select distinct replace(replace(t.fullkey, '$', ''), '.', '/') as rule_path from turns, json_tree(turns.text) t where t.fullkey <> '$')
  select coalesce(a.rule_path, b.rule_path) as rule_path, case when a.rule_path is not null and b.rule_path is not null then 'shared' when a.rule_path is not null then 'new' else 'missing' end as state
  from a full join b on a.rule_path = b.rule_path""")
def _(spark, d):
    turns = read(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"),
                                                   F.expr(_TURN.replace("{t}", "string")).alias("text"))
    return ND.field_drift(tree(spark, d), ND.nodes(D.parse_documents(turns)))


# ---- validation --------------------------------------------------------------------------------

_ITEM = "regexp_matches(rule_path, '^/items/\\*(/sub/\\*)*$')"
_TEXT = "regexp_matches(rule_path, '^/items/\\*(/sub/\\*)*/text$')"
_ERR = {
    "type": """select doc_id, path, 'type' as keyword, case rule_path when '/tags/*' then 'string' else 'integer' end as arg, kind as actual from tree
      where (rule_path = '/props/k' and kind <> 'integer') or (rule_path = '/tags/*' and kind <> 'string')""",
    "fields": """select doc_id, path, 'required' as keyword, 'k' as arg, cast(null as varchar) as actual from tree where rule_path = '/props' and not list_contains(json_keys(node), 'k')
      union all select doc_id, path, 'additionalProperties', 'k', 'z' from tree where rule_path = '/props' and list_contains(json_keys(node), 'z')""",
    "enum": f"""select doc_id, path, 'enum' as keyword, '"click","purchase","view","signup"' as arg, cast(node as varchar) as actual from tree
      where rule_path = '/type' and value not in ('click', 'purchase', 'view', 'signup')
      union all select doc_id, path, 'enum', '"one"', cast(node as varchar) from tree where {_TEXT} and value <> 'one'""",
    "limits": """select doc_id, path, 'minimum' as keyword, '10.0' as arg, value as actual from tree where rule_path = '/id' and cast(value as bigint) < 10
      union all select doc_id, path, 'minimum', '5.0', value from tree where rule_path = '/props/k' and kind = 'integer' and try_cast(value as bigint) < 5
      union all select doc_id, path, 'minLength', '1', cast(length(value) as varchar) from tree where rule_path = '/note' and kind = 'string' and length(value) < 1
      union all select doc_id, path, 'minItems', '1', cast(json_array_length(node) as varchar) from tree where rule_path = '/tags' and json_array_length(node) < 1
      union all select doc_id, path, 'pattern', '^[a-z]$', value from tree where rule_path = '/tags/*' and kind = 'string' and not regexp_matches(value, '^[a-z]$')""",
}
ERRORS_SQL = f"{DOCS_SQL}, errors as ({' union all '.join(_ERR.values())})"


def errors(spark, d, keywords=None):
    return V.validate(tree(spark, d), SCHEMA, keywords=keywords)


def _register_errors(name, part, keywords):
    @query(name, f"with {DOCS_SQL} {_ERR[part]}")
    def _(spark, d):
        return errors(spark, d, keywords)


_register_errors("expect_type", "type", ["type"])
_register_errors("expect_fields", "fields", ["required", "additionalProperties"])
_register_errors("expect_enum", "enum", ["enum"])
_register_errors("expect_limits", "limits", ["minimum", "minLength", "minItems", "pattern"])


@query("validate_documents", f"with {ERRORS_SQL} select * from errors")
def _(spark, d):
    return errors(spark, d)


@query("document_validity", f"""with {ERRORS_SQL}, n as (select doc_id, count(*) as n from errors group by doc_id)
  select docs.doc_id, json_valid(text) as readable, json_valid(text) and n is null as valid, coalesce(n, 0) as error_count from docs left join n using (doc_id)""")
def _(spark, d):
    return V.validity(parsed(spark, d), errors(spark, d))


@query("top_errors", f"""with {ERRORS_SQL}, r as (select *, row_number() over (partition by doc_id order by path, keyword, arg) as rank, count(*) over (partition by doc_id) as n from errors)
  select doc_id, path, keyword, arg, actual, rank, greatest(n - 2, 0) as overflow from r where rank <= 2""")
def _(spark, d):
    return V.top_errors(errors(spark, d), 2)


def _schemas(spark, d):
    """A schema document per part: its fields depend on the part."""
    text = F.expr("""concat('{"properties":{"', p_brand, '":{"type":"string"},"list":{"items":{"properties":{"', p_type,
      '":{"const":"properties"}}}}},"$defs":{"D', cast(p_size as string), '":{"properties":{"name":{}}}}}')""")
    return D.parse_documents(read(spark, d, "part").select(F.col("p_partkey").alias("schema_id"), text.alias("text")))


@query("schema_fields", """select p_partkey as schema_id, unnest(['field', 'field', 'field', 'field', 'definition']) as kind,
  unnest([p_brand, 'list', p_type, 'name', concat('D', p_size)]) as name from part""")
def _(spark, d):
    return V.schema_fields(ND.nodes(_schemas(spark, d), ids=["schema_id"]), ids=["schema_id"])


@query("infer_schema", f"""with {DOCS_SQL}, up as (select *, regexp_replace(rule_path, '/[^/]*$', '') as up from tree),
  objs as (select rule_path as up, count(*) as parents from tree where kind = 'object' group by all)
  select u.rule_path, string_agg(distinct kind, '|' order by kind) as types, count(*) as n, count(*) = coalesce(any_value(parents), 0) as required,
    cast(min(case when kind = 'string' then length(value) end) as integer) as min_length, min(case when kind in ('integer', 'number') then try_cast(value as double) end) as minimum,
    cast(min(case when kind = 'array' then json_array_length(node) end) as bigint) as min_items,
    case when count(distinct case when kind = 'string' then value end) between 1 and 15 then string_agg(distinct case when kind = 'string' then value end, '|' order by case when kind = 'string' then value end) end as enum
  from up u left join objs on objs.up = u.up group by u.rule_path, u.up""")
def _(spark, d):
    out = V.infer_schema(tree(spark, d))
    return out.withColumn("types", F.array_join("types", "|")).withColumn("enum", F.array_join("enum", "|"))


# ---- data-quality checks on text columns -----------------------------------------------------------

_LISTED = "('-', '–', '—', 'N/A', 'n/a', 'null', 'NULL')"


def _is(v):
    """SQL form of the checks on one value."""
    return {"whitespace": f"regexp_matches({v}, '^{SPACE}|{SPACE}$|{SPACE}{{2,}}|\t')",
            "broken_hyphenation": f"regexp_matches({v}, '{WORD}-{SPACE}+{WORD}')",
            "trailing_conjunction": f"regexp_matches({v}, '(?i){SPACE}+(?:dan|atau|and|or){SPACE}*$')",
            "placeholder_values": f"{sql_strip(v)} in {_LISTED}",
            "numeric_string": f"regexp_matches({sql_strip(v)}, '^\\p{{Nd}}+([.,]\\p{{Nd}}+)?$')"}


@query("dq_whitespace", f"with {DIRTY_SQL} select doc_id, {_is('t')['whitespace']} as hit from dirty")
def _(spark, d):
    return dirty(spark, d).select("doc_id", Q.has_bad_whitespace(F.col("t")).alias("hit"))


@query("dq_broken_hyphenation", f"with {DIRTY_SQL} select doc_id, {_is('t')['broken_hyphenation']} as hit from dirty")
def _(spark, d):
    return dirty(spark, d).select("doc_id", Q.has_broken_hyphen(F.col("t")).alias("hit"))


@query("dq_placeholder_values", f"with {MESSY_SQL} select c_custkey, {_is('v')['placeholder_values']} as hit from messy")
def _(spark, d):
    return messy(spark, d).select("c_custkey", Q.is_placeholder_value(F.col("v"), R.DEFAULT_CHECKS["placeholder_values"]["tokens"]).alias("hit"))


@query("dq_trailing_conjunction", f"with {DIRTY_SQL} select doc_id, {_is('t')['trailing_conjunction']} as hit from dirty")
def _(spark, d):
    return dirty(spark, d).select("doc_id", Q.ends_in_conjunction(F.col("t"), R.DEFAULT_CHECKS["trailing_conjunction"]["words"]).alias("hit"))


@query("dq_numeric_string", f"with {MESSY_SQL} select c_custkey, {_is('v')['numeric_string']} as hit from messy")
def _(spark, d):
    return messy(spark, d).select("c_custkey", Q.is_numeric_string(F.col("v")).alias("hit"))


_DUP_SQL = """dup as (select doc_id, path, 'duplicate_array_items' as category, case when kind in ('object', 'array') then '(complex item)' else value end as value from (
  select *, row_number() over (partition by doc_id, regexp_replace(path, '/\\d+$', ''), cast(node as varchar) order by cast(regexp_extract(path, '\\d+$') as bigint)) as n
  from tree where regexp_matches(path, '/\\d+$')) where n > 1)"""
_MIX_SQL = """mix as (select doc_id, '(global)' as path, 'empty_vs_null' as category, 'empty strings and nulls both occur; use one of them' as value from tree
  group by doc_id having bool_or(kind = 'null') and bool_or(kind = 'string' and value = ''))"""
_FOUND_SQL = f"""{DOCS_SQL}, {_DUP_SQL}, {_MIX_SQL}, found as (
  {' union all '.join(f"select doc_id, path, '{n}' as category, value from tree where kind = 'string' and {p}" for n, p in _is('value').items())}
  union all select * from dup union all select * from mix)"""


@query("dq_duplicate_items", f"with {DOCS_SQL}, {_DUP_SQL} select * from dup")
def _(spark, d):
    return Q.duplicate_items(tree(spark, d))


def mixed_docs(spark, d):
    """Documents with an empty string and a null: one per customer."""
    text = F.expr("""concat('{"a":', case when c_custkey % 2 = 0 then '""' else '"x"' end, ',"b":[', case when c_custkey % 3 = 0 then 'null' else '1' end, ']}')""")
    return D.parse_documents(read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text")))


@query("dq_empty_vs_null", """select c_custkey as doc_id, '(global)' as path, 'empty_vs_null' as category, 'empty strings and nulls both occur; use one of them' as value
  from customer where c_custkey % 2 = 0 and c_custkey % 3 = 0""")
def _(spark, d):
    return Q.empty_vs_null(ND.nodes(mixed_docs(spark, d)))


@query("dq_scan", f"with {_FOUND_SQL} select * from found")
def _(spark, d):
    return Q.dq_scan(tree(spark, d))


_SEV = "case when category in ('whitespace', 'placeholder_values', 'duplicate_array_items') then 'warn' else 'info' end"


@query("dq_summary", f"with {_FOUND_SQL} select category, {_SEV} as severity, count(*) as count from found group by category")
def _(spark, d):
    return Q.dq_summary(Q.dq_scan(tree(spark, d)))


@query("dq_summary_ordered", f"""with {_FOUND_SQL} select category, {_SEV} as severity, count(*) as count,
  row_number() over (order by case {_SEV} when 'error' then 0 when 'warn' then 1 else 2 end, count(*) desc, category) as place from found group by category""")
def _(spark, d):
    # the ordered summary is one row per check; its order becomes a column to compare
    summary = Q.dq_summary(Q.dq_scan(tree(spark, d)))
    place = F.row_number().over(Window.orderBy(*Q.summary_order()))   # a row per check
    return Q.order_summary(summary.withColumn("place", place.cast("bigint")))


@query("dq_samples", f"""with {_FOUND_SQL}, r as (select *, row_number() over (partition by category order by doc_id, path) as rank from found)
  select doc_id, path, category, left(value, 120) as value, rank from r where rank <= 5""")
def _(spark, d):
    return Q.dq_samples(Q.dq_scan(tree(spark, d)))


@query("dq_custom_checks", f"""with {DIRTY_SQL} select doc_id, 'shouting' as category, t as value from dirty where t = upper(t) union all
  select doc_id, 'long_text', t from dirty where length(t) > 2000 union all select doc_id, 'has_digit', t from dirty where regexp_matches(t, '[0-9]')""")
def _(spark, d):
    return Q.dq_custom(dirty(spark, d), {"shouting": "value = upper(value)", "long_text": "length(value) > 2000",
                                         "has_digit": "value rlike '[0-9]'"}, ["doc_id"], "t")


def _scan_sql(run, table):
    return " union all ".join(f"select '{run}' as run, '{n}' as category from {table} where {p}" for n, p in _is("v").items())


@query("diff_findings", f"""with {DIRTY_SQL}, a as (select t as v from dirty), b as (select trim(regexp_replace(t, '{SPACE}+', ' ', 'g'), ' ') as v from dirty),
  f as ({_scan_sql('before', 'a')} union all {_scan_sql('after', 'b')})
  select category, count(*) filter (where run = 'before') as before, count(*) filter (where run = 'after') as after,
    count(*) filter (where run = 'after') - count(*) filter (where run = 'before') as change from f group by category""")
def _(spark, d):
    before = dirty(spark, d)
    after = before.withColumn("t", F.trim(F.regexp_replace("t", f"{SPACE}+", " ")))
    return Q.diff_findings(Q.scan_text(before, ["doc_id"], "t"), Q.scan_text(after, ["doc_id"], "t"))


@query("check_documents", f"""with {ERRORS_SQL}, {_FOUND_SQL[len(DOCS_SQL) + 2:]}, e as (select doc_id, count(*) as n_errors from errors group by all),
  f as (select doc_id, count(*) as n_findings from found group by all)
  select docs.doc_id, json_valid(text) and n_errors is null as valid, coalesce(n_errors, 0) as error_count, coalesce(n_findings, 0) as findings from docs left join e using (doc_id) left join f using (doc_id)""")
def _(spark, d):
    done = check(stage(parsed(spark, d)), SCHEMA)
    found = done.findings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return done.verdicts.join(found, "doc_id", "left").select(
        "doc_id", "valid", "error_count", F.coalesce("n", F.lit(0).cast("bigint")).alias("findings"))
