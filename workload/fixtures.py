"""Inputs derived from the given tables, on Spark and as SQL text side by side.

The tables are clean, so dirt, sheets, numbered lists and JSON documents are
derived from whole tables and whole texts by the same expressions.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.functions.text import SPACE, WORD, ZERO_WIDTH
from sheetloom.operators.ordered import Last, number_rows, running
from sheetloom.operators.staging import stage
from sheetloom.sources.grid import to_cells, to_grid

NBSP, ZWSP = "\u00a0", "\u200b"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


SPREAD_ROWS = 20_000   # rows of a task


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for row-local work on a table that is one small file, and more,
    shorter tasks where it is large: a file of few bytes may hold many rows.

    A table of many splits has partitions enough and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-df.count() // SPREAD_ROWS))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


# ---- SQL helpers --------------------------------------------------------------

def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_clean(x: str, nullable: bool = True) -> str:
    s = f"trim(regexp_replace(regexp_replace({x}, '[{ZERO_WIDTH}]', '', 'g'), '{SPACE}+', ' ', 'g'), ' ')"
    return f"nullif({s}, '')" if nullable else s


def sql_dehyphenate(x: str) -> str:
    return f"regexp_replace({x}, '({WORD})-{SPACE}+({WORD})', '\\1\\2', 'g')"


def sql_cell(x: str, limit: int) -> str:
    s = f"trim(regexp_replace(regexp_replace(replace({x}, '{NBSP}', ' '), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]|\\p{{Cf}}', '', 'g'), '{SPACE}+', ' ', 'g'), ' ')"
    return f"coalesce(case when length({s}) > {limit} then concat(substr({s}, 1, {limit - 1}), '…') else {s} end, '')"


def sql_blank(x: str) -> str:
    return f"({x} is null or regexp_matches({x}, '^{SPACE}*$'))"


# ---- dirty text -----------------------------------------------------------------

_DIRTY = """concat(case when doc_id % 3 = 0 then '  ' else '' end,
  case when doc_id % 4 = 0 then 'pe-nangkap undang-undang ' when doc_id % 4 = 1 then 'berlari-lari a-b-c ' else '' end,
  replace(text, ' ', case when doc_id % 2 = 0 then '{nbsp} ' else ' ' end),
  case when doc_id % 5 = 0 then '{zwsp} and' else '' end, case when doc_id % 7 = 0 then ' pe- nangkap' else '' end)"""
DIRTY = _DIRTY.format(nbsp=NBSP, zwsp=ZWSP)
DIRTY_SQL = f"dirty as (select doc_id, lang, source, {DIRTY} as t from documents)"


def dirty(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "documents")).select("doc_id", "lang", "source", F.expr(DIRTY).alias("t"))


# ---- placeholder column ------------------------------------------------------------

MESSY = """case c_custkey % 8 when 0 then '-' when 1 then 'N/A' when 2 then '' when 3 then null
  when 4 then ' pad  ' when 5 then '12,5' when 6 then concat('*', c_name) else concat(c_name, ' and') end"""
MESSY_SQL = f"messy as (select c_custkey, c_nationkey, c_name, {MESSY} as v from customer)"


def messy(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_name", F.expr(MESSY).alias("v"))


# ---- denormalized sheets: one per order priority -----------------------------------

_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
         "l_returnflag", "l_linestatus", "l_shipdate"]
SHEET_ORDER = ["o_orderkey", "sep", *_LINE]
_CELLS = {
    "c0": "case when first then cast(o_orderkey as {text}) end",
    "c1": "case when first then o_orderstatus end",
    "c2": "case when first or l_linenumber % 3 = 0 then l_returnflag end",
    "c3": "case when l_linenumber % 2 = 1 then l_linestatus end",
    "c4": """concat(case l_linenumber % 4 when 0 then concat(cast(l_linenumber as {text}), '. ') when 1 then 'a. '
             when 2 then '1) ' else '' end, 'part ', cast(l_partkey % 50 as {text}))""",
    "c5": "case when l_linenumber % 5 <> 0 then cast(cast(l_quantity as bigint) as {text}) else '-' end",
}


def _cells(text: str) -> str:
    return ", ".join(f"case when sep = 0 then {e.format(text=text)} end as {n}" for n, e in _CELLS.items())


SHEET_SQL = f"""sheet_src as (
  select o_orderpriority as table_id, o_orderkey, 0 as sep, o_orderstatus, {', '.join(_LINE)}
  from orders join lineitem on o_orderkey = l_orderkey
  union all
  select o_orderpriority, o_orderkey, s.sep, null, {', '.join('null' for _ in _LINE)}
  from orders, (values (1, 3), (2, 9)) s(sep, every) where o_orderkey % s.every = 0),
sheet_num as (
  select *, row_number() over (partition by table_id order by {', '.join(SHEET_ORDER)}) as row_idx from sheet_src),
sheet_first as (
  select *, sep = 0 and lag(o_orderkey) over (partition by table_id order by row_idx) is distinct from o_orderkey as first
  from sheet_num),
sheet as (select table_id, row_idx, {_cells('varchar')} from sheet_first)"""

_memo: dict[tuple, DataFrame] = {}


def _once(name: str, spark: SparkSession, d: str, build) -> DataFrame:
    """Derived inputs are written once per session, as a sheet that is given would be."""
    key = (name, spark.sparkContext.applicationId, d)
    if key not in _memo:
        _memo[key] = stage(build())
    return _memo[key]


def build_sheet(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = read(spark, d, "orders"), read(spark, d, "lineitem")
    body = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderpriority").alias("table_id"), "o_orderkey", F.lit(0).alias("sep"), "o_orderstatus", *_LINE)
    gaps = orders.select(F.col("o_orderpriority").alias("table_id"), "o_orderkey", F.explode(F.expr(
        "case when o_orderkey % 9 = 0 then array(1, 2) when o_orderkey % 3 = 0 then array(1) else array() end")).alias("sep"))
    src = body.unionByName(gaps, allowMissingColumns=True)
    rows = running(number_rows(src, ["table_id"], SHEET_ORDER), ["table_id"], "row_idx",
                   {"_prev": Last(F.col("o_orderkey"), inclusive=False)})
    rows = rows.withColumn("first", (F.col("sep") == 0) & ~F.col("_prev").eqNullSafe(F.col("o_orderkey")))
    cells = [F.expr(f"case when sep = 0 then {e.format(text='string')} end").alias(n) for n, e in _CELLS.items()]
    return rows.select("table_id", "row_idx", *cells)


def sheet(spark: SparkSession, d: str) -> DataFrame:
    return _once("sheet", spark, d, lambda: build_sheet(spark, d))


# ---- sheets of text lines: every document is a small table -----------------------------

_LINES = "replace(replace(text, concat('.', chr(10)), concat('.', chr(10), chr(10), chr(10))), '. ', concat('.', chr(10), chr(10)))"
LINES_SQL = f"""line_src as (
  select doc_id, unnest(string_split({_LINES}, chr(10))) as line,
         generate_subscripts(string_split({_LINES}, chr(10)), 1) as row_idx from documents),
lines as (
  select cast(doc_id as varchar) as table_id, cast(row_idx as bigint) as row_idx, line as c0,
         case when contains(line, ',') then substr(line, strpos(line, ',') + 1) end as c1 from line_src)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    split = read(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("table_id"), F.posexplode_outer(F.split(F.expr(_LINES), "\n")).alias("pos", "c0"))
    rest = F.when(F.contains("c0", F.lit(",")), F.expr("substr(c0, instr(c0, ',') + 1)"))
    return split.select("table_id", (F.col("pos") + 1).cast("bigint").alias("row_idx"), "c0", rest.alias("c1"))


# ---- typed tables as long cells ----------------------------------------------------------

TYPED = {
    "customer": [("c_custkey", "int"), ("c_name", "str"), ("c_nationkey", "int"), ("c_acctbal", "float"), ("c_mktsegment", "str")],
    "part": [("p_partkey", "int"), ("p_name", "str"), ("p_brand", "str"), ("p_type", "str"), ("p_size", "int"),
             ("p_retailprice", "float")],
    "orders": [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "str"), ("o_totalprice", "float"),
               ("o_orderdate", "date"), ("o_orderpriority", "str")],
    "lineitem": [("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"),
                 ("l_quantity", "float"), ("l_extendedprice", "float"), ("l_discount", "float"), ("l_tax", "float"),
                 ("l_returnflag", "str"), ("l_linestatus", "str"), ("l_shipdate", "date")],
}


def _typed_sql() -> str:
    grids, cells = [], []
    for t, cols in TYPED.items():
        names = ", ".join(c for c, _ in cols)
        grids.append(f"grid_{t} as (select row_number() over (order by {names}) as row_idx, * from {t})")
        cells += [f"select '{t}' as table_id, row_idx, {i} as col_idx, '{c}' as header, cast({c} as varchar) as value, "
                  f"'{k}' as cell_type from grid_{t}" for i, (c, k) in enumerate(cols)]
    return ",\n".join(grids) + ",\ncells as (" + " union all ".join(cells) + ")"


TYPED_SQL = _typed_sql()


def typed_grid(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = read(spark, d, name)
    return to_grid(df, F.lit(name), df.columns)


def typed_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the numbered tables: those are written once, the cells are made where they are read."""
    key = ("typed_cells", spark.sparkContext.applicationId, d)
    if key not in _memo:
        parts = [to_cells(typed_grid(spark, d, t), apart=True) for t in TYPED]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        _memo[key] = out
    return _memo[key]


# ---- JSON documents: one per event ----------------------------------------------------------

EVENT_JSON = """concat('{"id":', cast(event_id as {text}), ',"type":"', event_type, '","note":',
  case event_id % 6 when 0 then '" padded "' when 1 then '"N/A"' when 2 then '""' when 3 then 'null' when 4 then '"12,5"'
    else concat('"', event_type, ' and"') end,
  ',"tags":[', case event_id % 4 when 0 then '"a","b","a"' when 1 then '' when 2 then '"a"' else '"a",null,"pe- nangkap"' end,
  '],"items":[', case event_id % 3 when 0 then '' when 1 then '{"sub":[{"text":"two"}],"text":"one"}'
    else '{"text":"one"},{"text":"one"}' end,
  '],"props":', case event_id % 10 when 0 then '{"k": "x"}' when 1 then '{"k": 1, "z": 2}' when 2 then '{}' else props end,
  case when event_id % 97 = 5 then '' else '}' end)"""
DOCS_SQL = f"""docs as (select event_id as doc_id, user_id, {EVENT_JSON.replace('{text}', 'varchar')} as text from events),
tree as (
  select doc_id, regexp_replace(replace(replace(t.fullkey, '$', ''), '.', '/'), '\\[(\\d+)\\]', '/\\1', 'g') as path,
         regexp_replace(replace(replace(t.fullkey, '$', ''), '.', '/'), '\\[(\\d+)\\]', '/*', 'g') as rule_path,
         case t.type when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string' when 'NULL' then 'null'
           when 'BOOLEAN' then 'boolean' when 'DOUBLE' then 'number' else 'integer' end as kind,
         case when t.type = 'VARCHAR' then json_extract_string(t.value, '$') when t.type = 'NULL' then null
           else cast(t.value as varchar) end as value,
         t.value as node
  from (select * from docs where json_valid(text)) d, json_tree(d.text) t)"""


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "events")).select(
        F.col("event_id").alias("doc_id"), "user_id", F.expr(EVENT_JSON.replace("{text}", "string")).alias("text"))
