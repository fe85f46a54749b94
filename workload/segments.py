"""Entries, groups, tiers, nested lists and documents built from sheets."""
from __future__ import annotations

from pyspark.sql import functions as F

from sheetloom.functions import text as T
from sheetloom.operators import nest as N
from sheetloom.operators import segment as S
from sheetloom.plans.convert import Level, SheetSpec, convert, lineage
from sheetloom.sources.grid import to_cells

from . import query
from .fixtures import SHEET_SQL, build_sheet, read, sheet

C = F.col
_W = "(partition by table_id order by row_idx)"
ENT_SQL = f"""{SHEET_SQL},
ent as (select *, count(c0) over {_W} as entry_id from sheet)"""


def boundary():
    return C("c0").isNotNull()


def section():
    return boundary() & (C("c0").cast("bigint") % 10 == 0)


def entries(spark, d):
    return S.segment(sheet(spark, d), boundary())


@query("segment_entries", f"""with {ENT_SQL} select table_id, row_idx, entry_id,
  coalesce(min(row_idx) filter (where c0 is not null) over (partition by table_id, entry_id), 1) as entry_start, cast(0 as bigint) as part from ent""")
def _(spark, d):
    return entries(spark, d).select("table_id", "row_idx", "entry_id", "entry_start", "part")


_LEVELS_SQL = f"""{SHEET_SQL},
marked as (select *, coalesce(c0 is not null and cast(c0 as bigint) % 10 = 0, false) as is_section from sheet),
lev as (select *, count(*) filter (where is_section) over {_W} as section_id, count(*) filter (where c0 is not null and not is_section) over {_W} as e,
  case when is_section then 'section' when c0 is not null then 'entry' else 'continuation' end as row_kind from marked),
opened as (select *, count(*) filter (where row_kind = 'entry') over (partition by table_id, section_id order by row_idx) > 0 as open from lev)"""


@query("segment_two_levels", f"with {_LEVELS_SQL} select table_id, row_idx, section_id, case when open then e else 0 end as entry_id, row_kind from opened")
def _(spark, d):
    return S.segment_levels(sheet(spark, d), section(), boundary()).select("table_id", "row_idx", "section_id", "entry_id", "row_kind")


@query("carry_forward", f"""with {ENT_SQL} select table_id, row_idx,
  last_value(c1 ignore nulls) over (partition by table_id, entry_id order by row_idx) as c1,
  last_value(c3 ignore nulls) over (partition by table_id, entry_id order by row_idx) as c3 from ent""")
def _(spark, d):
    return S.carry_forward(sheet(spark, d), boundary(), ["c1", "c3"]).select("table_id", "row_idx", "c1", "c3")


_CHANGE_SQL = f"""{ENT_SQL},
prev as (select *, last_value(c2 ignore nulls) over (partition by table_id, entry_id order by row_idx rows between unbounded preceding and 1 preceding) as p from ent),
chg as (select *, c0 is not null or (c2 is not null and c2 is distinct from p) as opens from prev),
grp as (select *, count(*) filter (where opens) over {_W} as group_id from chg)"""


@query("subgroup_on_change", f"""with {_CHANGE_SQL} select table_id, row_idx, group_id, opens,
  max(case when opens then c2 end) over (partition by table_id, group_id) as group_key,
  min(case when opens then row_idx end) over (partition by table_id, group_id) as group_start from grp""")
def _(spark, d):
    return S.subgroup_on_change(sheet(spark, d), boundary(), C("c2")).select(
        "table_id", "row_idx", "group_id", "opens", "group_key", "group_start")


_KEYED_SQL = f"""{ENT_SQL},
keyed as (select *, last_value(c3 ignore nulls) over (partition by table_id, entry_id order by row_idx) as group_key from ent)"""


@query("subgroup_by_key", f"""with {_KEYED_SQL} select table_id, entry_id, group_key, min(row_idx) as first_row, count(*) as n_rows
  from keyed where group_key is not null group by all""")
def _(spark, d):
    return S.keyed_groups(S.subgroup_by_key(entries(spark, d), boundary(), C("c3")), ["table_id", "entry_id"])


@query("subgroup_triggered", f"""with {ENT_SQL},
  keyed as (select *, last_value(case when c0 is not null or c2 is not null or c3 in ('F') then c3 end ignore nulls) over (partition by table_id, entry_id order by row_idx) as group_key from ent)
  select table_id, row_idx, group_key from keyed""")
def _(spark, d):
    free = boundary() | C("c2").isNotNull()
    return S.subgroup_by_key(sheet(spark, d), boundary(), C("c3"), triggers=["F"], free=free).select("table_id", "row_idx", "group_key")


@query("first_value_of_group", f"""with {ENT_SQL} select table_id, entry_id, arg_min(c3, row_idx) filter (where c3 is not null) as c3,
  arg_min(c4, row_idx) filter (where c4 is not null) as c4 from ent group by all""")
def _(spark, d):
    return S.first_value_of(entries(spark, d), ["table_id", "entry_id"], ["c3", "c4"])


@query("collect_ordered_distinct", f"""with {ENT_SQL}, firsts as (select table_id, entry_id, c4, min(row_idx) as r from ent where c4 is not null group by all)
  select table_id, entry_id, cast(0 as bigint) as part, string_agg(c4, '|' order by r) as items from firsts group by all""")
def _(spark, d):
    out = S.collect_ordered(entries(spark, d), ["table_id", "entry_id"], C("c4"), distinct=True)
    return out.withColumn("items", F.array_join("items", "|"))


@query("collect_ordered_all", f"""with {ENT_SQL} select table_id, entry_id, cast(0 as bigint) as part, string_agg(c4, '|' order by row_idx) as items
  from ent where c4 is not null group by all""")
def _(spark, d):
    return S.collect_ordered(entries(spark, d), ["table_id", "entry_id"], C("c4")).withColumn("items", F.array_join("items", "|"))


@query("collect_ordered_in_parts", f"""with {ENT_SQL}, st as (select *, min(row_idx) over (partition by table_id, entry_id) as s from ent)
  select table_id, entry_id, (row_idx - s) // 3 as part, string_agg(c4, '|' order by row_idx) as items from st where c4 is not null group by all""")
def _(spark, d):
    out = S.collect_ordered(entries(spark, d), ["table_id", "entry_id"], C("c4"), part_rows=3)
    return out.withColumn("items", F.array_join("items", "|"))


_TIER_TEXT = "case when c4 like 'part %' and row_idx % 4 = 0 then concat('Scope ', c4) when c4 like 'part %' then concat('(', c4, ')') else c4 end"
_AUTH = "case when row_idx % 7 = 0 then c3 end"


@query("split_tiers", f"""with {ENT_SQL}, t as (select *, {_TIER_TEXT} as txt, {_AUTH} as auth from ent),
  f as (select *, coalesce(txt <> '' and not regexp_matches(txt, '^(\\d+\\.|[a-z]\\.|[A-Z]\\.|\\d+\\))') and not starts_with(txt, '('), false) as heading from t),
  o as (select *, c0 is not null or heading or auth is not null as opens from f),
  n as (select *, count(*) filter (where opens) over {_W} as tier_id from o)
  select table_id, row_idx, tier_id, heading as consumed, max(case when opens and heading then txt end) over (partition by table_id, tier_id) as tier_label,
    min(case when opens then row_idx end) over (partition by table_id, tier_id) as tier_start from n""")
def _(spark, d):
    return S.split_tiers(sheet(spark, d), boundary(), F.expr(_TIER_TEXT), F.expr(_AUTH)).select(
        "table_id", "row_idx", "tier_id", "consumed", "tier_label", "tier_start")


_NAME = "case when row_idx % 5 = 0 then '(*note)' when row_idx % 5 = 1 then concat(c4, ')') when row_idx % 5 = 2 then null else replace(c4, ' ', case when row_idx % 2 = 0 then '' else ' ' end) end"


@query("join_split_name", f"""with {ENT_SQL}, named as (select *, {_NAME} as name from ent),
  nxt as (select *, lead(name) over {_W} as rest, lead(c0) over {_W} is not null as next_starts, lead(row_idx) over {_W} is not null as has_next from named)
  select table_id, row_idx, case when len(string_split(trim(name), ' ')) = 1 and not ends_with(name, ')') and has_next and not next_starts and rest is not null
      and not regexp_matches(rest, '^\\(\\*(.+?)\\)$') then concat(name, ' ', rest) else name end as full_name from nxt where c0 is not null""")
def _(spark, d):
    return S.join_split_name(sheet(spark, d), boundary(), F.expr(_NAME)).filter(boundary()).select("table_id", "row_idx", "full_name")


# ---- conservation --------------------------------------------------------------------------

_BLANK = "c0 is null and c1 is null and c2 is null and c3 is null and c4 is null and c5 is null"


@query("row_conservation", f"""with {_LEVELS_SQL}, k as (select *, not ({_BLANK}) as live from opened)
  select table_id, count(*) as all_rows, count(*) filter (where not live) as blank_rows, count(*) filter (where live) as rows_seen,
    count(*) filter (where live and row_kind = 'entry') as entry_rows, count(*) filter (where live and row_kind = 'section') as section_rows,
    count(*) filter (where live and row_kind = 'continuation' and open) as continuation_rows,
    count(*) filter (where live and row_kind = 'continuation' and not open) as unassigned_rows from k group by table_id""")
def _(spark, d):
    blank = T.is_blank([C(f"c{i}") for i in range(6)])
    return S.conservation(S.segment_levels(sheet(spark, d), section(), boundary()), boundary(), blank, section())


@query("unmapped_cells", f"""with {SHEET_SQL}, cells as ({' union all '.join(f"select table_id, row_idx, cast({i} as integer) as col_idx, 'c{i}' as header, c{i} as value from sheet" for i in range(6))})
  select table_id, row_idx, col_idx, header, value from cells where value is not null and not (col_idx in (0, 2, 4) or (col_idx = 3 and row_idx % 2 = 0))""")
def _(spark, d):
    cells = to_cells(sheet(spark, d)).drop("cell_type")
    emitted = cells.filter(C("col_idx").isin(0, 2, 4) | ((C("col_idx") == 3) & (C("row_idx") % 2 == 0)))
    return S.unmapped_cells(cells, emitted.select("table_id", "row_idx", "col_idx"))


@query("hierarchy_counts", f"""with {_CHANGE_SQL} select table_id, count(*) as rows_seen, count(distinct case when entry_id > 0 then entry_id end) as entries,
  count(distinct group_id) as groups, count(distinct case when c3 is not null then (group_id, c3) end) as subgroups from grp group by table_id""")
def _(spark, d):
    rows = S.segment(S.subgroup_on_change(sheet(spark, d), boundary(), C("c2")), boundary())
    rows = rows.withColumn("entry_id", F.when(C("entry_id") > 0, C("entry_id")))
    return S.hierarchy_counts(rows, {"entries": ["entry_id"], "groups": ["group_id"], "subgroups": ["group_id", "c3"]})


# ---- nesting -----------------------------------------------------------------------------------

ITEMS_SQL = f"""{ENT_SQL},
items as (select table_id, entry_id, row_idx, c4 as text, case when regexp_matches(c4, '^\\d+\\.') then 0 when regexp_matches(c4, '^[a-z]\\.') then 1
  when regexp_matches(c4, '^\\d+\\)') then 2 else -1 end as level from ent where c4 is not null)"""
_BEFORE = "(partition by table_id, entry_id order by row_idx rows between unbounded preceding and 1 preceding)"


def _nest_sql(orphan: str) -> str:
    """Parent of level k: the last earlier item of a lower level (in its group)."""
    seg = f"count(*) filter (where level = -1) over (partition by table_id, entry_id order by row_idx)" if orphan == "group" else "0"
    w = "(partition by table_id, entry_id, seg order by row_idx rows between unbounded preceding and 1 preceding)"
    low = {k: f"max(case when level between 0 and {k - 1} then row_idx end) over {w}" for k in (1, 2)}
    numbered = f"max(case when level >= 0 then row_idx end) over {w}"
    head = f"max(case when level = -1 then row_idx end) over {w}" if orphan == "group" else "null"
    orphan_parent = numbered if orphan == "attach" else "null"
    return f"""{ITEMS_SQL}, seg as (select *, {seg} as seg from items),
par as (select table_id, entry_id, row_idx, text, cast(level as bigint) as level, case level when -1 then {orphan_parent} when 0 then {head}
  when 1 then coalesce({low[1]}, {head}) else coalesce({low[2]}, {head}) end as parent from seg)"""


def _nested(spark, d, orphan):
    return N.nest(entries(spark, d), ["table_id"], "row_idx", C("c4"), orphan=orphan, list_col="entry_id")


def _register_nest(orphan):
    @query(f"nest_orphans_{orphan}", f"with {_nest_sql(orphan)} select table_id, entry_id, row_idx, text, level, parent from par")
    def _(spark, d):
        return _nested(spark, d, orphan).drop("depth", "path")


for _orphan in ("attach", "group", "root"):
    _register_nest(_orphan)


@query("nested_tree_text", f"""with recursive {_nest_sql('attach')},
  walk as (select table_id, entry_id, row_idx, parent, text, 0 as depth from par where parent is null
    union all select p.table_id, p.entry_id, p.row_idx, p.parent, p.text, w.depth + 1 from par p join walk w
      on p.table_id = w.table_id and p.parent = w.row_idx),
  nxt as (select *, lead(depth) over (partition by table_id, entry_id order by row_idx) as nd from walk),
  piece as (select *, concat('{{"text":"', text, '"', case when coalesce(nd, 0) > depth then ',"sub":[' else concat('}}', repeat(']}}', cast(depth - coalesce(nd, 0) as bigint)),
    case when nd is null then '' else ',' end) end) as p from nxt)
  select table_id, entry_id, cast(0 as bigint) as part, count(*) as n_items, concat('[', string_agg(p, '' order by row_idx), ']') as tree from piece group by table_id, entry_id""")
def _(spark, d):
    rows = S.segment(sheet(spark, d), boundary())
    nested = N.nest(rows, ["table_id"], "row_idx", C("c4"), list_col="entry_id")
    starts = rows.select("table_id", "row_idx", "entry_start")
    return N.assemble_tree(nested.join(starts, ["table_id", "row_idx"]), ["table_id", "entry_id"], "row_idx", start="entry_start")


# ---- documents -----------------------------------------------------------------------------------

def spec() -> SheetSpec:
    return SheetSpec(boundary=boundary(), header={"no": C("c0"), "status": C("c1")}, group=C("c2"),
                     lists={"items": C("c4"), "quantities": C("c5")})


@query("assemble_documents", f"""with {_CHANGE_SQL},
  g as (select table_id, entry_id, group_id, max(case when opens then c2 end) as group_key, min(row_idx) as at_row,
    coalesce(string_agg(c4, '|' order by row_idx) filter (where c4 is not null), '') as items,
    coalesce(string_agg(c5, '|' order by row_idx) filter (where c5 is not null and c5 <> '-'), '') as quantities
    from grp where not ({_BLANK}) group by all),
  h as (select table_id, entry_id, max(c0) as "no", max(c1) as status from grp where c0 is not null group by all)
  select table_id, entry_id, cast(0 as bigint) as part, any_value("no") as "no", any_value(status) as status,
    string_agg(concat(group_key, '[', items, '][', quantities, ']'), ';' order by at_row) as groups, count(*) as n_groups
  from g join h using (table_id, entry_id) group by all""")
def _(spark, d):
    out = convert(sheet(spark, d), spec())
    shown = F.transform("groups", lambda g: F.concat(g["group_key"], F.lit("["), F.array_join(g["items"], "|"), F.lit("]["),
                                                     F.array_join(g["quantities"], "|"), F.lit("]")))
    return out.select("table_id", "entry_id", "part", "no", "status", F.array_join(shown, ";").alias("groups"),
                      F.size("groups").cast("bigint").alias("n_groups"))


@query("sheet_to_entries", f"""with {SHEET_SQL}, s as (select table_id, cast(o_orderkey as varchar) as "no", o_orderstatus as status, l_quantity, l_linenumber
    from sheet_first where sep = 0)
  select table_id, "no", any_value(status) as status, count(*) as n_items, cast(coalesce(sum(case when l_linenumber % 5 <> 0 then cast(l_quantity as bigint) end), 0) as bigint) as quantity
  from s group by table_id, "no" """)
def flagship(spark, d):
    """A sheet built from orders and lines, taken apart again and counted per entry."""
    out = convert(build_sheet(spark, d), spec())
    total = F.aggregate(F.flatten(F.transform("groups", lambda g: g["quantities"])), F.lit(0).cast("bigint"),
                        lambda a, q: a + q.cast("bigint"))
    n = F.aggregate("groups", F.lit(0).cast("bigint"), lambda a, g: a + F.size(g["items"]))
    # a very long entry comes in several parts
    return out.groupBy("table_id", "no").agg(
        F.first("status").alias("status"), F.sum(n).alias("n_items"), F.sum(total).alias("quantity"))


@query("dedupe_arrays", """with recursive v as (select conv_id, turn, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) as i from conversations),
  f as (select conv_id, turn, w, min(i) as i from v group by all)
  select conv_id, turn, string_agg(w, ' ' order by i) as words from f group by all""")
def _(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(S.dedupe(F.split("text", " ")), " ").alias("words"))


# ---- documents with levels: flags that open on change, states that re-open by key -----------------

def level_spec() -> SheetSpec:
    return SheetSpec(boundary=boundary(), header={"no": C("c0"), "status": C("c1")}, lists={}, levels=[
        Level("flags", key=C("c2"), key_name="flag"),
        Level("states", key=C("c3"), keyed=True, triggers=["F"], free=C("c2").isNotNull(), key_name="state",
              distinct={"quantities": C("c5")}, lists={"items": C("c4")})])


@query("convert_levels", f"""with {_CHANGE_SQL},
  lv as (select *, last_value(case when c3 = 'F' or c2 is not null then c3 end ignore nulls)
      over (partition by table_id, group_id order by row_idx) as state from grp where entry_id > 0 and not ({_BLANK})),
  it as (select table_id, entry_id, group_id, state, min(row_idx) as at_row,
      coalesce(string_agg(c4, '|' order by row_idx) filter (where c4 is not null), '') as items from lv where state is not null group by all),
  qs as (select table_id, entry_id, group_id, state, c5, min(row_idx) as first_at from lv
      where state is not null and c5 is not null and c5 <> '-' group by all),
  qd as (select table_id, entry_id, group_id, state, string_agg(c5, '|' order by first_at) as quantities from qs group by all),
  st as (select it.*, coalesce(qd.quantities, '') as quantities from it left join qd using (table_id, entry_id, group_id, state)),
  fl as (select table_id, entry_id, group_id, max(case when opens then c2 end) as flag, min(row_idx) as at_row
      from grp where entry_id > 0 and not ({_BLANK}) group by all),
  fs as (select fl.table_id, fl.entry_id, fl.flag, fl.at_row, count(st.state) as n_states,
      coalesce(string_agg(st.state || '[' || st.items || '][' || st.quantities || ']', ',' order by st.at_row), '') as states
      from fl left join st using (table_id, entry_id, group_id) group by all),
  h as (select table_id, entry_id, min_by(c0, row_idx) filter (where c0 is not null) as "no",
      min_by(c1, row_idx) filter (where c1 is not null) as status from grp where entry_id > 0 group by all)
  select table_id, entry_id, cast(0 as bigint) as part, any_value(h."no") as "no", any_value(h.status) as status,
    string_agg(coalesce(flag, '') || '{{' || states || '}}', ';' order by at_row) as flags,
    cast(count(*) as bigint) as n_flags, cast(sum(n_states) as bigint) as n_states
  from fs join h using (table_id, entry_id) group by table_id, entry_id""")
def _(spark, d):
    out = convert(sheet(spark, d), level_spec())
    states = lambda f: F.array_join(F.transform(f["states"], lambda s: F.concat(
        s["state"], F.lit("["), F.array_join(s["items"], "|"), F.lit("]["), F.array_join(s["quantities"], "|"), F.lit("]"))), ",")
    flags = F.transform("flags", lambda f: F.concat(F.coalesce(f["flag"], F.lit("")), F.lit("{"), states(f), F.lit("}")))
    return out.select("table_id", "entry_id", "part", "no", "status", F.array_join(flags, ";").alias("flags"),
                      F.size("flags").cast("bigint").alias("n_flags"),
                      F.aggregate("flags", F.lit(0).cast("bigint"), lambda a, f: a + F.size(f["states"])).alias("n_states"))


@query("unmapped_by_levels", f"""with {_CHANGE_SQL},
  lv as (select *, last_value(case when c3 = 'F' or c2 is not null then c3 end ignore nulls)
      over (partition by table_id, group_id order by row_idx) as state,
      max(case when opens then c2 end) over (partition by table_id, group_id) as flag,
      min_by(c0, row_idx) filter (where c0 is not null) over (partition by table_id, entry_id) as first_no,
      min_by(c1, row_idx) filter (where c1 is not null) over (partition by table_id, entry_id) as first_status
    from grp where entry_id > 0 and not ({_BLANK})),
  held as (select table_id, row_idx, 0 as col_idx from lv where c0 = first_no
    union all select table_id, row_idx, 1 from lv where c1 = first_status
    union all select table_id, row_idx, 2 from lv where c2 = flag
    union all select table_id, row_idx, 3 from lv where c3 = state
    union all select table_id, row_idx, 4 from lv where state is not null and c4 is not null
    union all select table_id, row_idx, 5 from lv where state is not null and c5 is not null and c5 <> '-'),
  cells as (select table_id, row_idx, unnest([0, 1, 2, 3, 4, 5]) as col_idx, unnest([c0, c1, c2, c3, c4, c5]) as value from sheet)
  select table_id, col_idx, count(*) as n_unmapped from cells c
  where value is not null and trim(value) <> '' and not exists (select 1 from held h where h.table_id = c.table_id and h.row_idx = c.row_idx and h.col_idx = c.col_idx)
  group by all""")
def _(spark, d):
    grid = sheet(spark, d)
    lost = S.unmapped_cells(to_cells(grid), lineage(grid, level_spec()))
    return lost.groupBy("table_id", F.col("col_idx").cast("int").alias("col_idx")).agg(F.count(F.lit(1)).alias("n_unmapped"))
