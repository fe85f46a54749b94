"""Text-store jobs over the documents."""
from __future__ import annotations

from pyspark.sql import functions as F

from sheetloom.operators import corpus as C

from . import query
from .fixtures import read

_STORE = """concat('## [', lang, '] ', source, chr(10), replace(text, concat('.', chr(10)), concat('.', chr(10), case when doc_id % 2 = 0 then '## [note]  more' else '## [note]' end, chr(10))))"""
_ENTRIES_SQL = f"""store as (select doc_id, {_STORE} as t from documents),
ls as (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as pos from store),
seg as (select *, count(*) filter (where regexp_matches(line, '^##\\s*\\[(\\w+)\\]')) over (partition by doc_id order by pos) as entry_no from ls),
ent as (select doc_id, entry_no, lower(regexp_extract(min(line) filter (where line like '## [%'), '^##\\s*\\[(\\w+)\\]\\s*(.*)', 1)) as tag,
  trim(regexp_extract(arg_min(line, pos), '^##\\s*\\[(\\w+)\\]\\s*(.*)', 2)) as title,
  rtrim(coalesce(string_agg(line, chr(10) order by pos) filter (where not regexp_matches(line, '^##\\s*\\[(\\w+)\\]')), ''), chr(10)) as body
  from seg where entry_no > 0 group by doc_id, entry_no)"""


def entries(spark, d):
    return C.split_entries(read(spark, d, "documents").select("doc_id", F.expr(_STORE).alias("text")))


@query("split_entries", f"with {_ENTRIES_SQL} select * from ent")
def _(spark, d):
    return entries(spark, d).withColumn("body", F.rtrim("body", F.lit("\n")))


@query("entries_by_tag", f"with {_ENTRIES_SQL} select doc_id, entry_no, tag, title from ent where tag in ('en', 'fr')")
def _(spark, d):
    return C.by_tag(entries(spark, d), ["EN", "fr"]).drop("body")


@query("nearest_entry", """with w as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) as a from documents),
  b as (select item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) as b from benchmark),
  s as (select doc_id, item_id, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) as score from w, b),
  r as (select *, row_number() over (partition by doc_id order by score desc, item_id) as n from s)
  select doc_id, case when score > 0 then item_id end as nearest, round(coalesce(score, 0), 6) as similarity, coalesce(score, 0) >= 0.4 as overlaps from r where n = 1""")
def _(spark, d):
    out = C.nearest(read(spark, d, "documents"), read(spark, d, "benchmark"))
    return out.withColumn("similarity", F.round("similarity", 6))


# markers that occur in pages, in the shape of the shipped ones
PAGE_MARKERS = (("relative link", r"href=\"/[A-Za-z]+"), ("domain", r"\b[a-z]+\.example\.(?:com|net|org)\b"), ("entity", r"&[a-z]+;"))


@query("scan_markers", " union all ".join(
    f"select page_id, cast('{label}' as varchar) as label, unnest(regexp_extract_all(html, '{p}')) as matched from pages" for label, p in PAGE_MARKERS))
def _(spark, d):
    return C.scan_markers(read(spark, d, "pages"), ["page_id"], "html", PAGE_MARKERS)


_NOTED = "concat('See column B and cols. C in table-', cast(20240000 + doc_id as {t}), ' or report-', cast(doc_id as {t}), '.csv. ', text)"


@query("scan_default_markers", "with t as (select doc_id, " + _NOTED.format(t="varchar") + " as txt from documents) " + " union all ".join(
    f"select doc_id, cast('{label}' as varchar) as label, unnest(regexp_extract_all(txt, '{p}')) as matched from t" for label, p in C.MARKERS))
def _(spark, d):
    return C.scan_markers(read(spark, d, "documents").select("doc_id", F.expr(_NOTED.format(t="string")).alias("text")))


@query("token_budget", """select lang, source, count(*) as n_texts, cast(sum(length(text)) as bigint) as chars, cast(sum(length(text) // 4) as bigint) as tokens
  from documents group by rollup (lang, source)""")
def _(spark, d):
    return C.token_budget(read(spark, d, "documents"), ["lang", "source"])
