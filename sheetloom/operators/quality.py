"""Data-quality scan of nested documents."""
from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, WORD, _strip
from ..sources.rules import MAX_SAMPLES, merge_checks
from .validate import path_order

SEVERITY_ORDER = ("error", "warn", "info")   # fixed values, most severe first
MIXED = "empty strings and nulls both occur; use one of them"


# ---- checks on one text value ------------------------------------------------

def has_bad_whitespace(v: Column) -> Column:
    return v.rlike(f"^{SPACE}|{SPACE}$|{SPACE}{{2,}}|\t")


def has_broken_hyphen(v: Column) -> Column:
    return v.rlike(f"{WORD}-{SPACE}+{WORD}")


def is_placeholder_value(v: Column, tokens: Sequence[str]) -> Column:
    return _strip(v).isin(*tokens)


def ends_in_conjunction(v: Column, words: Sequence[str]) -> Column:
    return v.rlike(f"(?iu){SPACE}+(?:{'|'.join(re.escape(w) for w in words)}){SPACE}*$")


def is_numeric_string(v: Column) -> Column:
    return _strip(v).rlike(r"^\p{Nd}+([.,]\p{Nd}+)?$")


def text_checks(v: Column, checks: Mapping[str, Mapping]) -> dict[str, Column]:
    """Predicates of the enabled checks that look at one value; a check that names a
    SQL ``predicate`` over ``value`` runs it."""
    made: dict[str, Column] = {}
    for name, cfg in checks.items():
        if not cfg.get("enabled", False):
            continue
        if name == "whitespace":
            made[name] = has_bad_whitespace(v)
        elif name == "broken_hyphenation":
            made[name] = has_broken_hyphen(v)
        elif name == "placeholder_values" and cfg.get("tokens"):
            made[name] = is_placeholder_value(v, cfg["tokens"])
        elif name == "trailing_conjunction" and cfg.get("words"):
            made[name] = ends_in_conjunction(v, cfg["words"])
        elif name == "numeric_string":
            made[name] = is_numeric_string(v)
        elif "predicate" in cfg:
            made[name] = F.expr(cfg["predicate"])
    return made


def scan_text(df: DataFrame, keep: Sequence[str], value: str, checks: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Findings of all text checks in one narrow pass; usable on streams as well."""
    made = text_checks(F.col("value"), merge_checks() if checks is None else checks)
    rows = df.select(*keep, F.col(value).alias("value")).filter(F.col("value").isNotNull())
    hits = F.array_compact(F.array(*[F.when(hit, name) for name, hit in made.items()]))
    return rows.select(*keep, F.explode_outer(hits).alias("category"), "value").filter(F.col("category").isNotNull())


# ---- checks on arrays and whole documents -------------------------------------

_FINDING = "array<struct<path:string,category:string,value:string>>"


def _repeats() -> Column:
    """Second and later equal items of an array node, as findings.

    A hash test finds the arrays that repeat anything; their items are then sorted
    with their positions, and an item equal to its neighbour is a repeat.
    """
    return F.expr("""if(kind = 'array' and size(array_distinct(_items)) < size(_items),
      transform(filter(zip_with(_sorted, slice(_sorted, 2, size(_sorted)), (a, b) -> if(a.item = b.item, b, null)), x -> x is not null),
        x -> named_struct('path', concat(path, '/', x.pos), 'category', 'duplicate_array_items', 'value',
          case when left(x.item, 1) in ('{', '[') then '(complex item)'
               when left(x.item, 1) = '"' then cast(try_parse_json(x.item) as string) else x.item end)), null)""")


def _with_items(tree: DataFrame) -> DataFrame:
    texts = "if(kind = 'array', transform(try_cast(v as array<variant>), x -> coalesce(to_json(x), 'null')), null)"
    placed = "array_sort(transform(_items, (x, i) -> named_struct('item', x, 'pos', i)))"
    return tree.selectExpr("*", f"{texts} as _items").selectExpr("*", f"{placed} as _sorted")


def duplicate_items(tree: DataFrame, ids: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Second and later equal items of one array; objects compare by sorted keys.

    An array is part of one document value, so this stays inside the row.
    """
    return _with_items(tree.filter(F.col("kind") == "array")).select(*ids, F.inline_outer(_repeats())).filter(
        F.col("category").isNotNull())


def _mixed() -> Column:
    finding = F.struct(F.lit("(global)").alias("path"), F.lit("empty_vs_null").alias("category"), F.lit(MIXED).alias("value"))
    return F.when((F.col("path") == "") & F.col("mixed"), F.array(finding))


def empty_vs_null(tree: DataFrame, ids: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Documents in which both the empty string and null occur."""
    return tree.filter(F.col("path") == "").select(*ids, F.inline_outer(_mixed())).filter(F.col("category").isNotNull())


def dq_scan(tree: DataFrame, checks: Mapping[str, Mapping] | None = None,
            ids: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Findings ``(ids, path, category, value)`` of all enabled checks.

    One narrow pass over the nodes: nothing is shuffled.
    """
    checks = merge_checks() if checks is None else checks
    rows = tree.withColumn("value", F.when(F.col("kind") == "string", F.col("v").cast("string")))
    hits = [F.when(hit, F.struct("path", F.lit(name).alias("category"), "value"))
             for name, hit in text_checks(F.col("value"), checks).items()]
    none = F.array().cast(_FINDING)
    parts = [F.when(F.col("value").isNotNull(), F.array_compact(F.array(*hits)))] if hits else []
    if checks.get("duplicate_array_items", {}).get("enabled", False):
        rows = _with_items(rows)
        parts.append(_repeats())
    if checks.get("empty_vs_null", {}).get("enabled", False):
        parts.append(_mixed())
    found = F.inline_outer(F.concat(none, *[F.coalesce(p, none) for p in parts]))
    return rows.select(*ids, found).filter(F.col("category").isNotNull())


def dq_custom(df: DataFrame, predicates: Mapping[str, str], keep: Sequence[str], value: str) -> DataFrame:
    """Findings of checks given as SQL predicates over ``value``."""
    return scan_text(df, keep, value, {n: {"enabled": True, "predicate": p} for n, p in predicates.items()})


# ---- summaries ------------------------------------------------------------------

def _severity(checks: Mapping[str, Mapping]) -> Column:
    pairs = [x for n, c in checks.items() for x in (F.lit(n), F.lit(c.get("severity", "info")))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col("category")), F.lit("info"))


def severity_rank(severity: Column) -> Column:
    out = F.lit(len(SEVERITY_ORDER))
    for i, name in reversed(list(enumerate(SEVERITY_ORDER))):
        out = F.when(severity == name, i).otherwise(out)
    return out


def dq_summary(findings: DataFrame, checks: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Findings per category with severity."""
    counted = findings.groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    return counted.select("category", _severity(merge_checks() if checks is None else checks).alias("severity"), "count")


def summary_order() -> tuple[Column, ...]:
    """Most severe first, then most frequent."""
    return severity_rank(F.col("severity")), F.desc("count"), F.col("category")


def order_summary(summary: DataFrame) -> DataFrame:
    return summary.orderBy(*summary_order())


def dq_samples(findings: DataFrame, n: int = MAX_SAMPLES, ids: Sequence[str] = ("doc_id",)) -> DataFrame:
    """First findings of each category; every task keeps at most ``n`` per category."""
    first = Window.partitionBy("category").orderBy(*ids, path_order(F.col("path")))
    return (findings.withColumn("rank", F.row_number().over(first).cast("bigint")).filter(F.col("rank") <= n)
            .withColumn("value", F.left(F.col("value"), F.lit(120))))


def diff_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """Finding counts of two runs side by side."""
    def counts(df, name):
        return df.groupBy("category").agg(F.count(F.lit(1)).alias(name))
    zero = F.lit(0).cast("bigint")
    both = counts(before, "before").join(counts(after, "after"), "category", "full")
    both = both.select("category", F.coalesce("before", zero).alias("before"), F.coalesce("after", zero).alias("after"))
    return both.withColumn("change", F.col("after") - F.col("before"))
