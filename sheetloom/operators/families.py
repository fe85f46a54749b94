"""Families of tables: matching, conformance and promotion.

``families``: name, canonical_version, canonical_source, vector, n_members.
``members``: name, job_id, added, built_against, vector (and feature columns).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..sources.grid import TABLE
from .blocks import BLOCK_ROWS, BROADCAST_ROWS, fold_blocks
from .fingerprint import VECTOR_SIZE

TOP_MATCHES = 5


def top_matches(tables: DataFrame, families: DataFrame, n: int | None = TOP_MATCHES, key: str = TABLE,
                block_rows: int = BLOCK_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The n best families of every table ``(key, rank, name, score, tier)``; all of them without n."""
    scored = families.filter(F.col("vector").isNotNull())
    payload = F.struct("name", F.col("vector").cast("array<double>").alias("vector"),
                       S.norm(F.col("vector")).alias("norm"))
    own = tables.select(key, F.col("vector").cast("array<double>").alias("vector"))
    own = own.withColumn("norm", S.norm(F.col("vector")))

    def first(ranked: Column) -> Column:
        return ranked if n is None else F.slice(ranked, 1, n)

    def best(items: Column) -> Column:
        score = F.transform(items, lambda f: F.struct(
            (-S.cosine(F.col("vector"), f["vector"], F.col("norm"), f["norm"])).alias("loss"), f["name"].alias("name")))
        return first(F.array_sort(score))

    found, blocks = fold_blocks(own, scored, [key], payload, best, "best", block_rows, broadcast_rows)
    if blocks == 0:
        return found.select(key, F.lit(None).cast("bigint").alias("rank"), F.lit(None).cast("string").alias("name"),
                            F.lit(None).cast("double").alias("score"), S.tier(F.lit(None).cast("double")).alias("tier"))
    if blocks > 1:   # at most n per block and table
        found = found.groupBy(key).agg(first(F.array_sort(F.flatten(F.collect_list("best")))).alias("best"))
    ranked = found.select(key, F.posexplode_outer("best").alias("pos", "m")).filter(F.col("pos").isNotNull())
    score = -F.col("m.loss")
    return ranked.select(key, (F.col("pos") + 1).cast("bigint").alias("rank"), F.col("m.name").alias("name"),
                         score.alias("score"), S.tier(score).alias("tier"))


def match(tables: DataFrame, families: DataFrame, key: str = TABLE) -> DataFrame:
    """Best family and verdict per table; the tier is that of the unrounded score."""
    best = top_matches(tables, families, 1, key)
    return best.select(key, F.col("name").alias("best"), F.round("score", 3).alias("score"),
                       F.col("tier").alias("verdict"))


def centroid(members: DataFrame, by: str = "name", vector: str = "vector", size: int = VECTOR_SIZE) -> DataFrame:
    """Element-wise mean of member vectors, one pre-aggregated pass, no explode.

    A vector of another length than ``size`` is an error.
    """
    fits = F.when(F.size(vector) == size, F.col(vector)).otherwise(
        F.raise_error(F.concat(F.lit(f"vector of another length than {size}: "), F.size(vector).cast("string"))))
    members = members.withColumn(vector, F.when(F.col(vector).isNotNull(), fits))
    means = [F.round(F.avg(F.get(vector, F.lit(i)).cast("double")), 6) for i in range(size)]
    return members.filter(F.col(vector).isNotNull()).groupBy(by).agg(
        F.array(*means).alias("vector"), F.count(F.lit(1)).alias("n_members"))


def canonical(members: DataFrame, families: DataFrame) -> DataFrame:
    """The canonical member of each family, else the member added first."""
    ranked = members.join(families.select("name", "canonical_source"), "name")
    first = F.min_by(F.struct(*members.columns), F.struct(
        F.when(F.col("job_id") == F.col("canonical_source"), 0).otherwise(1), "added", "job_id"))
    return ranked.groupBy("name").agg(first.alias("m")).select("m.*")


def new_members(candidates: DataFrame, members: DataFrame, on: Sequence[str] = ("name", "job_id")) -> DataFrame:
    """Candidates that are not members yet."""
    return candidates.join(members.select(*on), list(on), "left_anti")


def backfill(members: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Fill in missing member vectors from fingerprints ``(job_id, vector)``."""
    stored = fingerprints.select("job_id", F.col("vector").alias("_computed"))
    return members.join(stored, "job_id", "left").select(
        *[c for c in members.columns if c != "vector"], F.coalesce("vector", "_computed").alias("vector"))


def promote(families: DataFrame, members: DataFrame, candidates: DataFrame, mode: str = "add",
            min_score: float | None = None, size: int = VECTOR_SIZE) -> tuple[DataFrame, DataFrame]:
    """New snapshots of families and members after promoting ``candidates``
    ``(name, job_id, added, vector)``.

    A candidate without a family founds it at version 1.  In an existing family it
    becomes a member (``add``), or the new canonical of the next version
    (``evolve``).  With several candidates for one family each ``evolve`` takes one
    version, in (added, job_id) order.  ``min_score`` refuses members too far from
    the centroid.  Known members are left alone.
    """
    if mode not in ("add", "evolve"):
        raise ValueError(f"mode: {mode}")
    fresh = new_members(candidates.dropDuplicates(["name", "job_id"]), members)
    known = families.select("name", F.col("canonical_version").alias("_version"), F.col("vector").alias("_centroid"))
    fresh = fresh.join(known, "name", "left")
    if min_score is not None:
        near = S.cosine(F.col("vector"), F.col("_centroid")) >= min_score
        fresh = fresh.filter(F.col("_centroid").isNull() | near)
    # promotions of one family are few next to its tables; they order by arrival
    turn = F.row_number().over(Window.partitionBy("name").orderBy("added", "job_id"))
    fresh = fresh.withColumn("_turn", turn)
    base = F.coalesce("_version", F.lit(1))
    steps = (F.when(F.col("_version").isNull(), F.col("_turn") - 1).otherwise(F.col("_turn"))
             if mode == "evolve" else F.lit(0))
    fresh = fresh.withColumn("built_against", (base + steps).cast("bigint"))
    joined = fresh.select("name", "job_id", "added", "built_against", "vector")
    all_members = members.select(*joined.columns).unionByName(joined)

    latest = fresh.groupBy("name").agg(
        F.max("built_against").alias("_v"), F.max_by("job_id", "_turn").alias("_last"),
        F.min_by("job_id", "_turn").alias("_first"))
    means = centroid(all_members, size=size)
    counts = all_members.groupBy("name").agg(F.count(F.lit(1)).alias("n_members"))
    old = families.select("name", "canonical_version", "canonical_source")
    source = (F.coalesce("_last", "canonical_source") if mode == "evolve"
              else F.coalesce("canonical_source", "_first"))
    version = (F.coalesce("_v", "canonical_version") if mode == "evolve"
               else F.coalesce("canonical_version", "_v"))
    all_families = (old.join(latest, "name", "full").join(counts, "name", "left")
                    .join(means.select("name", "vector"), "name", "left")
                    .select("name", version.alias("canonical_version"), source.alias("canonical_source"),
                            "vector", F.coalesce("n_members", F.lit(0).cast("bigint")).alias("n_members")))
    return all_families, all_members


# ---- comparison with a canonical member -----------------------------------------

def header_sets(headers: Column, canonical_headers: Column) -> dict[str, Column]:
    """Matched, new and missing headers; empty headers do not count."""
    a = F.array_distinct(F.filter(headers, lambda h: h != ""))
    b = F.array_distinct(F.filter(canonical_headers, lambda h: h != ""))
    return {"matched": F.array_sort(F.array_intersect(a, b)), "new": F.array_sort(F.array_except(a, b)),
            "missing": F.array_sort(F.array_except(b, a))}


def header_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Long form for header tables ``(header)``: matched, new in ``a``, missing from it."""
    both = (a.select("header").distinct().withColumn("in_a", F.lit(True))
            .join(b.select("header").distinct().withColumn("in_b", F.lit(True)), "header", "full"))
    state = (F.when(F.col("in_a") & F.col("in_b"), "matched").when(F.col("in_a"), "new").otherwise("missing"))
    return both.select("header", state.alias("state"))


def header_tokens(headers: Column) -> Column:
    """Word set of all headers of a table."""
    words = F.regexp_extract_all(F.array_join(headers, " "), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(words)


def header_jaccard(a: Column, b: Column) -> Column:
    return S.jaccard(header_tokens(a), header_tokens(b))


def verdict(cosine: Column, n_new: Column, n_missing: Column) -> Column:
    """Conformance from the rounded cosine and the header differences."""
    return (F.when((cosine >= S.NEAR_DUPLICATE) & (n_new == 0) & (n_missing <= 1), "conforms")
            .when(cosine >= S.SAME_FAMILY, "same-family-with-delta").otherwise("divergent"))


def conformance(tables: DataFrame, canonical_members: DataFrame, on: str = "name") -> DataFrame:
    """Tables ``(table_id, name, headers, vector)`` against their family's canonical
    member ``(name, headers, vector)``."""
    c = canonical_members.select(on, F.col("headers").alias("_h"), F.col("vector").alias("_v"))
    both = tables.join(c, on, "left")
    sets = header_sets(F.coalesce("headers", F.array().cast("array<string>")),
                       F.coalesce("_h", F.array().cast("array<string>")))
    cosine = F.when(F.col("_v").isNotNull(), F.round(S.cosine(F.col("vector"), F.col("_v")), 3))
    out = both.select(TABLE, on, cosine.alias("cosine"), *[x.alias(f"{n}_headers") for n, x in sets.items()])
    return out.withColumn("verdict", verdict(F.col("cosine"), F.size("new_headers"), F.size("missing_headers")))
