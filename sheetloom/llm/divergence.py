"""Source divergence audit by chunk factorization.

Texts are cut at white space into chunks. A task numbers the chunks of its rows, so that
every distinct chunk is tokenized once and is from then on the numbers of its terms; term
occurrences and the documents that hold a term are counted per (lang, source) on these
numbers, and only the counts are shuffled. From the term counts of each (lang, source)
group and of each lang, smoothed parts per billion are compared term by term.

Nulls: a null text, lang or source is read as ''. A document is a row: repeated rows
count as several documents. An empty table gives no rows; a group whose texts hold no
kept term is still a source of its lang. Other input columns are ignored, whatever
their names. Texts are never cut; a chunk may be as long as its text.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_slices, stage

# fixed values of the contract: the term pattern, the smoothing and the report sizes
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10

#: Bytes of a text outside terms become spaces, and A-Z lower-cased; UTF-8 beyond ASCII is part of a term.
_TERM_BYTES = bytes(ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if chr(b) in LOWER or b > 127 else 32 for b in range(256))
#: Distinct chunk forms, and bytes of text, that a task holds before it hands its counts over.
BROADCAST_FORMS = 400_000
BROADCAST_CHARS = 8_000_000
#: Tasks over which the pairs of one lang's sources are dealt.
PAIR_SPLIT = 16
#: So many (lang, source) groups may reach every task, a row each; tables of terms and vectors never do.
BROADCAST_GROUPS = 100_000


def _ppb(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 kept)), exact: the quotient is at most SCALE."""
    num = (count + 2).cast("decimal(38,0)") * F.lit(SCALE).cast("decimal(38,0)")
    den = (total + 2 * kept).cast("decimal(38,0)")
    return (F.lit(1) + F.call_function("div", num, den)).cast("long")


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are at most SCALE + 1, so longs hold it."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _shuffled(df: DataFrame) -> DataFrame:
    """The table, joined by a shuffle however small Spark takes it to be."""
    return df.hint("merge")


class _Numbers(dict):
    """Numbers of keys in the order in which they are first met."""

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        return n


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, count, n_docs of every stretch of rows that a task holds at once."""
    chunks, groups = _Numbers(), _Numbers()
    held: list = []                     # chunk numbers of each row, with the number of its group
    size = 0

    def done() -> pa.RecordBatch:
        terms = _Numbers()
        found = [[terms[t] for t in chunk.translate(_TERM_BYTES).split()] for chunk in chunks]        # each chunk once
        many = np.array([len(f) for f in found], np.int64)
        begin = np.cumsum(many) - many
        flat = np.array([t for f in found for t in f], np.int64)
        of = np.concatenate([c for c, _ in held])
        row = np.repeat(np.arange(len(held)), [len(c) for c, _ in held])
        n = many[of]
        term = flat[np.repeat(begin[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        # occurrences by row and term, then by group and term
        key, count = np.unique(np.repeat(row, n) * max(len(terms), 1) + term, return_counts=True)
        row, term = np.divmod(key, max(len(terms), 1))
        key, to = np.unique(np.array([g for _, g in held])[row] * max(len(terms), 1) + term, return_inverse=True)
        group, term = np.divmod(key, max(len(terms), 1))
        names, words = list(groups), pa.array(list(terms), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([
            pa.array([x for x, _ in names], pa.string()).take(pa.array(group)), pa.array([x for _, x in names], pa.string()).take(pa.array(group)),
            words.take(pa.array(term)), pa.array(np.bincount(to, count, len(key)).astype(np.int64)), pa.array(np.bincount(to, minlength=len(key)))],
            names=["lang", "source", "term", "count", "n_docs"])

    for batch in in_slices(batches):
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            own = text.encode().split()
            held.append((np.fromiter(map(chunks.__getitem__, own), np.int64, len(own)), groups[lang, source]))
            size += len(text)
            if len(chunks) > BROADCAST_FORMS or size > BROADCAST_CHARS:
                yield done()
                chunks, groups, held, size = _Numbers(), _Numbers(), [], 0
    if held:
        yield done()


def term_counts(docs: DataFrame, text: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, count) of the terms that at least ``least_docs`` documents of their lang hold.

    Tasks hand over the counts of ``BROADCAST_FORMS`` chunk forms or ``BROADCAST_CHARS``
    characters of text at a time; they are summed after one shuffle by (lang, term).
    """
    d = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
                    F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
                    F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    counted = (d.mapInArrow(_count_terms, "lang string, source string, term string, count long, n_docs long").repartition("lang", "term")
               .groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("n_docs").alias("n_docs")))
    held = F.sum("n_docs").over(Window.partitionBy("lang", "term"))
    return counted.withColumn("held", held).where(F.col("held") >= least_docs).select("lang", "source", "term", "count")


def audit(docs: DataFrame, text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how each source departs from the others and from its lang.

    Each lang keeps the V terms found in at least ``least_docs`` of its documents. For
    every (lang, source) group and every lang, p(term) = 1 + floor(SCALE (count + 2) /
    (N + 2 V)), N the group's occurrences of kept terms; f = floor((p - q)^2 / (p + q)).
    Part ``pair``: one row for each other source of the lang, value the sum of f over
    all kept terms with q the other source's p (0 when V = 0). Part ``term``: kept terms
    that the group holds with p above the lang's q, value f, the first ``top`` only.
    Ranks start at 1 per group and part: value descending, item ascending in UTF-8
    byte order. Only (lang, source) groups give rows; the lang's p is the q of ``term``.
    """
    counts = stage(term_counts(docs, text, least_docs))
    groups = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
                         F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).distinct()
    kept = counts.select("lang", "term").distinct()
    width = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    sizes = stage(groups.join(counts.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left")
                  .join(width, "lang", "left")
                  .select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")))
    # Spark sizes tables by their files, whose bytes say little of terms, and of vectors before they are
    # repeated; so the side to send is named here, and the sides that grow are never sent through the driver
    sent = F.broadcast if sizes.count() <= BROADCAST_GROUPS else _shuffled
    group_p = (counts.join(sent(sizes), ["lang", "source"])
               .select("lang", "source", "term", _ppb(F.col("count"), F.col("n"), F.col("v")).alias("p")))
    lang_counts = counts.groupBy("lang", "term").agg(F.sum("count").alias("count"))
    lang_p = (lang_counts.join(sent(lang_counts.groupBy("lang").agg(F.sum("count").alias("n"))), "lang").join(sent(width), "lang")
              .select("lang", "term", _ppb(F.col("count"), F.col("n"), F.col("v")).alias("q")))

    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    term_part = (group_p.join(_shuffled(lang_p), ["lang", "term"]).where(F.col("p") > F.col("q"))
                 .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
                 .withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top))

    # dense vectors over the lang's kept terms in term order; a term the group lacks has count 0. The
    # (group, term) table is made on (lang, bucket of the term's place), so that one lang is spread
    index = kept.select("lang", "term", (F.row_number().over(Window.partitionBy("lang").orderBy("term")) - 1).cast("int").alias("i"))
    index = index.withColumn("_b", F.pmod(F.col("i"), F.lit(PAIR_SPLIT)))
    spread = sizes.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(PAIR_SPLIT - 1))))
    zero = _ppb(F.lit(0).cast("long"), F.col("n"), F.col("v"))
    dense = (spread.join(_shuffled(index), ["lang", "_b"]).join(_shuffled(group_p), ["lang", "source", "term"], "left")
             .select("lang", "source", "i", F.coalesce("p", zero).alias("p")))
    vectors = stage(sizes.select("lang", "source").join(
        _shuffled(dense.groupBy("lang", "source").agg(F.array_sort(F.collect_list(F.struct("i", "p"))).alias("_v"))), ["lang", "source"], "left")
        .select("lang", "source", F.coalesce(F.transform("_v", lambda x: x["p"]), F.array().cast("array<long>")).alias("vec")))
    left = vectors.withColumn("_b", F.pmod(F.xxhash64("source"), F.lit(PAIR_SPLIT)).cast("int"))
    right = vectors.select("lang", F.col("source").alias("item"), F.col("vec").alias("other"),
                           F.explode(F.sequence(F.lit(0), F.lit(PAIR_SPLIT - 1))).alias("_b"))
    pair_part = (left.join(_shuffled(right), ["lang", "_b"]).where(F.col("source") != F.col("item"))
                 .select("lang", "source", F.lit("pair").alias("part"), "item",
                         F.aggregate(F.zip_with("vec", "other", _gap), F.lit(0).cast("long"), lambda a, x: a + x).alias("value"))
                 .withColumn("rank", F.row_number().over(by_value)))
    return pair_part.unionByName(term_part).select("lang", "source", "part", "item", F.col("value").cast("long"), F.col("rank").cast("int"))
