"""Phrase collocation mining with Rabin-Karp fingerprints.

Tasks number the words of their texts and count them by text. Every phrase of 2 or 3
frequent words inside a piece gets a 64-bit polynomial fingerprint from prefix sums over
lang-salted word hashes (numpy, per slice of rows); the shuffle aggregates counts per
fingerprint, pre-aggregated in each slice. Only phrases whose fingerprint reaches
``LEAST`` are taken from the texts again: they are told apart by the numbers of their
words, counted in the slice, and materialised as text once a slice, which verifies every
collision. Cuts and containment are then joins of frequent phrases.

Nulls: a null text is empty, a null lang is ``und``. Empty texts and pieces give no
phrases; an empty table gives no rows. Texts are never cut. Input columns other than
the text and ``lang`` are ignored, whatever their names. A document is a row:
repeated rows count again.
"""
from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_slices, stage

# fixed values of the contract: pieces, words, lengths, thresholds and report size
PIECE_CUT = b".,;:!?\x0a\x0b\x0c\x0d"
LEAST = 10
LONGEST = 3
TOP = 2000
SCALE = 1_000_000
UNKNOWN_LANG = "und"

#: Odd bases of the two fingerprints, mod 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Words hashed together (and the last text's), so that a task holds arrays of a bounded length.
SLICE_WORDS = 500_000
#: Distinct words that a task numbers before it starts again.
HELD_WORDS = 300_000
#: Frequent words and fingerprints up to this number (8 bytes each) are sent to every task.
BROADCAST_KEYS = 4_000_000

#: A-Z lower-cased, and every character that cuts pieces as a full stop, which no word holds.
_CUT = b"."
_PIECE_BYTES = bytes(_CUT[0] if b in PIECE_CUT else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The seed of Spark's xxhash64.
_SEED = 42


def _tokens(docs: DataFrame, text: str) -> DataFrame:
    """lang, _text."""
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n + 1, np.uint64)
    out[0] = 1
    if n:
        out[1:] = np.uint64(base)
        np.cumprod(out, out=out)
    return out


def _fingerprints(h: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomials: fp(i, n) = B^(i+n) (Q[i+n] - Q[i]) mod 2^64, Q[k] = sum_{j<k} h[j] B^-(j+1)."""
    inv = pow(base, -1, 1 << 64)
    pw, ipw = _powers(base, len(h)), _powers(inv, len(h))
    q = np.zeros(len(h) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(h * ipw[1:], out=q[1:])
    return pw, q


class _Vocabulary(dict):
    """Numbers of words as bytes, in the order in which they are first met, with their hashes; 0 is the cut."""

    def __init__(self):
        super().__init__({_CUT: 0})
        self.hashes = array("Q", [0])

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.hashes.append(xxhash.xxh64_intdigest(word, _SEED))
        return n


def _slices(batches: Iterator[pa.RecordBatch]):
    """Per slice of rows: langs, words by number, and of each word occurrence its number, lang, lang-salted hash and piece."""
    words = _Vocabulary()
    langs: dict[str, int] = {}
    rows, lang_of, size = [], [], 0

    def done():
        number = np.concatenate(rows)
        doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        cut = number == 0
        keep = ~cut
        piece, number = (np.cumsum(cut) + doc)[keep], number[keep]
        lang = np.array(lang_of)[doc[keep]]
        salts = np.array([xxhash.xxh64_intdigest(x.encode(), _SEED) for x in langs], np.uint64)
        return list(langs), list(words), number, lang, np.array(words.hashes, np.uint64)[number] ^ salts[lang], piece

    for batch in in_slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("_text").cast(pa.binary()).to_pylist()):
            own = text.translate(_PIECE_BYTES).replace(_CUT, b" . ").split()
            rows.append(np.fromiter(map(words.__getitem__, own), np.int64, len(own)))
            lang_of.append(langs.setdefault(lang, len(langs)))
            size += len(own)
            if size > SLICE_WORDS:
                yield done()
                rows, lang_of, size, langs = [], [], 0, {}
                if len(words) > HELD_WORDS:
                    words = _Vocabulary()
    if rows:
        yield done()


def _among(values: np.ndarray, ascending: np.ndarray | None) -> np.ndarray:
    """Which values are among the ascending ones; all without those."""
    if ascending is None:
        return np.ones(len(values), bool)
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def _starts(known: np.ndarray, piece: np.ndarray, n: int) -> np.ndarray:
    """Places where a phrase of n words begins inside one piece, all its words known as frequent."""
    if len(known) < n:
        return np.zeros(0, np.int64)
    ok = piece[: len(known) - n + 1] == piece[n - 1:]
    for j in range(n):
        ok &= known[j: len(known) - n + 1 + j]
    return np.nonzero(ok)[0]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, phrase, count: the words of each lang, counted per slice."""
    for langs, words, number, lang, _h, _piece in _slices(batches):
        key, count = np.unique(lang * len(words) + number, return_counts=True)
        of, at = np.divmod(key, len(words))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(of)),
                                          pa.array(words, pa.binary()).take(pa.array(at)).cast(pa.string()), pa.array(count)], ["lang", "phrase", "count"])


def _counts(batches: Iterator[pa.RecordBatch], frequent: np.ndarray | None, bases: tuple) -> Iterator[pa.RecordBatch]:
    """fp, count: Rabin-Karp fingerprints of the phrases of 2 and 3 frequent words, counted per slice."""
    for _langs, _words, _number, _lang, h, piece in _slices(batches):
        pw, q = _fingerprints(h, bases[0])
        known, out = _among(h, frequent), []
        for n in range(2, LONGEST + 1):
            i = _starts(known, piece, n)
            with np.errstate(over="ignore"):
                out.append(pw[i + n] * (q[i + n] - q[i]) ^ np.uint64(n))
        fp, count = np.unique(np.concatenate(out), return_counts=True)
        if len(fp):
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(count.astype(np.int64))], ["fp", "count"])


def _phrases(batches: Iterator[pa.RecordBatch], frequent: np.ndarray | None, seen: np.ndarray | None, bases: tuple) -> Iterator[pa.RecordBatch]:
    """lang, n, phrase, count: the text of every phrase whose fingerprint was counted often enough, counted per slice."""
    for langs, words, number, lang, h, piece in _slices(batches):
        pw, q = _fingerprints(h, bases[0])
        known = _among(h, frequent)
        names, texts = pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string())
        for n in range(2, LONGEST + 1):
            i = _starts(known, piece, n)
            with np.errstate(over="ignore"):
                i = i[_among(pw[i + n] * (q[i + n] - q[i]) ^ np.uint64(n), seen)]
            if not len(i):
                continue
            # phrases by the numbers of their lang and words, one after the other, so that no product passes 64 bits
            key = lang[i]
            for j in range(n):
                _, first, key, count = np.unique(key * len(words) + number[i + j], return_index=True, return_inverse=True, return_counts=True)
            at = i[first]
            phrase = pc.binary_join_element_wise(*[texts.take(pa.array(number[at + j])) for j in range(n)], " ")
            yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[at])), pa.array(np.full(len(at), n, np.int32)), phrase, pa.array(count)],
                                             ["lang", "n", "phrase", "count"])


def _small(df: DataFrame, column: str, bound: int) -> np.ndarray | None:
    """The sorted values of a column when there are at most ``bound`` of them (counted first), else None."""
    if df.count() > bound:
        return None
    values = df.select(column).toArrow().column(0).to_numpy()
    return np.sort(values.astype(np.int64).view(np.uint64))


def frequent_phrases(docs: DataFrame, text: str = "text", least: int = LEAST, bases: tuple = BASES) -> DataFrame:
    """lang, n (words), phrase, f for every phrase of 1 to 3 words seen ``least`` times or more, and n = 0 rows with the words of each lang.

    Words are counted by text. Phrases of 2 and 3 frequent words are counted by
    fingerprint; a fingerprint's count is at least that of each of its phrases, so every
    occurrence whose fingerprint reaches ``least`` is taken again and counted by its
    words, which settles collisions. The sets of frequent words and
    fingerprints reach the tasks when counted under ``BROADCAST_KEYS``; beyond it words
    are not used to prune, and every phrase is counted by text.
    """
    tokens = _tokens(docs, text)
    word_counts = stage(tokens.mapInArrow(_word_counts, "lang string, phrase string, count long")
                        .groupBy("lang", "phrase").agg(F.sum("count").alias("f")))
    words = word_counts.where(F.col("f") >= least)
    frequent = _small(words.select(F.xxhash64("phrase").bitwiseXOR(F.xxhash64("lang")).alias("k")), "k", BROADCAST_KEYS)
    # slices have counted their fingerprints, and few come again in a task: they are not gathered once more before the shuffle
    counted = stage(tokens.mapInArrow(lambda b: _counts(b, frequent, bases), "fp long, count long").repartition("fp")
                    .groupBy("fp").agg(F.sum("count").alias("f")).where(F.col("f") >= least))
    seen = _small(counted, "fp", BROADCAST_KEYS)
    longer = (tokens.mapInArrow(lambda b: _phrases(b, frequent, seen, bases), "lang string, n int, phrase string, count long")
              .groupBy("lang", "n", "phrase").agg(F.sum("count").alias("f")).where(F.col("f") >= least))
    totals = word_counts.groupBy("lang").agg(F.sum("f").alias("f")).select("lang", F.lit(0).alias("n"), F.lit(None).cast("string").alias("phrase"), "f")
    return words.select("lang", F.lit(1).alias("n"), "phrase", "f").unionByName(longer).unionByName(totals)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE a^2 / (l r)), exact in 38 digits; at most SCALE, as l and r are at least a."""
    num = a.cast("decimal(38,0)") * a.cast("decimal(38,0)") * F.lit(SCALE).cast("decimal(38,0)")
    return F.call_function("div", num, left.cast("decimal(38,0)") * right.cast("decimal(38,0)")).cast("long")


def collocations(docs: DataFrame, text: str = "text", least: int = LEAST, top: int = TOP, bases: tuple = BASES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's strongest phrases of 2 or 3 words.

    a: occurrences of the phrase inside pieces (overlaps count), n: words of the lang.
    Each cut after k words gives l = f(first part), r = f(rest) and score =
    floor(SCALE a^2 / (l r)); the lowest counts, ties to the smallest k. A phrase of 2
    words goes when a candidate of 3 words holds it with 2 f(longer) >= a. The first
    ``top`` of each lang by score, a (both descending), phrase (UTF-8 ascending).
    """
    found = stage(frequent_phrases(docs, text, least, bases))
    totals = found.where(F.col("n") == 0).select("lang", F.col("f").alias("words"))
    freq = found.where(F.col("n") > 0)
    look = freq.select("lang", F.col("phrase").alias("part"), F.col("f").alias("pf"))
    cands = freq.where(F.col("n") >= 2).select("lang", "n", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    def cut(k: int) -> DataFrame:
        head = F.array_join(F.slice("w", 1, k), " ")
        rest = F.array_join(F.slice("w", k + 1, LONGEST), " ")
        base = cands.where(F.col("n") > k).select("lang", "phrase", "a", head.alias("_l"), rest.alias("_r"))
        joined = (base.join(look.withColumnRenamed("part", "_l").withColumnRenamed("pf", "l"), ["lang", "_l"])
                  .join(look.withColumnRenamed("part", "_r").withColumnRenamed("pf", "r"), ["lang", "_r"]))
        return joined.select("lang", "phrase", "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score"), F.lit(k).alias("k"))

    cuts = cut(1).unionByName(cut(2))
    best = (cuts.groupBy("lang", "phrase")
            .agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("b"))
            .select("lang", "phrase", "b.a", "b.l", "b.r", "b.score"))
    longer = cands.where(F.col("n") == LONGEST)
    inside = (longer.select("lang", F.array_join(F.slice("w", 1, 2), " ").alias("phrase"), "a")
              .unionByName(longer.select("lang", F.array_join(F.slice("w", 2, 2), " ").alias("phrase"), "a"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("outer")))
    kept = (best.join(inside, ["lang", "phrase"], "left")
            .where(F.col("outer").isNull() | (100 * F.col("outer") < 50 * F.col("a"))))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    return (kept.join(totals, "lang").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score"))
