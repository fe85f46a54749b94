"""Text-store jobs: entries, tags, near duplicates, markers, token sizes."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from .blocks import BROADCAST_ROWS, SLICES

# Entry heading, and markers that tie an entry to one job.
HEADING = r"^##[ \t]*\[(\w+)\][ \t]*([^\n]*)"
MARKERS = (("column-letter reference", r"\b[Cc]ol(?:umn)?s?\.?\s+[A-Z]\b"),
           ("data-file name", r"\b[A-Za-z0-9_-]+\.(?:xlsx|xlsm|csv)\b"),
           ("job id", r"\btable-\d{6,8}\b"))


def split_entries(df: DataFrame, text: str = "text", ids: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Entries ``(ids, entry_no, tag, title, body)`` of heading-marked text.

    The text is cut in front of its headings inside the row; what precedes the
    first heading belongs to no entry.
    """
    pieces = F.filter(F.split(text, r"(?m)^(?=##[ \t]*\[\w+\])"), lambda x: x.rlike(HEADING))
    rows = df.select(*ids, F.posexplode_outer(pieces).alias("_pos", "_piece")).filter(F.col("_pos").isNotNull())
    title = T._strip(F.regexp_extract("_piece", HEADING, 2))
    body = F.regexp_replace("_piece", r"\A[^\n]*\n?", "")
    return rows.select(*ids, (F.col("_pos") + 1).cast("bigint").alias("entry_no"),
                       F.lower(F.regexp_extract("_piece", HEADING, 1)).alias("tag"),
                       title.alias("title"), body.alias("body"))


def by_tag(entries: DataFrame, tags: Sequence[str] = (), column: str = "tag") -> DataFrame:
    """Entries with one of the tags; no tags means all."""
    return entries.filter(F.col(column).isin(*[t.lower() for t in tags])) if tags else entries


def nearest(df: DataFrame, corpus: DataFrame, ids: Sequence[str] = ("doc_id",), text: str = "text",
            corpus_id: str = "item_id", corpus_text: str = "text",
            broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Most similar corpus entry by word-set Jaccard, the earliest among equals.

    An index holds, per word, the entries that have it.  The word sets of the
    texts move once, by id; looking words up, counting the words shared with each
    entry and picking the best entry then all happen where the text is, so that
    no (text, entry) pair is shuffled or written.  The index is broadcast while
    the corpus has at most ``broadcast_rows`` entries (counted first); a larger
    one is joined by word, each word cut into slices so that a frequent one does
    not end up in one task.  A text that shares no word with the corpus has a null
    ``nearest``.
    """
    ids = list(ids)
    small = corpus.count() <= broadcast_rows
    entries = corpus.select(F.col(corpus_id).alias("_entry"), T.word_set(F.col(corpus_text)).alias("_w"))
    postings = entries.select(F.explode_outer("_w").alias("_word"), F.struct(
        "_entry", F.size("_w").alias("n")).alias("_p"))
    texts = df.select(*ids, T.word_set(F.col(text)).alias("_words"))
    if small:
        # at most one posting per entry, and the number of entries is checked
        index = F.broadcast(postings.groupBy("_word").agg(F.collect_list("_p").alias("_ps")))
        texts = texts.repartition(*[F.col(c) for c in ids])
    # the outer form keeps the optimizer from testing the word set before building it;
    # texts without words find no posting
    words = texts.select(*ids, F.size("_words").alias("_mine"), F.explode_outer("_words").alias("_word"))
    if small:
        found = words.join(index, "_word").select(*ids, "_mine", F.explode("_ps").alias("_p"))
    else:
        sliced = postings.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
        words = words.withColumn("_slice", F.pmod(F.hash(*ids), F.lit(SLICES)))
        found = words.join(sliced, ["_word", "_slice"])
    shared = found.groupBy(*ids, "_mine", F.col("_p._entry").alias("_entry"), F.col("_p.n").alias("_n")).agg(
        F.count(F.lit(1)).alias("_shared"))
    score = F.col("_shared") / (F.col("_mine") + F.col("_n") - F.col("_shared"))
    best = shared.withColumn("_score", score).groupBy(*ids).agg(
        F.max("_score").alias("similarity"),
        F.min_by("_entry", F.struct((-F.col("_score")).alias("s"), F.col("_entry").alias("e"))).alias("nearest"))
    similarity = F.coalesce("similarity", F.lit(0.0))
    return df.select(*ids).join(best, ids, "left").select(
        *ids, "nearest", similarity.alias("similarity"), (similarity >= S.OVERLAP).alias("overlaps"))


def scan_markers(df: DataFrame, ids: Sequence[str] = ("doc_id",), text: str = "text",
                 markers: Sequence[tuple[str, str]] = MARKERS) -> DataFrame:
    """Every match of every marker ``(ids, label, matched)``, in one narrow pass."""
    def hits(label: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)),
                           lambda m: F.struct(F.lit(label).alias("label"), m.alias("matched")))

    found = [hits(label, pattern) for label, pattern in markers]
    return df.select(*ids, F.inline_outer(F.concat(*found))).filter(F.col("label").isNotNull())


def token_budget(df: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """Characters and estimated tokens per group, with subtotals and the total."""
    sized = df.select(*by, F.length(text).cast("bigint").alias("chars"), T.est_tokens(F.col(text)).alias("tokens"))
    return sized.rollup(*by).agg(F.count(F.lit(1)).alias("n_texts"), F.sum("chars").alias("chars"),
                                 F.sum("tokens").alias("tokens"))
