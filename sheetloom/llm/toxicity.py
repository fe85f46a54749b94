"""Toxicity classifier with counterfactual regularisation.

Features are hashed words and word beginnings that a text contains.  A logistic model
over the most telling ones is fitted on a bounded sample of labelled rows.  Where a
labelled sentence names a group of people, its identity terms are swapped for others
of their kind and a second reading of the text is made; the fit adds the squared change
of the score between the two readings, so that naming a group does not make a text toxic.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, in_slices, stage, whole

SAMPLE_DOCS = 40_000     # labelled rows the model is fitted on, about so many, chosen by a hash of the id
BUCKETS = 1 << 18
FEATURES = 1_024         # features that get a weight
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
COUNTERFACTUAL = 5.0     # weight of the squared score change
RIDGE = 0.3
_KEPT_WORDS = 300_000
_EDGE = b".,;:!?\"'()[]{}<>*&%$#|-_/\\~^+="

# Identity terms by kind; a term is swapped for the next of its kind.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("immigrants", "refugees", "foreigners", "natives"), ("old", "young"), ("disabled", "deaf", "blind", "healthy"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)
_SWAP = {a.encode(): b.encode() for kind in IDENTITY for a, b in zip(kind, kind[1:] + kind[:1])}


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def buckets_of(word: bytes) -> tuple[int, ...]:
    """Buckets of one word: the word without marks at its ends, and its beginnings."""
    word = word.strip(_EDGE)
    if not word:
        return ()
    letters = word.decode("utf-8", "replace")
    parts = [b"w" + word, *(b"p" + letters[:n].encode() for n in PREFIXES if len(letters) > n)]
    return tuple(zlib.crc32(p) % BUCKETS for p in parts)


def swapped(words: Iterable[bytes]) -> list[bytes] | None:
    """The words with identity terms swapped, None if there are none."""
    words = list(words)
    out = [_SWAP.get(w.strip(_EDGE), w) for w in words]
    return out if out != words else None


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray      # chosen buckets, ascending
    weights: np.ndarray
    bias: float

    def reader(self) -> "Reader":
        return Reader(self)


class Reader:
    """Scores texts; keeps what words are worth, up to a bound."""

    def __init__(self, model: Model):
        self.place = {int(b): i for i, b in enumerate(model.buckets)}
        self.weights, self.bias = model.weights.tolist(), model.bias
        self.known: dict[bytes, tuple[int, ...]] = {}

    def features(self, words: Iterable[bytes]) -> set[int]:
        found: set[int] = set()
        known = self.known
        for w in set(words):
            at = known.get(w)
            if at is None:
                if len(known) >= _KEPT_WORDS:
                    known.clear()
                at = known[w] = tuple(i for b in buckets_of(w) if (i := self.place.get(b)) is not None)
            if at:
                found.update(at)
        return found

    def score(self, text: str) -> float:
        z = self.bias + sum(self.weights[i] for i in sorted(self.features(words_of(text))))
        return float(1.0 / (1.0 + np.exp(-z)))


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, keep, doc_id: str, text: str, rows: int) -> DataFrame:
    """Texts and labels of about ``rows`` labelled documents, at most twice as many, chosen by a hash of the id; written once.

    Rows with a null id or label are left out; of a repeated id the largest label counts.
    The ids have a fixed bound, so they are broadcast and texts do not move.
    """
    known = (labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).filter("_id is not null and _y is not null")
             .filter(keep(F.col("_id"))))
    share = max(1, known.count() // rows)
    chosen = known.filter(F.pmod(F.xxhash64("_id"), F.lit(share)) == 0).groupBy("_id").agg(F.max("_y").alias("_y")).limit(2 * rows)
    return stage(docs.select(F.col(doc_id).alias("_id"), whole(text).alias("_text")).join(F.broadcast(stage(chosen)), "_id").select("_text", "_y"))


def _count(batches):
    """Documents of each label that hold each bucket, in blocks."""
    total = np.zeros((2, BUCKETS), np.int64)
    docs = np.zeros(2, np.int64)
    for batch in in_slices(batches):
        for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(words_of(t))
            found = np.unique(np.array([b for w in words for b in buckets_of(w)], np.int64))
            total[int(y > 0), found] += 1
            docs[int(y > 0)] += 1
    used = np.flatnonzero(total.any(axis=0))
    if docs.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(total[1, used], docs[1])),
                                          pa.array(np.append(total[0, used], docs[0]))], names=["_bucket", "_toxic", "_clean"])


def choose(buckets: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, most: int = FEATURES) -> np.ndarray:
    """The buckets that tell most for toxicity: common in toxic texts, rare in others."""
    p, q = (toxic + 0.5) / (n_toxic + 1), (clean + 0.5) / (n_clean + 1)
    good = (toxic >= 4) & (p > 12 * q)
    order = np.lexsort((buckets, -toxic * np.log(p / q)))
    return np.sort(buckets[order[good[order]]][:most])


def fit_weights(rows: list[tuple[list[int], list[int] | None, int]], n: int, steps: int = 800) -> tuple[np.ndarray, float]:
    """Logistic weights from (features, features of the swapped reading or None, label)."""
    at = np.concatenate([np.full(len(f), i) for i, (f, _, _) in enumerate(rows)]) if rows else np.empty(0)
    at, of = at.astype(np.int64), np.array([j for f, _, _ in rows for j in f], np.int64)
    y = np.array([r[2] for r in rows], float)
    pairs = [(set(f), set(g)) for f, g, _ in rows if g is not None and set(f) != set(g)]
    pair_at = np.array([i for i, (f, g) in enumerate(pairs) for _ in f ^ g], np.int64)
    pair_of = np.array([j for f, g in pairs for j in sorted(f ^ g)], np.int64)
    sign = np.array([1.0 if j in f else -1.0 for f, g in pairs for j in sorted(f ^ g)])
    w, b = np.zeros(n), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else -3.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(at, w[of], len(rows))
        error = 1 / (1 + np.exp(-z)) - y
        grad = np.bincount(of, error[at], n) + RIDGE * w
        if pairs:
            change = np.bincount(pair_at, sign * w[pair_of], len(pairs))
            grad += np.bincount(pair_of, 2 * COUNTERFACTUAL * sign * change[pair_at], n)
        g = np.append(grad, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:n], b - step[n]
    return w, float(b)


def fit(sample: DataFrame) -> Model:
    """Model of a bounded sample ``(_text, _y)``; without labelled rows every score is the same."""
    counts = sample.mapInArrow(_count, "_bucket int, _toxic long, _clean long").groupBy("_bucket").agg(
        F.sum("_toxic").alias("t"), F.sum("_clean").alias("c"))
    total = counts.filter("_bucket = -1").head()
    if total is None or not total["t"]:
        return Model(np.empty(0, np.int64), np.empty(0), -3.0)
    rows = counts.filter("_bucket >= 0 and t >= 3").filter(F.col("t") * (total["c"] + 1) > F.col("c") * (total["t"] + 1)).collect()  # at most 2^18
    found = np.array([(r["_bucket"], r["t"], r["c"]) for r in rows], np.int64).reshape(-1, 3)
    chosen = choose(found[:, 0], found[:, 1], found[:, 2], total["t"], total["c"])
    empty = Model(chosen, np.zeros(len(chosen)), 0.0)

    def describe(batches):
        reader = empty.reader()
        for batch in in_slices(batches):
            own, other = [], []
            for t in batch.column(0).to_pylist():
                words = words_of(t)
                own.append(sorted(reader.features(words)))
                second = swapped(words)
                other.append(None if second is None else sorted(reader.features(second)))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(own, kind), pa.array(other, kind), batch.column(1)], names=["own", "other", "y"])

    rows = sample.mapInArrow(describe, "own array<int>, other array<int>, y int").collect()   # bounded by the sample
    readings = sorted(((r["own"], r["other"], int(r["y"] > 0)) for r in rows), key=repr)   # the same order in every run
    w, b = fit_weights(readings, len(chosen))
    return Model(chosen, w, b)


def score(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold``); null texts count as empty.

    One narrow pass.  Repeated rows and null ids stay; other columns are not read.
    """
    id_type = df.schema[doc_id].dataType.simpleString()

    def run(batches):
        reader = model.reader()
        for batch in in_slices(batches):
            s = np.array([reader.score(t) for t in batch.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             names=[doc_id, "score", "predicted"])

    return df.select(F.col(doc_id), whole(text).alias("_text")).mapInArrow(run, f"`{doc_id}` {id_type}, score double, predicted int")


def fit_labels(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_DOCS) -> Model:
    """Fitted on labels outside the held-out fold (crc32 of the id modulo 4 is 2)."""
    return fit(sample_labelled(docs, labels, "toxic", lambda i: F.crc32(i.cast("string").cast("binary")) % 4 != 2, doc_id, text, rows))


def held_out(doc_id: str = "doc_id"):
    return fold(doc_id, 4) == 2
