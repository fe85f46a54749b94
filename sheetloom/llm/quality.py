"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.  No true
label is read: expectation-maximisation over the counts of vote patterns estimates how
often each labeller votes what on good and on bad documents (no vote says nothing), and gives each pattern its
posterior.  A linear scorer over hashed runs of character shapes and hashed votes then
learns the posteriors of a bounded sample, and scores whole texts in one pass.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, stage, whole

SAMPLE_DOCS = 8_000      # documents the scorer is fitted on, about so many, chosen by a hash of the text
DIMENSIONS = 2_048
THRESHOLD = 0.5
LABELLERS = ("symbols", "capitals", "bars", "shouting", "stutter", "short_words", "marks", "variety", "word_length", "letters")
SHARP = 5                # the first so many labellers say bad only on plain damage; EM starts from that
FALSE_ALARM = 1e-5       # and by default holds their bad votes on good documents to this share
GOOD, BAD, NONE = 1, 0, 2
VOTES = 3 * len(LABELLERS)

_CODES = np.zeros(256, np.int64)
_CODES[ord("a"):ord("z") + 1] = 1
_CODES[128:256] = 1
_CODES[ord("A"):ord("Z") + 1] = 2
_CODES[ord("0"):ord("9") + 1] = 3
for _i, _c in enumerate(b" \n\t\r.,;:!?'\"-()|/\\#$%&*@^~<>{}[]=+_`"):
    _CODES[_c] = 4 + _i
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#$%&*@^~<>{}[]=+_\\`")] = True


def votes(text: str) -> list[int]:
    """One vote per labeller; a text without words gets none."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [NONE] * len(LABELLERS)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower = counts[65:91].sum(), counts[97:123].sum() + counts[128:].sum() / 2
    letters, visible = upper + lower, len(data) - counts[[9, 10, 11, 12, 13, 32]].sum()
    marks = counts[list(b".,;:?!")].sum() / n
    bars, shouts = counts[ord("|")] / n, data.count(b"!!") / n
    symbols, capitals = counts[_SYMBOLS].sum() / visible, upper / max(letters, 1)
    short = sum(len(w) <= 3 for w in words) / n
    length, many = visible / n, n >= 60
    again = sum(a == b for a, b in zip(words, words[1:])) / n

    def vote(bad: bool, good: bool) -> int:
        return BAD if bad else GOOD if good else NONE

    return [
        vote(symbols > 0.08, symbols < 0.01),
        vote(capitals > 0.4 and letters >= 20, capitals < 0.12),
        vote(bars > 0.15, bars < 0.02),
        vote(shouts > 0.15, shouts < 0.02),
        vote(n >= 8 and again > 0.2, again < 0.05),
        vote(many and short < 0.08, many and short > 0.2),
        vote(many and marks < 0.01, many and 0.03 < marks < 0.3),
        vote(n >= 60 and len(set(words)) / n < 0.25, n >= 60 and len(set(words)) / n > 0.4),
        vote(length > 15, 2.5 < length < 10),
        vote(many and letters / visible < 0.6, letters / visible > 0.9),
    ]


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, false_alarm: float | None = FALSE_ALARM) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good per pattern, vote probabilities [class, labeller, vote], and the share of good.

    It starts from the sharp labellers: one bad vote of theirs makes bad likely, other bad
    votes leave it open.  ``false_alarm`` bounds the share of good documents on which a sharp
    labeller says bad; with None all rates are estimated.
    """
    sharp, bad = (patterns[:, :SHARP] == BAD).any(axis=1), (patterns == BAD).any(axis=1)
    post = np.where(sharp, 0.02, np.where(bad, 0.6, 0.98))
    share, table = 0.8, None
    for _ in range(rounds):
        weights = np.stack([counts * (1 - post), counts * post])
        table = np.stack([[np.bincount(patterns[:, j], w, 3)[:NONE] + 0.5 for j in range(patterns.shape[1])] for w in weights])
        table /= table.sum(axis=2, keepdims=True)
        if false_alarm is not None:
            table[GOOD, :SHARP, BAD] = np.minimum(table[GOOD, :SHARP, BAD], false_alarm)
        share = (weights[1].sum() + 1) / (weights.sum() + 2)
        given = np.minimum(patterns, GOOD)
        logs = np.stack([np.where(patterns == NONE, 0.0, np.log(table[c][np.arange(patterns.shape[1]), given])).sum(axis=1) for c in (0, 1)])
        odds = np.log(share / (1 - share)) + logs[1] - logs[0]
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            post = new
            break
        post = new
    return post, table, float(share)


def places(text: str) -> np.ndarray:
    """Hashed places of every run of three character shapes."""
    c = _CODES[np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), np.uint8)]
    return ((c[:-2] * 2654435761 + c[1:-1] * 40503 + c[2:] * 97) >> 4) & (DIMENSIONS - 1) if len(c) > 2 else c[:0]


def features(text: str, vote: list[int]) -> np.ndarray:
    """Shares of the hashed shapes, then 1 in the place of each vote."""
    p = places(text)
    shapes = np.bincount(p, minlength=DIMENSIONS) / max(len(p), 1)
    cast = np.zeros(VOTES)
    cast[[3 * j + v for j, v in enumerate(vote)]] = 1.0
    return np.concatenate([shapes, cast]).astype(np.float32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        z = self.bias + float(self.weights @ features(text, votes(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _vote(batches):
    for batch in in_slices(batches):
        found = ["".join(map(str, votes(t))) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["votes"])


def fit(docs: DataFrame, text: str = "text", rows: int = SAMPLE_DOCS, false_alarm: float | None = FALSE_ALARM) -> Model:
    """Votes of all documents make the patterns; a bounded sample makes the scorer.

    Patterns are counted before they are shuffled, and there are at most 3 ** labellers
    of them.  The sample's share is taken of the distinct texts, by an estimate of their number.
    Without documents every score is one half.
    """
    read = docs.select(whole(text).alias("_text"))
    found = read.mapInArrow(_vote, "votes string").groupBy("votes").count().collect()
    if not found:
        return Model(np.zeros(DIMENSIONS + VOTES), 0.0)
    found.sort(key=lambda r: r["votes"])
    patterns = np.array([[int(c) for c in r["votes"]] for r in found])
    post, _, _ = expectation_maximisation(patterns, np.array([r["count"] for r in found], float), false_alarm=false_alarm)
    posterior = {r["votes"]: float(p) for r, p in zip(found, post)}
    distinct = read.agg(F.approx_count_distinct(F.xxhash64("_text")).alias("n")).head()["n"]
    share = max(1, distinct // rows)
    hashed = read.select(F.xxhash64("_text").alias("_h"), "_text").filter(F.pmod("_h", F.lit(share)) == 0)

    def describe(batches):
        for batch in in_slices(batches):
            texts = batch.column(1).to_pylist()
            cast = [votes(t) for t in texts]
            x = [features(t, v).tobytes() for t, v in zip(texts, cast)]
            y = [posterior["".join(map(str, v))] for v in cast]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), pa.array(y, pa.float64())], names=["h", "x", "y"])

    # equal texts have equal hashes: of many copies one is enough, so the sample keeps its bound
    sample = hashed.dropDuplicates(["_h"]).mapInArrow(describe, "h long, x binary, y double").collect()
    sample.sort(key=lambda r: r["h"])
    if not sample:           # no text's hash met the share: what the votes say of all documents
        n = sum(r["count"] for r in found)
        good = sum(r["count"] * posterior[r["votes"]] for r in found)
        return Model(np.zeros(DIMENSIONS + VOTES), float(np.log((good + 1) / (n - good + 1))))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in sample])
    return Model(*_logistic(x, np.array([r["y"] for r in sample])))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[np.ndarray, float]:
    n, d = x.shape
    w, b = np.zeros(d, np.float32), 0.0
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        z = np.clip(x @ w + b, -50, 50)
        error = ((1 / (1 + np.exp(-z)) - y) / n).astype(np.float32)
        g = np.append(error @ x + 1e-6 * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
        w, b = (w - step[:d]).astype(np.float32), b - float(step[d])
    return w.astype(float), b


def score(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, ``score`` (0 to 1, higher: better) and ``keep`` (from ``threshold``).

    A null or empty text has the score of the bias alone.  Repeated rows and null ids
    stay; other columns are not read.  One narrow pass.
    """
    id_type = df.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in in_slices(batches):
            s = np.array([model.score(t) for t in batch.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(s >= threshold)], names=[doc_id, "score", "keep"])

    return df.select(F.col(doc_id), whole(text).alias("_text")).mapInArrow(run, f"`{doc_id}` {id_type}, score double, keep boolean")
