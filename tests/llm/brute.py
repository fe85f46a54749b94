"""Brute-force versions and the edge table that the tests share."""
from __future__ import annotations

import hashlib
import re

import numpy as np

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None, lower: bool = False) -> list[bytes]:
    data = (text or "").encode()
    return WORDS.findall(data.lower() if lower else data)


def shingles(text: str | None) -> set:
    w = words(text, True)
    if 0 < len(w) < 5:
        return {tuple(w)}
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def components(rows: list[tuple]) -> dict:
    """id -> (set size, smallest linked id), by comparing all pairs."""
    sets = {k: shingles(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= 75 * (len(x) + len(y) - n):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {k: (len(sets[k]), find(k)) for k in keys}


def without_repeats(rows: list[tuple]) -> dict:
    """id -> (words, removed, hash of what is kept)."""
    seen, out = set(), {}
    for k, t in sorted(rows):
        w, gone = words(t), set()
        for i in range(len(w) - 19):
            window = tuple(w[i:i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[k] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def u4(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


def edge_rows() -> list[tuple]:
    """(doc_id, text) with nulls, empty, very long, tied and repeated ones."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocabulary, 80)) for _ in range(6)]
    rows = [(1, base[0]), (2, base[0]), (3, base[0] + " extra words here"), (4, base[1]), (5, base[1] + "\n" + base[2]),
            (6, None), (7, ""), (8, " \n\t "), (9, "one two"), (10, "One two"), (11, "x"), (12, base[3].upper()), (13, base[3]),
            (14, " ".join(rng.choice(vocabulary, 40_000))), (15, base[4] + " " + base[4]), (16, "<|endoftext|> é ß 中文  double  spaces\r\n"),
            (17, "a " * 300), (18, "!" * 5000), (19, base[5] + " " + base[0])]
    return rows


def edge_table(spark, rows=None):
    """The edge rows, with further columns whose names clash with those the operators use inside."""
    rows = edge_rows() if rows is None else rows
    return spark.createDataFrame([(i, t, "x", 5, 0.5, "y", 7, None, [1]) for i, t in rows],
                                 "doc_id long, text string, _text string, _row long, score double, _id string, n_tokens int, lang string, ids array<int>")
