"""Whole-text encoding with the public tokenizer files, reusing the ids of pieces.

A piece starts at a space that follows a character which is no white space, or stands
next to a single line end between such characters.  For both vocabularies these places
are always borders between pre-tokens, whatever stands on either side, so the ids of a
text are those of its pieces in a row.
Ids of pieces are kept in a bounded table that lives as long as the Python worker.
"""
from __future__ import annotations

import json
import re

import numpy as np

KEPT_PIECES = 600_000        # pieces a worker keeps; the table starts anew beyond it
_SPACE_RUN = re.compile(r"\s\s")
_SEPARATORS = re.compile("[\x1c-\x1f]")     # white space to Python alone
_BORDER = re.compile(r"(?<=\S)(?= )")
_WORD = re.compile(r" ?([a-zß-öø-ÿ]+)([.,;:!?%$#&*|]*)")
_EXOTIC = re.compile("[^\x00-ɏ]")

_LOADED: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The worker's encoder for a tokenizer file, loaded on first use."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


class _Kept(dict):
    """Ids of pieces; pieces that are asked for in vain are listed in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> bytes:
        self.new.append(piece)
        return b""


def _byte_of_char() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Encoder:
    """Encodes as ``tokenizers`` does with this file and ``add_special_tokens=False``.

    Byte strings are merged by ``tiktoken`` in the order of the file's own merges, which
    gives the same ids faster; pieces with letters beyond the Latin blocks, and of
    vocabularies with word ends all but a word with marks behind it, go to ``tokenizers``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 65536 else "<u4")
        self.lower = any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
        self.ranks = None
        self.bytes_of: list[bytes] | None = None
        decoder = (spec.get("decoder") or {}).get("type")
        if decoder == "ByteLevel" and not spec.get("normalizer") and not spec["model"].get("end_of_word_suffix"):
            chars = _byte_of_char()
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            self.bytes_of = [b""] * self.size
            for token, i in spec["model"]["vocab"].items():
                if token not in special:
                    self.bytes_of[i] = bytes(chars[c] for c in token)
            for token, i in special.items():
                self.bytes_of[i] = token.encode()
            self.lengths = np.array([len(b) for b in self.bytes_of])
            import tiktoken

            # Fixed value: the split pattern of this kind of vocabulary.
            pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.ranks = tiktoken.Encoding("file", pat_str=pattern, special_tokens=special,
                                           mergeable_ranks={b: i for i, b in enumerate(self.bytes_of)
                                                            if i not in special.values()})
        self.words = None
        if spec["model"].get("end_of_word_suffix") == "</w>" and self.lower:
            self._word_ranks(spec)
        self.kept = _Kept()

    def _word_ranks(self, spec: dict) -> None:
        """Ranks for words with a zero byte as their end: it joins the last byte first, then the file's merges follow."""
        import tiktoken

        chars, vocab = _byte_of_char(), spec["model"]["vocab"]

        def spelled(token: str) -> bytes:
            end = token.endswith("</w>")
            return bytes(chars[c] for c in (token[:-4] if end else token)) + b"\0" * end

        plain = {c: b for c, b in chars.items() if b}
        of = {bytes([b]): vocab[c] for c, b in plain.items()} | {b"\0": -1}
        of |= {bytes([b, 0]): vocab[c + "</w>"] for c, b in plain.items()}
        for merge in spec["model"]["merges"]:
            token = "".join(merge.split(" ") if isinstance(merge, str) else merge)
            of.setdefault(spelled(token), vocab[token])
        self.word_ids = np.array(list(of.values()), np.int64)
        self.word_ends = np.array([b.endswith(b"\0") for b in of])
        self.words = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", special_tokens={},
                                       mergeable_ranks={b: i for i, b in enumerate(of)})

    def _learn_words(self, pieces: list[str]) -> list[str]:
        """Learns pieces that are a Latin word with plain marks behind it; returns the others."""
        found, parts, counts, others = [], [], [], []
        for p in pieces:
            m = _WORD.fullmatch(p)
            if m is None:
                others.append(p)
                continue
            found.append(p)
            parts.append(m[1])
            if m[2]:
                parts.append(m[2])
            counts.append(2 if m[2] else 1)
        if not found:
            return others
        ranks = np.array(self.words.encode_ordinary("\0".join(parts) + "\0"), np.int64)
        last = np.flatnonzero(self.word_ends[ranks])[np.cumsum(counts) - 1] + 1
        data, width, start = self.word_ids[ranks].astype(self.dtype).tobytes(), self.dtype.itemsize, 0
        for p, end in zip(found, (last * width).tolist()):
            self.kept[p] = data[start:end]
            start = end
        return others

    def _plain(self, texts: list[str]) -> list[list[int]]:
        fast = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        if self.ranks is None:
            if self.words is not None:
                pieces = [p for i in range(0, len(pieces), 20_000) for p in self._learn_words(pieces[i:i + 20_000])]
            for p, ids in zip(pieces, self._plain(pieces)):
                self.kept[p] = np.array(ids, self.dtype).tobytes()
            return
        row, alone, rare = [], [], []
        for p in pieces:
            if not (p.isascii() or not _EXOTIC.search(p)):
                rare.append(p)
            elif p[:1] == " " and not p[-1].isspace() and "<|" not in p:
                row.append(p)
            else:
                alone.append(p)
        for p, ids in zip(rare, self._plain(rare)):
            self.kept[p] = np.array(ids, self.dtype).tobytes()
        for p in alone:
            self.kept[p] = np.array(self.ranks.encode(p, allowed_special="all"), self.dtype).tobytes()
        # pieces that begin with a space and end with none can be encoded in one go:
        # the lengths of tokens in bytes tell which ids belong to which
        for i in range(0, len(row), 20_000):
            part = row[i:i + 20_000]
            ids = np.array(self.ranks.encode_ordinary("".join(part)), self.dtype)
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(p.encode()) for p in part])) + 1
            data, width, start = ids.tobytes(), self.dtype.itemsize, 0
            for p, end in zip(part, (ends * width).tolist()):
                self.kept[p] = data[start:end]
                start = end

    def pieces(self, text: str) -> list[str]:
        if self.lower and "<|" not in text:   # ASCII letters only: the file's own rule sees to the rest
            text = text.encode().lower().decode()
            if not _SEPARATORS.search(text):  # white space ends every pre-token and is dropped
                return text.split()
        if "\0" in text or _SPACE_RUN.search(text):
            return _BORDER.split(text)
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned integers of ``dtype``."""
        split = [self.pieces(t) for t in texts]
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        get, new = self.kept.__getitem__, self.kept.new
        out, again = [], []
        for i, s in enumerate(split):
            known = len(new)
            out.append(b"".join(map(get, s)))
            if len(new) > known:
                again.append(i)
        if new:
            self._learn(sorted(set(new)))
            new.clear()
            for i in again:
                out[i] = b"".join(map(get, split[i]))
        return out

    def in_slices(self, texts: list[str], chars: int = 4_000_000):
        """``encode`` over slices of bounded size, in order."""
        start, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= chars:
                yield from self.encode(texts[start:i + 1])
                start, held = i + 1, 0
        yield from self.encode(texts[start:])

    def array(self, ids: bytes) -> np.ndarray:
        return np.frombuffer(ids, self.dtype)

    def decode(self, ids: np.ndarray) -> str:
        """As ``tokenizers`` decodes with ``skip_special_tokens=False``."""
        if self.bytes_of is None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def four_bytes(ids: np.ndarray) -> bytes:
    """The ids as little-endian unsigned 32-bit integers."""
    return ids.astype("<u4").tobytes()
