"""Token ids of a byte-level BPE tokenizer file, with a worker-wide cache of pre-token encodings.

The tokenizers library encodes each distinct pre-token once per worker; texts are cut into pre-tokens with
numpy. A text that the cutter does not cover (letters beyond the Latin blocks, the strings of special tokens)
goes to the library whole, so ids are always the library's. New pre-tokens are encoded joined: the library cuts the
joined text at the same places, and the byte lengths of the tokens show where each pre-token ends.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .kernels import prefix_hash, ragged, range_hash, text_chunks

#: Pre-tokens that a worker remembers before it forgets all of them (about 32 bytes each).
CACHE_ENTRIES = 4_000_000
_OTHER, _LETTER, _NUMBER, _SPACE, _FOREIGN = range(5)


def vocabulary_path(name: str) -> str:
    """Path of a tokenizer file; a bare name is looked up among the installed public tokenizers."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point up to U+FFFF; what lies outside Latin, punctuation and symbols is foreign."""
    out = np.full(1 << 16, _FOREIGN, np.uint8)
    for start, end in ((0, 0x250), (0x2000, 0x2070), (0x20A0, 0x20C0)):
        for c in range(start, end):
            kind = unicodedata.category(chr(c))[0]
            out[c] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
            if unicodedata.category(chr(c)) == "Cn":
                out[c] = _FOREIGN
    # The code points with the Unicode property White_Space.
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]] = _SPACE
    return out


class CachedBPE:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.size = max(self.library.get_vocab(with_added_tokens=True).values()) + 1
        self.width = np.zeros(self.size, np.int64)  # bytes of each id: one character of a byte-level token stands for one byte
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self.forget()

    def forget(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.length = np.empty(0, np.int32)
        self.flat = np.empty(1 << 16, np.int32)
        self.used = 0

    def _append(self, ids: np.ndarray) -> int:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(len(self.flat), len(ids)), np.int32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Encode pre-tokens that are not known yet."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts, lengths = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int32)
        texts = b"\n".join(pieces).decode("utf-8").split("\n") if all(b"\n" not in p for p in pieces) else [p.decode("utf-8") for p in pieces]
        spaced, joined, rest = [], [], []
        for i, t in enumerate(texts):
            (rest if t[-1].isspace() or t[0].isspace() and t[0] != " " else spaced if t[0] == " " and t[1:].isalpha() else joined).append(i)
        for kind, glue in ((spaced, ""), (joined, "\n")):
            parts = [kind[i : i + 500] for i in range(0, len(kind), 500)]
            for part, e in zip(parts, self.library.encode_batch_fast([glue.join([texts[i] for i in part]) for part in parts], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.int32)
                size = sizes[part]
                last = np.cumsum(size + len(glue)) - len(glue)
                at = np.concatenate([[0], np.cumsum(self.width[ids])])
                begins, ends = np.searchsorted(at, last - size), np.searchsorted(at, last)
                assert ends[-1] == len(ids)
                starts[part], lengths[part] = self._append(ids) + begins, ends - begins
        for i in rest:
            ids = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.int32)
            starts[i], lengths[i] = self._append(ids), len(ids)
        keys = np.concatenate([self.keys, hashes])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.at = np.concatenate([self.at, starts])[order]
        self.length = np.concatenate([self.length, lengths])[order]

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts of pre-tokens in bytes, foreign flag of each row, row of each start)"""
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        n = len(cp)
        cls = np.where(cp < 0x10000, _classes()[np.minimum(cp, 0xFFFF)], _FOREIGN).astype(np.uint8)
        row_first = np.searchsorted(at, offsets)
        edges = row_first[:-1][row_first[:-1] < n]
        first = np.zeros(n + 1, bool)
        first[edges] = True
        first[n] = True
        prev = np.empty(n, np.uint8)
        prev[0] = 9
        prev[1:] = cls[:-1]
        prev[edges] = 9
        space = cls == _SPACE
        start = cls != prev
        follows = np.zeros(n, bool)
        follows[:-1] = ~space[1:]
        follows &= ~first[1:]
        start |= space & follows
        blank = np.zeros(n, bool)
        blank[1:] = cp[:-1] == 32
        blank[edges] = False
        start &= ~(blank & ~space & (prev == _SPACE))
        quote = np.flatnonzero((cp == 39) & start & ~blank)
        if len(quote):
            pad = np.concatenate([cp, np.zeros(3, np.uint32)])
            row_end = row_first[1:][np.searchsorted(row_first[1:], quote, "right")] if len(quote) else quote
            a = np.where(quote + 1 < row_end, pad[quote + 1], 0)
            b = np.where(quote + 2 < row_end, pad[quote + 2], 0)
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            start[quote[one | two] + 1] = False
            for q, skip in ((quote[one], 2), (quote[two], 3)):
                nxt = q + skip
                nxt = nxt[nxt < n]
                start[nxt[cls[nxt] == _LETTER]] = True
        chars = np.flatnonzero(start)
        row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(chars, row_first)))
        foreign = np.zeros(len(offsets) - 1, bool)
        strange = np.flatnonzero(cls == _FOREIGN)
        if len(strange):
            foreign[np.searchsorted(row_first[1:], strange, "right")] = True
        return at[chars], foreign, row_of

    def encode_chunk(self, data: np.ndarray, offsets: np.ndarray, want_ids: bool = True):
        """(tokens per row, ids of all rows joined or None) of rows data[offsets[i]:offsets[i+1]]"""
        rows = len(offsets) - 1
        counts = np.zeros(rows, np.int64)
        if not len(data):
            return counts, np.empty(0, np.int32)
        starts, whole, row_of = self._cut(data, offsets)
        raw = data.tobytes()
        for s in self.special:
            i = raw.find(s)
            while i >= 0:
                whole[np.searchsorted(offsets, i, "right") - 1] = True
                i = raw.find(s, i + 1)
        ends = np.append(starts[1:], len(data))
        if whole.any():
            keep = ~whole[row_of]
            starts, ends, row_of = starts[keep], ends[keep], row_of[keep]
        import pandas as pd

        codes, distinct = pd.factorize(range_hash(prefix_hash(data), starts, ends))
        where = np.searchsorted(self.keys, distinct)
        known = where < len(self.keys)
        known[known] = self.keys[where[known]] == distinct[known]
        if not known.all():
            if len(self.keys) > CACHE_ENTRIES:
                self.forget()
                known[:] = False
            seen = np.empty(len(distinct), np.int64)
            seen[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            new = np.flatnonzero(~known)
            self._learn(distinct[new], [raw[a:b] for a, b in zip(starts[seen[new]].tolist(), ends[seen[new]].tolist(), strict=True)])
            where = np.searchsorted(self.keys, distinct)
        lengths = self.length[where][codes].astype(np.int64)
        counts += np.bincount(row_of, lengths, rows).astype(np.int64)
        alone = {}
        for r in np.flatnonzero(whole):
            alone[int(r)] = np.array(self.library.encode(raw[offsets[r] : offsets[r + 1]].decode("utf-8"), add_special_tokens=False).ids, np.int32)
            counts[r] = len(alone[int(r)])
        if not want_ids:
            return counts, None
        ids = self.flat[ragged(self.at[where][codes], lengths)]
        if alone:
            parts, begin, done = [], np.concatenate([[0], np.cumsum(np.where(whole, 0, counts))]), 0
            for r, own in alone.items():
                parts += [ids[done : begin[r]], own]
                done = begin[r]
            ids = np.concatenate([*parts, ids[done:]])
        return counts, ids

    def encode_column(self, column: pa.Array, want_ids: bool = True):
        """Yields (first row, row after the last, tokens per row, ids) over chunks of a text column."""
        for lo, hi, data, offsets in text_chunks(column):
            yield lo, hi, *self.encode_chunk(data, offsets, want_ids)


@lru_cache(2)
def cached_bpe(path: str) -> CachedBPE:
    """One tokenizer and cache per worker and file."""
    return CachedBPE(vocabulary_path(path))
