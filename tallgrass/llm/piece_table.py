"""Ids of the pieces of many texts at once: pieces are looked up by exact keys, or by hashes with their bytes compared."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from .common import _MASKS, eights, equal_spans, span_hashes

#: Bytes by which pieces are cut: spaces and line ends; A-Z count as a-z.
CUT = bytes(0x20 if b in (0x20, 0x0A) else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_HASHED = np.uint64(1 << 63)
_ALNUM = np.array([b < 0x80 and chr(b).isalnum() for b in range(256)])
_MARK = np.array([0x21 <= b <= 0x7E and not chr(b).isalnum() for b in range(256)])


def pieces(low: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pieces in concatenated texts: runs without a space, cut before a mark of ASCII that follows a letter or digit.

    A word pattern that takes letters, digits and marks apart never matches across such a cut, whatever comes before. None crosses
    from one text into the next.
    """
    solid = low != 0x20
    after = _ALNUM[low]
    # letters of Latin-1 but for the signs of multiplication and division
    after[1:] |= (low[:-1] == 0xC3) & (low[1:] != 0x97) & (low[1:] != 0xB7)
    begins, ends = solid.copy(), solid.copy()
    cut = after[:-1] & _MARK[low[1:]]
    begins[1:] &= ~solid[:-1] | cut
    ends[:-1] &= ~solid[1:] | cut
    edges = at[(at > 0) & (at < len(low))]
    begins[edges] = solid[edges]
    ends[edges - 1] = solid[edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def piece_keys(flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Pieces of up to seven bytes are their own keys, with their length in the top byte; longer ones have a hash with the top bit set."""
    sizes = end - begin
    keys = eights(flat)[begin] & _MASKS[np.minimum(sizes, 7)] | sizes.astype(np.uint64) << np.uint64(56)
    if len(far := np.flatnonzero(sizes > 7)):
        keys[far] = span_hashes(flat, begin[far], end[far]) | _HASHED
    return keys


class PieceTable:
    """Pieces by key, with their bytes and ids in pools. Beyond ``most`` pieces the half that was met least recently goes."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = 1_000_000):
        self.encode, self.most, self.turn = encode, most, 0
        self.keys = np.zeros(0, np.uint64)
        self.starts, self.sizes, self.met, self.raw_starts, self.raw_sizes = (np.zeros(0, np.int64) for _ in range(5))
        self.pool, self.raw = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def ids(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of texts given as bytes one after the other, how many each text has, and the numbers of the texts with a
        piece whose hash is another piece's too: their ids are wrong. The bytes must be ``plain``."""
        self.turn += 1
        low = np.frombuffer(flat.tobytes().translate(CUT), np.uint8).copy()
        # capital letters of Latin-1: 0xC3 and then 0x80 to 0x9E but for the sign of multiplication
        upper = np.flatnonzero(low[:-1] == 0xC3) + 1
        upper = upper[(low[upper] <= 0x9E) & (low[upper] != 0x97)]
        low[upper] += 0x20
        begin, end = pieces(low, at)
        keys = piece_keys(low, begin, end)
        back, found = pd.factorize(keys)
        where = np.empty(len(found), np.int64)
        where[back[::-1]] = np.arange(len(back) - 1, -1, -1)  # the first place of each piece
        slot, same = self.slots(found, low, begin[where], end[where])
        self.met[slot] = self.turn
        far = np.flatnonzero(keys >= _HASHED)
        first = where[back[far]]
        size = end[far] - begin[far]
        wrong = (end[first] - begin[first] != size) | ~same[back[far]]
        wrong |= ~equal_spans(low, begin[far], low, begin[first], np.where(wrong, 0, size))
        slot = slot[back]
        sizes = self.sizes[slot]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        out = self.pool[np.repeat(self.starts[slot] - (ends - sizes), sizes) + np.arange(total)]
        bounds = np.searchsorted(begin, at)
        before = np.concatenate([[0], ends])
        return out, np.diff(before[bounds]), np.unique(np.searchsorted(at, begin[far[wrong]], side="right") - 1)

    def slots(self, found: np.ndarray, flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key is in the table, and whether the piece there has these bytes; pieces that aren't there are encoded."""
        order = np.argsort(found)
        sorted_ = found[order]
        slot = np.searchsorted(self.keys, sorted_)
        there = slot < len(self.keys)
        there[there] = self.keys[slot[there]] == sorted_[there]
        new = np.flatnonzero(~there)
        if len(new):
            raw, fresh = flat.tobytes(), order[new]
            pieces = [raw[a:b] for a, b in zip(begin[fresh].tolist(), end[fresh].tolist(), strict=True)]
            made = self.encode([x.decode() for x in pieces])
            sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
            lengths = end[fresh] - begin[fresh]
            if len(self.keys) + len(new) > self.most:
                self.shrink(sorted_[there])
            at = np.searchsorted(self.keys, sorted_[new])
            self.keys = np.insert(self.keys, at, sorted_[new])
            self.starts = np.insert(self.starts, at, len(self.pool) + np.cumsum(sizes) - sizes)
            self.sizes = np.insert(self.sizes, at, sizes)
            self.raw_starts = np.insert(self.raw_starts, at, len(self.raw) + np.cumsum(lengths) - lengths)
            self.raw_sizes = np.insert(self.raw_sizes, at, lengths)
            self.met = np.insert(self.met, at, self.turn)
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(made), np.uint32)])
            self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(pieces), np.uint8)])
            slot = np.searchsorted(self.keys, sorted_)
        back = np.empty(len(order), np.int64)
        back[order] = slot
        same = np.ones(len(found), bool)
        far = np.flatnonzero(found >= _HASHED)
        size = end[far] - begin[far]
        same[far] = self.raw_sizes[back[far]] == size
        far, size = far[same[far]], size[same[far]]
        same[far] = equal_spans(flat, begin[far], self.raw, self.raw_starts[back[far]], size)
        return back, same

    def shrink(self, needed: np.ndarray) -> None:
        keep = self.met >= np.partition(self.met, len(self.met) // 2)[len(self.met) // 2] if len(self.met) else np.zeros(0, bool)
        if keep.all():
            keep = np.zeros(len(self.met), bool)
        keep[np.searchsorted(self.keys, needed)] = True
        self.pool, self.starts, self.sizes = _packed(self.pool, self.starts[keep], self.sizes[keep])
        self.raw, self.raw_starts, self.raw_sizes = _packed(self.raw, self.raw_starts[keep], self.raw_sizes[keep])
        self.keys, self.met = self.keys[keep], self.met[keep]


def _packed(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A pool of the runs that stay, one after the other."""
    ends = np.cumsum(sizes)
    at = np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
    return pool[at], ends - sizes, sizes


def plain(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts are all Latin-1 and hold nothing that may begin a special token."""
    odd = flat >= 0xC4
    odd[:-1] |= (flat[:-1] == 0x3C) & (flat[1:] == 0x7C)
    sums = np.concatenate([[0], np.cumsum(odd)])
    return sums[at[1:]] == sums[at[:-1]]
