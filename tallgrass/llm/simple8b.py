"""Simple-8b: as many ids as fit go into each 64-bit word, under a 4-bit selector.

A block holds 1024 ids (the last one fewer) and starts at a word of its own, so any block is
decoded alone, and all words of a selector are decoded together. Selector 0 is an escape: the next word
holds one id of more than 60 bits as it is.

A chunk is one binary value::

    magic 'S8BC' | version u16 | reserved u16 | documents u32 | blocks u32 | ids u64 | words u64
    key i64 x documents | key is null u8 x documents | ids of each document u64 x documents
    first word of each block u32 x (blocks + 1) | words u64 x words

All numbers are little-endian.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC, VERSION = b"S8BC", 1
HEAD = struct.Struct("<4sHHIIQQ")
BLOCK = 1024
#: Fixed values of the coding: ids in a word and bits of each, by selector. Selector 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)


#: Bits of each number below 2**16.
SHORT = np.concatenate([np.zeros(1, np.uint8), np.repeat(np.arange(1, 17, dtype=np.uint8), 1 << np.arange(16))])


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    if not len(ids) or ids.max() < len(SHORT):
        return SHORT[ids.astype(np.uint16)]
    out = np.zeros(len(ids), np.uint8)
    rest = ids.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= (np.uint64(1) << np.uint64(step))
        out += big.astype(np.uint8) * np.uint8(step)
        rest = np.where(big, rest >> np.uint64(step), rest)
    return out + (rest > 0)


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For each id of a (blocks, BLOCK) table the selector that packs most ids from there on; ids past the end count no bits."""
    blocks = len(bits)
    wide = np.zeros((blocks, BLOCK + 64), np.uint8)
    wide[:, :BLOCK] = bits
    tables, span = {1: wide}, 1
    while span < 32:  # maxima over 1, 2, 4, ... ids
        last = tables[span]
        grown = last.copy()
        np.maximum(grown[:, :-span], last[:, span:], out=grown[:, :-span])
        span *= 2
        tables[span] = grown
    out = np.zeros((blocks, BLOCK), np.uint8)
    for s in range(len(COUNTS) - 1, 0, -1):  # later ones pack more and win
        n = int(COUNTS[s])
        half = 1 << (n.bit_length() - 1) if n < 64 else 32
        half = min(half, 32)
        t = tables[half]
        most = np.maximum(t[:, :BLOCK], t[:, n - half : n - half + BLOCK])
        out[most <= BITS[s]] = s
    return out


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the first word of each block with the number of words at the end."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    # blocks with room behind them, so that a block's last word is filled with zeros
    wide = BLOCK + 64
    table = np.zeros((blocks, wide), np.uint64)
    whole = n // BLOCK
    table[:whole, :BLOCK] = ids[: whole * BLOCK].reshape(whole, BLOCK)
    table[whole:, : n - whole * BLOCK] = ids[whole * BLOCK :]
    bits = bit_lengths(table[:, :BLOCK].reshape(-1)).reshape(blocks, BLOCK)
    chosen = _selectors(bits)
    lengths = np.full(blocks, BLOCK, np.int64)
    lengths[-1] = n - (blocks - 1) * BLOCK
    taken = COUNTS[chosen]
    at, alive = np.zeros(blocks, np.int64), np.arange(blocks)
    begins = np.zeros((blocks, wide), bool)
    while len(alive):  # all blocks advance by a word at a time
        here = at[alive]
        begins[alive, here] = True
        at[alive] = here + taken[alive, here]
        alive = alive[at[alive] < lengths[alive]]
    owner, inside = np.nonzero(begins)
    selector = chosen[owner, inside]
    start = owner * wide + inside
    table = table.reshape(-1)
    escapes = selector == 0
    place = np.arange(len(start)) + np.concatenate([[0], np.cumsum(escapes)[:-1]])
    words = np.zeros(len(start) + int(escapes.sum()), np.uint64)
    words[place] = selector.astype(np.uint64) << np.uint64(60)
    words[place[escapes] + 1] = table[start[escapes]]
    for s in range(1, len(COUNTS)):
        mine = np.flatnonzero(selector == s)
        if not len(mine):
            continue
        begin, full = start[mine], np.zeros(len(mine), np.uint64)
        for j in range(int(COUNTS[s])):
            full |= table[begin + j] << np.uint64(j * int(BITS[s]))
        words[place[mine]] |= full
    sizes = np.bincount(owner, minlength=blocks) + np.bincount(owner, escapes, blocks).astype(np.int64)
    return words, np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint32)


def unpack(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """All ids of whole blocks; ``n`` is their number."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    # the word after an escape is no word of its own; it may look like an escape, so walk the few that do
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == 0):
        if not raw[i]:
            raw[i + 1] = True
    real = np.flatnonzero(~raw)
    block = np.repeat(np.arange(len(first) - 1), np.diff(first.astype(np.int64)))[real]
    counts = COUNTS[selector[real]]
    before = np.cumsum(counts) - counts
    base = before[np.searchsorted(real, first[:-1])]
    start = block * BLOCK + before - base[block]
    end = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(n, np.uint64)
    for s in range(len(COUNTS)):
        mine = np.flatnonzero(selector[real] == s)
        if not len(mine):
            continue
        if s == 0:
            out[start[mine]] = words[real[mine] + 1]
            continue
        w = words[real[mine]]
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for j in range(int(COUNTS[s])):
            at = start[mine] + j
            held = at < end[mine]
            out[at[held]] = (w[held] >> np.uint64(j * int(BITS[s]))) & mask
    return out


def write_chunk(keys: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    words, first = pack(ids.astype(np.uint64))
    return b"".join([
        HEAD.pack(MAGIC, VERSION, 0, len(keys), len(first) - 1, len(ids), len(words)),
        np.array([k or 0 for k in keys], "<i8").tobytes(), np.array([k is None for k in keys], np.uint8).tobytes(), np.array(lengths, "<u8").tobytes(),
        first.astype("<u4").tobytes(), words.astype("<u8").tobytes(),
    ])


def read_chunk(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Keys, ids of each document, all ids."""
    magic, version, _, docs, blocks, n, count = HEAD.unpack_from(raw)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a chunk of this format")
    at = HEAD.size
    keys = np.frombuffer(raw, "<i8", docs, at)
    nulls = np.frombuffer(raw, np.uint8, docs, at := at + 8 * docs)
    lengths = np.frombuffer(raw, "<u8", docs, at := at + docs)
    first = np.frombuffer(raw, "<u4", blocks + 1, at := at + 8 * docs)
    words = np.frombuffer(raw, "<u8", count, at + 4 * (blocks + 1))
    return [None if x else k for k, x in zip(keys.tolist(), nulls.tolist(), strict=True)], lengths.astype(np.int64), unpack(words, first, n)
