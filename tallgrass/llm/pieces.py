"""A bounded cache of pieces of text that a tokenizer has already encoded."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class PieceCache:
    """Values of pieces in two generations.

    When the young one holds ``most`` pieces it becomes the old one; a piece that is met again
    moves back. So memory is bounded and frequent pieces are never encoded twice in a row.
    """

    def __init__(self, encode: Callable[[list], list], most: int = 300_000):
        self.encode, self.most = encode, most
        self.young: dict = {}
        self.old: dict = {}

    def learn(self, pieces: Iterable) -> dict:
        """A dictionary that holds all ``pieces`` until the next call."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        new = set(pieces) - self.young.keys()
        if new:
            back = new & self.old.keys()
            self.young.update((x, self.old[x]) for x in back)
            fresh = list(new - back)
            self.young.update(zip(fresh, self.encode(fresh), strict=True))
        return self.young
