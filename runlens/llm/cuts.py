"""Cutting of texts at places that a byte-level pre-tokenizer never matches across, and tables of what was made for the pieces.

A text may be cut before each space or line break that no white space follows: white space before it is matched without
it, and it is matched alone or with what follows. A chunk is what follows such a space, or starts with its line break.
"""

from __future__ import annotations

import re
from collections.abc import Callable

APART = re.compile(r" (?=\S)|(?=\n\S)")


def cut_texts(texts: list[str]) -> tuple[list[list[str]], set[str]]:
    """What comes before the first cut and the chunks after it, of each text, and all different chunks.

    Texts are split at every space and line break first, which is fast; those in which white space follows one are cut again.
    """
    cuts = [t.replace("\n", " \n").split(" ") for t in texts]
    chunks = set().union(*(c[1:] for c in cuts))
    wrong = {c for c in chunks if not (c[1:2] if c[:1] == "\n" else c[:1]).strip()}
    if wrong:
        for k, own in enumerate(cuts):
            if not wrong.isdisjoint(own[1:]):
                cuts[k] = APART.split(texts[k])
        chunks = set().union(*(c[1:] for c in cuts))
    return cuts, chunks


class Recent:
    """Values of keys, made for many at once, and kept if they were used within the last two generations of `size` keys."""

    def __init__(self, size: int, make: Callable[[list[str]], list[bytes]]):
        self.size, self.make = size, make
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, keys: set[str]) -> dict[str, bytes]:
        """A table that has the keys' values. It is the kept one, not a copy, unless a generation ends."""
        missing = keys.difference(self.new)
        if not missing:
            return self.new
        fresh, old = missing.difference(self.old), self.old
        order = list(fresh)
        made = zip(order, self.make(order) if order else [], strict=True)
        if len(self.new) + len(missing) > self.size:
            self.old, self.new = self.new, {k: old[k] for k in missing - fresh}
            self.new.update(made)
            return {k: self.old[k] for k in keys - missing} | self.new
        self.new.update(made)
        self.new.update((k, old[k]) for k in missing - fresh)
        return self.new
