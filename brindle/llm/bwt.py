"""Burrows-Wheeler transforms of string collections, merged by interleave refinement.

The strings of a collection are cyclic: each is followed by its own sentinel and then by
itself again. ``transform`` sorts the rotations of one shard. ``merge`` never sorts
rotations again: after the method of Holt and McMillan (2014) it holds an interleave, the shard of each
row of the merged transform, right for the first h symbols. One pass takes each row's
preceding symbol from its shard in order and puts the rows in the stable order of those
symbols, which makes the interleave right for h + 1 symbols. Rows that a pass tells apart
had h symbols in common; blocks that stay together after ``depth`` passes are the
repeated intervals of that length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Transform:
    symbols: np.ndarray  # the symbol before each rotation, in their order
    order: np.ndarray  # the positions in the collection where the rotations start


def transform(text: np.ndarray, ends: np.ndarray, longest: int) -> Transform:
    """Of one shard: ``text`` holds the strings with their sentinels one after the other, ``ends`` where each one ends (exclusive)."""
    n = len(text)
    starts = np.concatenate([[0], ends[:-1]])
    after = np.arange(1, n + 1)
    after[ends - 1] = starts
    before = np.arange(-1, n - 1)
    before[starts] = ends - 1
    rank = text.astype(np.int64)
    hop, h = after, 1
    order = np.argsort(rank, kind="stable")
    while h < longest:
        key = rank * (int(rank.max()) + 1) + rank[hop]
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        if rank[order[-1]] == n - 1:
            break
        hop, h = hop[hop], 2 * h
    return Transform(text[before[order]], order)


def merge(shards: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, block, common): of each row of the merged order its shard, the interval it shares ``depth`` symbols with, and how many symbols it shares with the row before it (``depth`` at most)."""
    sizes = [len(s.symbols) for s in shards]
    n = sum(sizes)
    kind = np.uint8 if len(shards) < 256 else np.int64
    weave = np.repeat(np.arange(len(shards), dtype=kind), sizes)
    block = np.zeros(n, np.int32)
    common = np.full(n, depth, np.int32)
    common[:1] = 0
    symbols = np.empty(n, shards[0].symbols.dtype if shards else np.uint8)
    for h in range(depth):
        for i, s in enumerate(shards):
            symbols[weave == i] = s.symbols
        order = np.argsort(symbols, kind="stable")
        weave, block, sorted_ = weave[order], block[order], symbols[order]
        new = np.concatenate([[True], (sorted_[1:] != sorted_[:-1]) | (block[1:] != block[:-1])])
        common[new & (common == depth)] = h
        block = np.cumsum(new, dtype=np.int32)
        if block[-1:] == n:  # every row stands alone
            break
    return weave, block, common


def positions(shards: list[Transform], weave: np.ndarray) -> np.ndarray:
    """Where in its shard's collection the rotation of each merged row starts."""
    out = np.empty(len(weave), np.int64)
    for i, s in enumerate(shards):
        out[weave == i] = s.order
    return out
