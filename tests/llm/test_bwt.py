import random

import numpy as np

from brindle.llm import bwt


def collection(strings):
    text = np.array([c for s in strings for c in (*s, 9)], dtype=np.uint16)
    return text, np.cumsum([len(s) + 1 for s in strings])


def rotations(strings):
    return [(tuple((*s, 9)[i:] + (*s, 9)[:i])) for s in strings for i in range(len(s) + 1)]


def test_transform_sorts_rotations():
    rng = random.Random(1)
    for _ in range(20):
        strings = [tuple(rng.randrange(3) for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 6))]
        text, ends = collection(strings)
        longest = max(len(s) + 1 for s in strings)
        t = bwt.transform(text, ends, longest)
        rows = rotations(strings)
        got = [(rows[p] * longest)[:longest] for p in t.order]  # a rotation goes on from its start
        assert got == sorted(got)
        assert t.symbols.tolist() == [rows[p][-1] for p in t.order]


def test_merge_finds_common_prefixes():
    rng = random.Random(2)
    for _ in range(20):
        shards = [[tuple(rng.randrange(2) for _ in range(15)) for _ in range(rng.randrange(1, 5))] for _ in range(3)]
        made = [bwt.transform(*collection(s), 16) for s in shards]
        depth = 5
        weave, block, common = bwt.merge(made, depth)
        at = bwt.positions(made, weave)
        rows = [rotations(s) for s in shards]
        merged = [rows[w][p] for w, p in zip(weave, at)]
        prefixes = [r[:depth] for r in merged]
        assert prefixes == sorted(prefixes)
        for i in range(1, len(merged)):
            assert (block[i] == block[i - 1]) == (prefixes[i] == prefixes[i - 1])
            same = next((k for k in range(depth) if prefixes[i][k] != prefixes[i - 1][k]), depth)
            if block[-1] != len(merged):
                assert common[i] == same
