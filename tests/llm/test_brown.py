import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from brindle.llm import brown


def tokens(t):
    return (t or "").encode().lower().split() + [brown.END]


def fitted(docs, **how):
    train = docs.where(~brown.held_out(F.col("doc_id")))
    model, counts = brown.fit(train, **how)
    return model, counts, {r.doc_id: r for r in brown.score(docs, model, counts).collect()}


def test_base_scores(make_docs, prose):
    texts = dict(enumerate(prose))
    for how in ({}, {"lookup": 40, "core": 10, "buckets": 8, "classes": 4}):
        model, _, rows = fitted(make_docs(prose), **how)
        c = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t))
        n, v = sum(c.values()), len(c)
        assert (model.tokens, model.types) == (n, v)
        for i, t in texts.items():
            w = tokens(t)
            assert rows[i].n_tokens == len(w) and rows[i].n_known == sum(x in c for x in w)
            assert math.isclose(rows[i].base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)


def slow_score(model, text, c):
    """The model's formula, token by token."""
    words = model.words
    total, before = 0.0, words.end
    for w in tokens(text):
        if w == brown.END:
            unit, emission = words.end, 0.0
        elif w in words.table:
            unit, emission = words.table[w], 0.0
        else:
            bucket = brown.bucket_of(w, words.buckets)
            unit, emission = len(words.table) + bucket, math.log10(c[w] + 1) + model.bucket_rest[bucket]
        total += model.step[model.of[before], model.of[unit]] + model.emit[unit] + emission
        before = unit
    return total


def test_model_scores_and_sums(make_docs, prose):
    model, counts, rows = fitted(make_docs(prose), lookup=60, core=20, buckets=8, classes=5)
    c = Counter({bytes(r["word"]): r["c"] for r in counts.collect()})
    for i, t in enumerate(prose):
        assert math.isclose(rows[i].score, slow_score(model, t, c), rel_tol=1e-9)
    assert np.allclose((10**model.step).sum(1), 1)
    assert np.allclose(np.bincount(model.of, 10**model.emit), 1)
    # within a bucket the words and one unknown event share all of it
    for b in range(8):
        inside = [w for w in c if w not in model.words.table and brown.bucket_of(w, 8) == b]
        assert math.isclose(sum(c[w] + 1 for w in inside) * 10 ** model.bucket_rest[b] + 10 ** model.bucket_rest[b], 1, rel_tol=1e-9)


def test_sweep_puts_each_word_where_it_is_most_likely(make_docs, prose):
    """The counts of the sweep and its choice against a plain program."""
    docs = make_docs(prose)
    words, _ = brown.vocabulary(docs, lookup=50, buckets=6)
    codes = brown.coded(docs, words)
    of = np.array([i % 4 for i in range(words.end)] + [4])
    texts = [[words.table.get(w, len(words.table) + brown.bucket_of(w, 6)) for w in tokens(t)[:-1]] for t in prose]
    before, after, pairs = np.zeros((words.end, 5)), np.zeros((words.end, 5)), np.zeros((5, 5))
    for t in texts:
        for a, b in zip([words.end, *t], [*t, words.end]):
            pairs[of[a], of[b]] += 1
            if b < words.end:
                before[b, of[a]] += 1
            if a < words.end:
                after[a, of[b]] += 1
    want = of.copy()
    for w in range(10, words.end):
        if before[w].sum():
            fits = []
            for k in range(4):
                own = of[w] == k
                col, row = pairs[:, k] - own * before[w], pairs[k] - own * after[w]
                fits.append((before[w] * (np.log(col + 0.5) - np.log(pairs[:, k].sum() - own * before[w].sum() + 0.5))).sum() + (after[w] * (np.log(row + 0.5) - np.log(pairs[k].sum() - own * after[w].sum() + 0.5))).sum())
            want[w] = int(np.argmax(fits))
    assert (brown.swept(codes, words.end, of, 4, 10, 3) == want).all() and (want != of).any()
    assert (brown.pair_counts(codes, words.end, of, 5) == pairs).all()


def test_sweeps_class_words_outside_the_core(make_docs):
    rng = random.Random(4)
    kinds = [[f"{k}{i}" for i in range(40)] for k in ("xa", "xb", "xc")]
    texts = [" ".join(rng.choice(kinds[i % 3]) for i in range(60)) for _ in range(150)]
    held = lambda rows: sum(r.score for i, r in rows.items() if zlib.crc32(str(i).encode()) % 7 == 2)
    _, _, without = fitted(make_docs(texts), core=30, buckets=4, classes=4, sweeps=0)
    _, _, swept = fitted(make_docs(texts), core=30, buckets=4, classes=4, sweeps=2)
    assert held(swept) > 0.95 * held(without)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(1)
    # two kinds of units that follow each other in turn
    pairs = np.zeros((13, 13), np.int64)
    for a in range(12):
        for b in range(12):
            pairs[a, b] = rng.integers(50, 60) if (a < 6) != (b < 6) else rng.integers(0, 2)
    pairs[12, :6] = pairs[6:12, 12] = 5
    of = brown.exchange(pairs, 2, 5)
    assert len(set(of[:6])) == 1 and len(set(of[6:12])) == 1 and of[0] != of[6] and of[12] == 2

    def likelihood(of):
        t = brown.by_class(pairs, of, 3)
        return brown._h(t).sum() - brown._h(t.sum(0)).sum() - brown._h(t.sum(1)).sum()

    assert likelihood(of) > likelihood(np.array([*np.arange(12) % 2, 2]))


def test_beats_the_base_on_held_out_text(make_docs):
    rng = random.Random(2)
    kinds = [["the", "a", "this"], ["dog", "cat", "bird", "fish"], ["sees", "likes", "eats"]]
    texts = [" ".join(rng.choice(kinds[i % 3]) for i in range(30)) for _ in range(120)]
    _, _, rows = fitted(make_docs(texts), classes=4)
    held = [r for i, r in rows.items() if zlib.crc32(str(i).encode()) % 7 == 2]
    assert held and sum(r.score for r in held) > 1.3 * sum(r.base_score for r in held)


def test_edges(make_docs):
    _, _, rows = fitted(make_docs([(1, ""), (3, None), (None, "a b"), (4, "a"), (4, "a")]))
    assert rows[1].n_tokens == 1 and rows[3].n_tokens == 1
    model, counts, rows = fitted(make_docs([(2, "x")]).limit(0))
    assert rows == {} and model.tokens == 0
