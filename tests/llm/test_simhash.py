import random

import numpy as np
import xxhash

from brindle.llm import simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def partition(fps):
    """Components by brute force."""
    root = list(range(len(fps)))
    u = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 2
    changed = True
    while changed:
        changed = False
        for i, row in enumerate(near):
            low = min(root[j] for j in np.flatnonzero(row))
            if low < root[i]:
                root[i], changed = low, True
    return root


def test_fingerprints_and_components(make_docs, prose):
    docs = make_docs(prose)
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    texts = dict(enumerate(prose))
    fps = [slow_fingerprint(texts[i]) for i in sorted(texts)]
    assert [int(rows[i].fingerprint, 16) for i in sorted(texts)] == fps
    assert all(len(r.fingerprint) == 16 for r in rows.values())
    assert [rows[i].component_id for i in sorted(texts)] == partition(fps)
    assert len({r.component_id for r in rows.values()}) < len(rows)


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def partition_wide(texts, similarity=0.8):
    """Components by fingerprints at two bits or fewer, or by the similarity of five-word shingles."""
    fps, sets = [slow_fingerprint(t) for t in texts], [shingles(t) for t in texts]

    def linked(i, j):
        both = len(sets[i] | sets[j])
        return bin(fps[i] ^ fps[j]).count("1") <= 2 or (both and len(sets[i] & sets[j]) >= similarity * both)

    root = list(range(len(texts)))
    near = [[j for j in range(len(texts)) if linked(i, j)] for i in range(len(texts))]
    changed = True
    while changed:
        changed = False
        for i, others in enumerate(near):
            low = min(root[j] for j in [i, *others])
            if low < root[i]:
                root[i], changed = low, True
    return root


def edited(rng, text, rate):
    w = text.split()
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < rate else x for x in w)


def test_similar_texts(make_docs, prose):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    bases = [" ".join(word() for _ in range(rng.randint(60, 300))) for _ in range(25)]
    common = " ".join(word() for _ in range(40))
    texts = [*prose, *bases, *(edited(rng, b, rng.choice([0.005, 0.015, 0.02, 0.05])) for b in bases for _ in range(4)), *(f"{' '.join(word() for _ in range(60))} {common}" for _ in range(30))]
    rows = {r.doc_id: r.component_id for r in simhash.near_duplicates_by_similarity(make_docs(texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == partition_wide(texts)


def test_many_copies_of_one_text(make_docs):
    """Copies that are like the text that they were made from, but not like each other."""
    rng = random.Random(8)
    base = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(250))
    texts = [base, *(edited(rng, base, 0.016) for _ in range(150))]
    near = [i for i, t in enumerate(texts) if len(shingles(t) & shingles(base)) >= 0.8 * len(shingles(t) | shingles(base))]
    assert len(near) > 120
    rows = {r.doc_id: r.component_id for r in simhash.near_duplicates_by_similarity(make_docs(texts)).collect()}
    assert sum(rows[i] == 0 for i in near) >= 0.97 * len(near)


def test_large_groups_are_linked_whole(make_docs):
    """Copies like one text only, where others of their group hold passages that more texts share, and groups under one template."""
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    texts = []
    for _ in range(3):
        base, passages = text(250), [text(30) for _ in range(2)]
        texts += [base, *(edited(rng, base, 0.018) for _ in range(60))]
        texts += [f"{edited(rng, base, 0.02)} {' '.join(passages)}" for _ in range(6)]
        texts += [f"{text(40)} {' '.join(passages)} {text(40)}" for _ in range(90)]
    template = text(160)
    for _ in range(12):
        own = f"{template} {text(60)}"
        texts += [own, *(edited(rng, own, 0.012) for _ in range(8))]
    rows = {r.doc_id: r.component_id for r in simhash.near_duplicates_by_similarity(make_docs(texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == partition_wide(texts)


def test_a_crowd_of_nearly_similar_texts_is_not_verified_in_all_pairs(spark, monkeypatch):
    """Pairs too far apart by the parities of their shingles are not made, and none that is similar enough is lost."""
    rng = random.Random(10)
    pool = [rng.randrange(-(1 << 31), 1 << 31) for _ in range(200)]
    sets = [set(rng.sample(pool, 170)) for _ in range(40)]
    sets += [set(rng.sample(sorted(s), 165)) | {rng.randrange(1 << 31) for _ in range(3)} for s in sets[:10]]
    seen = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "node long, shingles array<int>")
    made, verified = [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda pairs, held, similarity: made.append(pairs.count()) or verified(pairs, held, similarity))
    with simhash.scratch():
        got = {(r.a, r.b) for r in simhash.pairs_of_crowd(seen, seen.select("node"), spark.createDataFrame([], "node long, root long"), 0.8).collect()}
    far = {(i, j) for j in range(len(sets)) for i in range(j)}
    alike = {(i, j) for i, j in far if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert got == alike and len(alike) >= 10
    assert made[0] < len(far) / 4


def test_links_in_buckets_of_any_size(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 5, 60])):
            x = base
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    want = partition(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    for held in (8192, 10):
        got = {r.node: r.root for r in simhash.connected(simhash.links(frame, held)).collect()}
        groups = lambda key: sorted(sorted(s for s, k in zip(signed, map(key, range(len(signed)))) if k == g) for g in set(map(key, range(len(signed)))))
        assert groups(lambda i: want[i]) == groups(lambda i: got.get(signed[i], signed[i]))


def test_large_bucket_lookup():
    rng = random.Random(4)
    u = np.unique(np.array([rng.getrandbits(9) | 5 << 40 for _ in range(600)], dtype=np.int64))
    assert len(u) > 256
    assert (simhash._roots(u, 0) == 0).all()


def test_edges(make_docs):
    rows = simhash.near_duplicates(make_docs([(5, ""), (3, None), (9, "a"), (9, "a"), (None, "a")])).collect()
    assert sorted((r.doc_id or -1, r.fingerprint == "0" * 16, r.component_id) for r in rows) == [(-1, False, 9), (3, True, 3), (5, True, 3), (9, False, 9), (9, False, 9)]
    assert simhash.near_duplicates(make_docs([(1, "x")]).limit(0)).collect() == []
    wide = simhash.near_duplicates_by_similarity(make_docs([(5, ""), (3, None), (9, "a"), (9, "A"), (None, "a")])).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in wide) == [(-1, 9), (3, 3), (5, 3), (9, 9), (9, 9)]
    assert simhash.near_duplicates_by_similarity(make_docs([(1, "x")]).limit(0)).collect() == []
