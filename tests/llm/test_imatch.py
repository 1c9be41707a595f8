import hashlib

from brindle.llm import imatch


def test_edited_texts_and_order(make_docs, prose):
    docs = make_docs(prose, 4)
    for parts in (1, 3, 7):
        rows = {r.doc_id: r for r in imatch.fingerprints(docs, parts=parts).collect()}
        order = sorted(range(len(prose)), reverse=True)
        for i, d in enumerate(order):
            own, nxt = prose[d] or "", prose[order[(i + 1) % len(order)]] or ""
            k = len(own) // 3
            new = own[: len(own) - k] + nxt[:k]
            assert rows[d].n_chars == len(own) and rows[d].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
            assert 0 <= rows[d].near_edited <= 1 and 0 <= rows[d].near_next <= 1
            if new == own:
                assert rows[d].near_edited == 1 and rows[d].fingerprint == rows[d].edited_fingerprint
        by_text = {}
        for d in order:
            by_text.setdefault(prose[d] or "", set()).add(rows[d].fingerprint)
        assert all(len(x) == 1 for x in by_text.values())


def test_fingerprints_by_the_definition(make_docs, prose):
    import xxhash

    lex = imatch.lexicon(make_docs(prose), rare=0.02, common=0.5)
    n = len(prose)
    df = {}
    for t in prose:
        for w in set((t or "").encode().lower().split()):
            df[w] = df.get(w, 0) + 1
    assert set(lex.number) == {w for w, c in df.items() if max(2, 0.02 * n) <= c <= max(2, 0.5 * n)}
    for t in prose[:30]:
        raw = (t or "").encode()
        own = sorted(w for w in set(raw.lower().split()) if w in lex.number)
        text, have = lex.fingerprint(raw)
        if not own:
            assert text == hashlib.sha256(raw).hexdigest()
            continue
        for j in range(len(imatch.RATES) * imatch.EACH):
            kept = [w for w in own if xxhash.xxh64_intdigest(w, imatch.SEED + 1 + j) % imatch.RATES[j // imatch.EACH] == 0]
            assert bool(have >> j & 1) == bool(kept)
            joined = b"".join(xxhash.xxh64_intdigest(w, imatch.SEED).to_bytes(8, "little") for w in kept)
            assert text[8 * j : 8 * j + 8] == (f"{xxhash.xxh32_intdigest(joined, imatch.SEED):08x}" if kept else "0" * 8)


def test_lexicon_is_bounded(make_docs, prose):
    full = imatch.lexicon(make_docs(prose))
    few = imatch.lexicon(make_docs(prose), max_lexicon=len(full.number) // 2)
    assert len(few.number) <= len(full.number) // 2


def test_likeness_tells_edits_from_strangers(make_docs):
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(80)]
    rows = imatch.fingerprints(make_docs(texts), common=0.5).collect()
    assert sum(r.near_edited for r in rows) / len(rows) > 0.3 > 0.1 > sum(r.near_next for r in rows) / len(rows)


def test_edges(make_docs):
    rows = imatch.fingerprints(make_docs([(1, "a b c d e f")]), parts=3).collect()
    assert len(rows) == 1 and rows[0].near_next == 1
    assert imatch.fingerprints(make_docs(["a"]).limit(0), parts=2).collect() == []
    rows = imatch.fingerprints(make_docs([(1, "abc"), (1, "xyz"), (None, "q" * 9), (2, None)]), parts=2).collect()
    assert sorted((r.doc_id is None, r.n_chars) for r in rows) == [(False, 0), (False, 3), (False, 3), (True, 9)]
