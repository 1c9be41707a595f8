import hashlib

from brindle.llm import suffix_dedup


def brute(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                mark[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out[d] = (len(b), sum(mark), sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark)), hashlib.sha256(kept).hexdigest())
    return out


def check(docs, length=100, **how):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs, length=length, parts=5, **how).collect()}
    assert got == brute(rows, length)


def test_against_brute_force(make_docs, prose):
    check(make_docs(prose))


def test_short_windows_and_large_families(make_docs, prose):
    check(make_docs(prose), length=40, gram=8)
    check(make_docs(prose), family_rows=3)


def test_periodic_and_non_ascii(make_docs):
    check(make_docs(["a" * 500, "a" * 120, "ab" * 300, "é" * 90, "xé" * 200, "日本" * 80, "a" * 99, "a" * 100]))


def test_edges(spark, make_docs):
    empty = suffix_dedup.dedup(make_docs([(1, "x")]).limit(0), parts=2)
    assert empty.collect() == [] and empty.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    long = "word%d " * 40 % tuple(range(40))
    rows = suffix_dedup.dedup(make_docs([(7, long), (7, long), (None, long)], 1), parts=2).collect()
    assert sorted(r.n_removed > 0 for r in rows) == [False, True, True]
    assert [r.n_removed for r in rows if r.doc_id is None] == [0]


def test_many_shards(spark, make_docs, prose, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 2000)
    check(make_docs(prose, 4))
