import hashlib
import re

import pytest

from brindle.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, window):
    wins = {}
    for name, t in items:
        w = words(t)
        k = min(len(w), window)
        for i in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add(str(name))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wins:
                    hit |= set(range(i, i + k))
                    found |= wins[tuple(w[i : i + k])]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


ITEMS = [(1, "The quick brown fox jumps over the lazy dog while seven wizards brew a potion at midnight"), (2, "short item here"), (10, "one"), (3, "a b a b a b a b a b a b a b a b"), (4, ""), (5, None), (2, "another short")]
TEXTS = [
    "the quick brown fox jumps over the lazy dog while seven wizards brew a potion", "Quick, BROWN fox! jumps over the lazy dog; while seven wizards brew a potion at midnight... and more",
    "a b a b a b a b a b a b a b a b a b a b", "x short item here y", "short item", "no hits at all in this", "", None, "one two " * 30, ("filler " * 400) + "short item here", "été one’s short-item-here ONE",
]


@pytest.mark.parametrize("chunk", [200_000, 5])
def test_against_brute_force(spark, make_docs, chunk):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = make_docs(TEXTS)
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination(docs, bench, chunk_words=chunk).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()}
    assert got == brute(list(enumerate(TEXTS)), ITEMS, 13)


def test_random_texts(spark, make_docs):
    import random

    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, text(rng.randint(0, 9))) for i in range(15)]
    texts = [text(rng.randint(0, 40)) for _ in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(make_docs(texts), bench, window=5).collect()}
    assert got == brute(list(enumerate(texts)), items, 5)


def test_spans_are_cut(spark, make_docs):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    rows = {r.doc_id: r.text for r in decontaminate.remove_spans(make_docs(["keep me, Alpha beta gamma. and more words here to stay", "alpha beta gamma", "clean", None]), bench).collect()}
    assert rows == {0: "keep me, . and more words here to stay", 2: "clean", 3: None}


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(make_docs(["a"]).limit(0), none).collect() == []
    r = decontaminate.contamination(make_docs(["a b"]), none).first()
    assert (r.n_words, r.n_hit, r.contaminated) == (2, 0, False)


def test_repetitive_texts_take_linear_time():
    import time

    same = [b"same"] * 100_000
    began = time.time()
    a = decontaminate.Automaton([("1", same[:20_000]), ("2", same[:5])], 13)
    hit, found = a.scan(same)
    assert hit.all() and found == {0, 1} and time.time() - began < 5


@pytest.mark.parametrize("chunk", [200_000, 3])
def test_no_window_is_left_around_a_cut(spark, make_docs, chunk):
    bench = spark.createDataFrame([(1, "a b c d"), (2, "x y z"), (3, "q r")], "item_id long, text string")
    docs = make_docs(["more a b x y z c d words q a b c d r end " + "pad " * 40, "a b c d", "pad " * 99 + "q r"])
    rows = {r.doc_id: r.text.split() for r in decontaminate.remove_spans(docs, bench, chunk_words=chunk).collect()}
    assert rows == {0: ["more", "words", "end", *["pad"] * 40], 2: ["pad"] * 99}
