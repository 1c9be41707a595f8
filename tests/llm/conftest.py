import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, parts=3):
    """Documents of texts, or of (doc_id, text) pairs, over a few partitions."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
    return spark.createDataFrame(rows, DOC).repartition(parts)


@pytest.fixture
def make_docs(spark):
    return lambda texts, parts=3: docs_of(spark, texts, parts)


@pytest.fixture
def prose():
    """Random words with copies, near copies and shared passages."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = text(40)
    out = [text(rng.randint(1, 120)) for _ in range(60)]
    out += [out[i] for i in range(0, 20, 2)]
    for i in range(20):
        w = out[i].split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [f"{text(rng.randint(0, 9))} {shared} {text(rng.randint(0, 9))}" for _ in range(12)]
    return [*out, "", None, "x", "word " * 400, "ab " * 2000]
