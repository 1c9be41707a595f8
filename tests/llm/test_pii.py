import hashlib
import re

from brindle.llm import pii

# the base patterns as they are given, without the shortcuts
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in p.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]
            if ok():
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    "mail a.b@c.de, x@y@z.org @q.r a@b and a@b.c.d.@e.f", "a@b.c@d.e.f @ %+@x-y.z", "ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.0004 9.9.9.9.", "4111 1111 1111 1111 and 4111-1111-1111-1112 5500005555555559 12", "+1 (555) 123-4567 +4915112345678 +1 2 +12345678901234567",
    "é4111111111111111é +49 (30) 1234567é user@exämple.com ü@b.co", "", None, "no data", "1" * 3000, "." * 500 + "@" + "a." * 300 + "b", "0.0.0.0" * 20, "+" * 50 + "1-1-1-1-1-1-1-1-1-1",
]


def test_base_spans():
    for t in TEXTS:
        assert pii.base_spans(t or "") == brute(t), t


def test_random_base_spans():
    import random

    rng = random.Random(8)
    for _ in range(3000):
        t = "".join(rng.choice("a1@.+- (b29") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == brute(t), t


def test_table(make_docs):
    rows = {r.doc_id: r for r in pii.found_table(make_docs(TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        spans = brute(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert rows[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone) == tuple(sum(k == x for k, _, _ in spans) for x in PATTERNS)
        assert not text or set(text.split(",")) <= set(rows[i].spans.split(","))


def learning_texts():
    """Addresses after the words 'write to'; some are spelt so that no base pattern finds them."""
    known = [f"please write to user{i}@mail{i % 3}.example.com today" for i in range(30)]
    hidden = [f"please write to user{i}[at]mail9 today".replace("[at]", "@") for i in range(3)]
    other = [f"order number 77{i} shipped in box b{i}9z" for i in range(30)]
    return known + hidden + other


def test_learns_unseen_identifiers(make_docs):
    texts = learning_texts()
    rows = {r.doc_id: r for r in pii.spans(make_docs(texts)).collect()}
    for i in range(30, 33):
        assert not brute(texts[i])
        assert [texts[i][s.start : s.stop] for s in rows[i].more] == [f"user{i - 30}@mail9"] and rows[i].more[0].kind == "email"
    assert all(not rows[i].more for i in range(33, 63))


def test_redaction(make_docs):
    texts = learning_texts()
    docs = make_docs([*texts, "call +1 (555) 123-4567 or 4111111111111111", None, ""])
    for sent in (100_000, -1):
        rows = {r.doc_id: r.text for r in pii.redact(docs, sent_patterns=sent).collect()}
        assert rows[0] == "please write to [EMAIL] today" and rows[31] == "please write to [EMAIL] today"
        assert rows[40] == texts[40] and rows[63] == "call [PHONE] or [CARD]" and rows[64] is None and rows[65] == ""


def test_empty(make_docs):
    assert pii.found_table(make_docs(["a"]).limit(0)).collect() == []


def test_secrets_are_found_by_their_contexts(make_docs):
    """Long mixed tokens after 'token = "' are seeds; shorter ones there are found, and the same kind of token elsewhere is left alone."""
    import random

    rng = random.Random(3)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 4)) + "a1b2"
    texts = [f'some words {rng.random()} token = "{key(40)}" and more' for _ in range(30)] + ['then TOKEN = "ab12cd34"!! end'] + [f"commit {key(40)}x of page {i}" for i in range(3)]
    rows = {r.doc_id: r for r in pii.found_table(make_docs(texts)).collect()}
    for i in range(31):
        (span,) = [s.split(":") for s in rows[i].spans.split(",") if s.startswith("secret")]
        assert texts[i][int(span[1]) - 1] == '"' and texts[i][int(span[2])] == '"' and rows[i].n_spans == 1 + rows[i].n_card
    assert all("secret" not in rows[i].spans for i in range(31, 34))


def test_contexts_of_long_words():
    text = "x" * 60 + " token 12345 " + "y" * 60
    assert pii.contexts(text, 67, 72) == ["w token _ \u2026", "f token 9", "l \u2026 token", "t ^ \u2026 token"]
    assert pii.contexts("12345", 0, 5) == ["w ^ _ $", "f ^ 9", "l ^ ^", "t ^ ^ ^"]
