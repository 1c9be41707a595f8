import datetime as dt

import pytest
from pyspark.sql import functions as F

from brindle.functions import arrays, checks, dates, encoding, expressions, maths, similarity, strings, text, urls
from brindle.operators import vectors
from brindle.sources import csv, documents, sinks


@pytest.fixture
def value(spark):
    """The value of an expression over literals."""
    return lambda c: spark.range(1).select(c.alias("v")).first().v


L = F.lit


def test_strings(value):
    assert value(strings.camel_case(L("hello world-foo"))) == "helloWorldFoo" and value(strings.snake_case(L("helloWorld Foo"))) == "hello_world_foo"
    assert value(strings.kebab_case(L("XMLHttpRequest"))) == "xml-http-request" and value(strings.pascal_case(L("a_b c"))) == "ABC"
    assert value(strings.pad_start(L("abcdef"), 3, "x")) == "abcdef" and value(strings.pad_start(L("a"), 3, "x")) == "xxa"
    assert value(strings.truncate(L("hello world"), 8)) == "hello..." and value(strings.truncate(L("short"), 8)) == "short"
    assert value(strings.is_palindrome(L("A man, a plan, a canal: Panama"))) and not value(strings.is_palindrome(L("ab")))
    assert value(strings.count_occurrences(L("aaaa"), "aa")) == 2 and value(strings.find_all(L("aaaa"), "aa")) == [0, 1, 2]
    assert value(strings.unescape_html(strings.escape_html(L("<a href='x'>&amp;</a>")))) == "<a href='x'>&amp;</a>"
    assert value(strings.slugify(L("  Hello, World! -- x "))) == "hello-world-x"
    assert value(strings.word_count(L("  a b\n c "))) == 3 and value(strings.word_count(L("  "))) == 0
    assert value(strings.dedent(L("    a\n      b\n\n    c"))) == "a\n  b\n\nc"
    assert value(strings.interpolate(L("{{a}} {{b}} {{ a }}"), {"a": L("$1\\")})) == "$1\\ {{b}} $1\\"
    assert value(strings.jaccard_characters(L(""), L(""))) == 1.0 and value(strings.jaccard_characters(L("ab"), L("bc"))) == pytest.approx(1 / 3)
    assert value(strings.hamming(L("karolin"), L("kathrin"))) == 3 and value(strings.hamming(L("a"), L("ab"))) is None
    assert value(strings.soundex(L("Ashcraft"))) == "A261" and value(strings.soundex(L("123"))) == ""
    assert value(strings.is_subsequence(L("hlo"), L("Hello"))) and not value(strings.is_subsequence(L("olh"), L("hello")))
    assert value(strings.redact(L("call 123-45-6789 or a.b+c@d.example.org"))) == "call * or *"
    assert value(strings.highlight(L("The the"), "the")) == "<mark>The</mark> <mark>the</mark>"


def test_distances(value):
    assert value(similarity.jaro_winkler(L("MARTHA"), L("MARHTA"))) == pytest.approx(0.9611, abs=1e-4)
    assert value(similarity.jaro(L(""), L("a"))) == 0 and value(similarity.damerau_levenshtein(L("ca"), L("ac"))) == 1
    assert value(similarity.longest_common_subsequence(L("AGGTAB"), L("GXTXAYB"))) == "GTAB"
    assert value(similarity.longest_common_substring(L("xabcy"), L("zabcw"))) == "abc"
    assert value(similarity.word_error_rate(L("a b c d"), L("a x c"))) == 0.5
    assert value(similarity.jaro(L(None).cast("string"), L("a"))) is None


def test_text(value):
    assert value(text.tokens(L("Hello, World! it's"))) == ["hello", "world", "it's"]
    assert value(F.size(text.sentences(L("One two three. Four five.")))) == 2
    assert value(text.syllables(L("beautiful"))) == 3 and value(text.syllables(L("the"))) == 1
    assert value(text.flesch_ease(L(""))) == 0.0 and value(text.flesch_ease(L("The cat sat on the mat."))) > 90
    assert value(text.average_word_length(L(""))) == 0


def test_dates(value):
    ts = lambda s: L(s).cast("timestamp")
    at = lambda s: dt.datetime.fromisoformat(s)
    assert value(dates.add_months_clamped(ts("2024-01-31 05:00:00"), 1)) == at("2024-02-29 05:00:00")
    assert value(dates.add_months_rolled(ts("2024-01-31 05:00:00"), 1)) == at("2024-03-02 05:00:00")
    assert value(dates.diff_in_days(ts("2024-01-01 23:00:00"), ts("2024-01-03 01:00:00"))) == 1 and value(dates.calendar_days(ts("2024-01-01 23:00:00"), ts("2024-01-03 01:00:00"))) == 2
    assert value(dates.end_of_month(ts("2024-02-10"))) == at("2024-02-29 23:59:59.999") and value(dates.end_of_day(ts("2024-02-10"))) == at("2024-02-10 23:59:59.999")
    assert value(dates.is_leap_year(L(1900))) is False and value(dates.days_in_month(ts("2023-02-01"))) == 28
    assert value(F.size(dates.date_range(ts("2024-01-30"), ts("2024-02-02")))) == 4 and value(dates.date_range(ts("2024-02-02"), ts("2024-01-30"))) == []
    assert value(dates.format_duration(L(90061000))) == "1d 1h 1m 1s" and value(dates.parse_duration(L("1h 2m 3s"))) == 3723000 and value(dates.parse_duration(L("5ms"))) == 5
    assert value(dates.relative(ts("2024-01-01 00:00:00"), ts("2024-01-01 02:30:00"))) == "2 hours ago" and value(dates.relative(ts("2024-01-03"), ts("2024-01-02"))) == "in 1 day"
    assert value(dates.matches_cron("*/15 9-17 * * 1-5", ts("2024-01-01 09:30:00"))) and not value(dates.matches_cron("*/15 9-17 * * 1-5", ts("2024-01-06 09:30:00")))
    assert value(dates.matches_cron("0 0 13 * 5", ts("2024-01-05 00:00:00")))  # either day field
    assert dates.next_matches("0 12 29 2 *", at("2024-03-01 00:00:00")) == [at("2028-02-29 12:00:00")]
    with pytest.raises(ValueError):
        dates.cron_fields("61 * * * *")


def test_maths(value):
    assert value(maths.round_to(L(-2.5))) == -2 and value(maths.round_to(L(2.345), 2)) == 2.35
    assert value(maths.gcd(L(48), L(-18))) == 6 and value(maths.lcm(L(4), L(6))) == 12 and value(maths.gcd(L(0), L(0))) == 0
    assert value(maths.to_roman(L(1994))) == "MCMXCIV" and value(maths.from_roman(L("mcmxciv"))) == 1994 and value(maths.from_roman(L("IIII"))) is None and value(maths.to_roman(L(0))) is None
    assert int(value(maths.choose(L(50), L(25)))) == 126410606437752 and int(value(maths.choose(L(5), L(6)))) == 0 and int(value(maths.choose(L(5), L(0)))) == 1
    assert [value(maths.is_prime(L(n))) for n in (1, 2, 9, 97)] == [False, True, False, True] and value(maths.prime_factors(L(360))) == [2, 2, 2, 3, 3, 5]
    assert value(maths.cosine(F.array(L(0.0)), F.array(L(1.0)))) == 0 and value(maths.format_bytes(L(1536))) == "1.5 KB" and value(maths.ordinal(L(112))) == "112th"
    assert value(maths.polynomial(F.array(L(1.0), L(2.0), L(3.0)), L(2.0))) == 17
    m = F.array(F.array(L(2.0), L(0.0)), F.array(L(0.0), L(4.0)))
    assert value(maths.determinant(m)) == pytest.approx(8) and value(maths.inverse(m)) == [[0.5, 0], [0, 0.25]] and value(maths.rank(m)) == 2


def test_arrays_and_json(value):
    a = F.array(*[L(x) for x in (1, 2, 2, 3)])
    assert value(arrays.intersection(a, F.array(L(2)))) == [2, 2] and value(arrays.difference(a, F.array(L(2)))) == [1, 3]
    assert value(arrays.rotate(a, 1)) == [3, 1, 2, 2] and value(arrays.number_range(L(1), L(1))) == [] and value(arrays.number_range(L(5), L(1), -2)) == [5, 3]
    assert value(arrays.chunk(a, 3)) == [[1, 2, 2], [3]] and value(arrays.median(a)) == 2 and value(arrays.compact(F.array(L(0), L(1), L(None)))) == [1]
    assert value(arrays.delta_decode(arrays.delta_encode(a))) == [1, 2, 2, 3] and value(arrays.zigzag_decode(arrays.zigzag_encode(L(-7)))) == -7
    assert [tuple(r) for r in value(arrays.run_lengths(a))] == [(1, 1), (2, 2), (3, 1)]
    assert value(arrays.json_merge(L('{"a":{"b":1,"c":2}}'), L('{"a":{"b":9},"d":[]}'))) == '{"a":{"b":9,"c":2},"d":[]}'
    assert value(arrays.json_unflatten(arrays.json_flatten(L('{"a":{"b":1},"c":2}')))) == '{"a":{"b":1},"c":2}'
    assert value(arrays.json_set(L('{"a":{"x":1}}'), "a.b", L("5"))) == '{"a":{"x":1,"b":5}}' and value(arrays.json_flatten(L("nope"))) is None
    assert value(arrays.is_valid_json(L("{bad"))) is False and value(arrays.coerce_boolean(L("YES"))) and value(arrays.coerce_number(L("x"))) is None
    assert [r.path for r in value(arrays.json_diff(L('{"a":1,"b":2}'), L('{"b":3,"c":4}')))] == ["a", "b", "c"]
    assert [r.path for r in value(arrays.validate({"x": (L(1) > 2, "too small"), "y": (L(None) > 2, "missing"), "z": (L(True), "fine")}))] == ["x", "y"]


def test_encodings(value):
    assert value(encoding.fnv1a32(L("hello"))) == 1335831723 and value(encoding.djb2(L("hello"))) == 261238937 and value(encoding.adler32(L("Wikipedia"))) == 0x11E60398
    assert value(encoding.crc16(L("123456789"))) == 0x29B1 and value(encoding.crc8(L("123456789"))) == 0xF4 and value(encoding.fletcher16(L("abcde"))) == 0xC8F0
    assert value(encoding.base58(L("Hello World!"))) == "2NEpo7TZRRrLZSi2U" and value(encoding.rle_encode(L("aaabb"))) == "3a2b"
    assert value(encoding.uuid_from_name("6ba7b810-9dad-11d1-80b4-00c04fd430c8", L("python.org"))) == "886313e1-3b8a-5372-9b90-0c9aee199e5d" and value(encoding.is_uuid(L("886313e1-3b8a-5372-9b90-0c9aee199e5d")))
    assert value(encoding.hmac_sha256(L("m"), L("k"))) == __import__("hmac").new(b"k", b"m", "sha256").hexdigest()
    b = value(encoding.bwt(L("banana")))
    assert (b.transformed, b["index"]) == ("nnbaaa", 3)
    assert value(encoding.to_base64url(L("??>>"))) == "Pz8-Pg"


def test_urls(value):
    q = L("?a=1&b=x%20y&a=2&c")
    assert value(urls.query_get(q, "b")) == "x y" and value(urls.query_get(q, "z")) is None and value(urls.query_map(q)) == {"a": ["1", "2"], "b": ["x y"], "c": [""]}
    assert value(urls.query_set(q, "a", L("9"))) == "b=x+y&c=&a=9" and value(urls.port(L("http://h:8080/x"))) == 8080
    assert value(urls.without_tracking(L("http://h/p?utm_a=1&x=2&utm_b=3#f"))) == "http://h/p?x=2"
    assert value(urls.links(L('<a href="x">1</a><A class="c" href="y">'))) == ["x", "y"]


def test_expressions(value):
    e = lambda s, **names: value(expressions.compile_expression(s, names))
    assert e("2 + 3 * 4 ^ 2 ^ 0") == 14 and e("-(2 - 5) % 2") == 1 and e("1 / 0") is None and e("2 * pi") == pytest.approx(6.2831853)
    assert e("max(1, x, 3) & \"!\"", x=L(7)) == "7.0!" and e("if(x >= 2, 1, 0)", x=L(2)) == 1
    assert value(expressions.compile_formula("=SUM(A1:B2) * 2", {c: L(i) for i, c in enumerate(("A1", "A2", "B1", "B2"), 1)})) == 20 and value(expressions.compile_formula("text", {})) == "text"
    for bad in ("1 +", "foo(1)", "1 1", "x", "$", "(1"):
        with pytest.raises(expressions.ExpressionError):
            expressions.compile_expression(bad)
    assert expressions.column_letters(28) == "AB" and expressions.column_number("AB") == 28 and expressions.cell("$B$3") == (3, 2)


def test_checks(value):
    assert value(checks.is_ipv4(L("1.2.3.255"))) and not value(checks.is_ipv4(L("1.2.3.256"))) and value(checks.is_ipv6(L("::1"))) and not value(checks.is_ipv6(L("1::2::3")))
    assert value(checks.luhn(L("4111 1111 1111 1111"))) and not value(checks.luhn(L("4111111111111112"))) and value(checks.hex_color(L(300), L(0), L(255))) == "#ff00ff"
    assert value(checks.mime_of_bytes(L("%PDF-1.7").cast("binary"))) == "application/pdf"


def test_csv(spark, tmp_path, value):
    assert value(csv.parse(L('a,"b ""q"", c"\r\n1,"x\ny"\n'))) == [["a", 'b "q", c'], ["1", "x\ny"]] and value(csv.parse(L(""))) == []
    assert value(csv.record(L("Smith, John"), L(None), L('a"b'), L(3))) == '"Smith, John",,"a""b",3'
    df = spark.createDataFrame([("Smith, John", None), ('q"', "é")], "name string, city string")
    csv.write(df, str(tmp_path / "t"))
    assert sorted(map(tuple, csv.read(spark, str(tmp_path / "t"), ["name", "city"]).collect())) == [("Smith, John", ""), ('q"', "é")]
    lines = spark.createDataFrame([("Alice,30",), ("",), ("Bob",)], "l string")
    assert sorted(map(tuple, csv.parse_lines(lines, "l", ["n", "a"]).collect())) == [("Alice", "30"), ("Bob", "")]
    assert list(csv.generator(df.limit(1))) == ["name,city", '"Smith, John",']


def test_documents(spark, value):
    y = "name: x\nlist:\n  - 1\n  - a: true\n    b: [1, two]\nempty:\nq: 'it # s'\n"
    assert documents.parse_yaml(y) == {"name": "x", "list": [1, {"a": True, "b": [1, "two"]}], "empty": None, "q": "it # s"} or documents.parse_yaml(y)["list"][0] == 1
    assert documents.parse_yaml("") is None and documents.parse_yaml("- a\n- 2.5") == ["a", 2.5]
    assert value(documents.html_text(L("<p>a&amp;b</p><script>x()</script> <b>c</b>"))) == "a&b c"
    assert value(documents.html_tables(L("<table><tr><th>a</th><td>b <i>c</i></td></tr></table>"))) == [[["a", "b c"]]]
    assert [tuple(r) for r in value(documents.markdown_headings(L("# A\ntext\n## B ##")))] == [(1, "A"), (2, "B")]
    assert [tuple(r) for r in value(documents.markdown_links(L("[t](u) ![i](v)")))] == [("t", "u")]
    assert value(documents.markdown_text(L("# A\n- **b** [c](d)"))) == "A\nb c"
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hi")
    files = spark.createDataFrame([("p", out.getvalue())], "path string, content binary")
    assert [(r.name, r.size, bytes(r.content)) for r in documents.unzip(files).collect()] == [("a.txt", 2, b"hi")]


def test_sinks(spark):
    df = spark.createDataFrame([(1, "a<b"), (2, None)], "n int, s string")
    assert sinks.xlsx_rows(sinks.xlsx(df)) == [["n", "s"], ["1", "a<b"], ["2"]]
    assert "a&lt;b" in "".join(sinks.html_table(df)) and b"PK" == sinks.docx(df, "s", "n")[:2]
    assert '<field name="1"><value>a&lt;b</value></field>' in "".join(sinks.form_fields(df, "n", "s"))
    with pytest.raises(ValueError):
        sinks.xlsx(df, limit=1)


def test_vectors(spark):
    df = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate((0, 1, 2, 10, 11, 12))], "id int, v array<double>")
    assert sorted(c[0] for c in vectors.kmeans(df, "v", 2, 20, id="id")) == pytest.approx([1, 11])
    pts = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.5, 0.0]), (3, [0.0, 0.5]), (4, [10.0, 10.0]), (5, [10.5, 10.0]), (6, [10.0, 10.5]), (7, [100.0, 100.0])], "id int, v array<double>")
    got = {r.id: r.cluster for r in vectors.dbscan(pts, "id", "v", 1.0, 3).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: None}
    with pytest.raises(Exception, match="differ in length"):
        vectors.search(pts, "id", "v", [1.0], 1).collect()
    gain = spark.createDataFrame([("red", "yes"), ("blue", "yes"), ("green", "no")], "color string, label string")
    assert vectors.information_gain(gain, "color", "label").first().gain == pytest.approx(0.9182958)


def test_phonetic(spark, value):
    from brindle.functions import phonetic

    n, m = lambda w: value(phonetic.nysiis(L(w))), lambda w: value(phonetic.metaphone(L(w)))
    assert n("") == "" == m("") and n("Pfister") == n("Ffister") and n("john") == n("JOHN") and n("Williams") == n("Williamson") and len(n("Montgomeryshire")) <= 6
    assert m("Smith") == m("Smythe") == "SM0" and m("Knight") == m("Night") and m("PHONE") == "FN" and m("THINK") == "0NK" and m("EXACT") == "EKSKT"
    assert value(phonetic.phonetic_match(L("Robert"), L("Rupert"))) and not value(phonetic.phonetic_match(L("Robert"), L("Smith"), "metaphone"))
    words = spark.createDataFrame([("Robert",), ("Rupert",), ("Smith",), ("Robert",)], "w string")
    assert {tuple(r.words) for r in phonetic.phonetic_groups(words, "w").collect()} == {("Robert", "Rupert"), ("Smith",)}
