"""String scalars as Column expressions; the few that need a program are vectorised UDFs in ``similarity``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(s: Column) -> Column:
    """Parts of an identifier or phrase: split at anything but letters and digits, and where a capital follows a small letter."""
    spaced = F.regexp_replace(F.regexp_replace(s, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.regexp_replace(spaced, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))


def camel_case(s: Column) -> Column:
    p = pascal_case(s)
    return F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))


def pascal_case(s: Column) -> Column:
    return F.array_join(F.transform(words(s), _capital), "")


def snake_case(s: Column) -> Column:
    return F.lower(F.array_join(words(s), "_"))


def kebab_case(s: Column) -> Column:
    return F.lower(F.array_join(words(s), "-"))


def title_case(s: Column) -> Column:
    """Each run between blanks with a capital first and small letters after it."""
    return F.initcap(s)


def capitalize(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


def truncate(s: Column, n: int, ellipsis: str = "...") -> Column:
    """At most n characters, the ellipsis among them."""
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, max(0, n - len(ellipsis))), F.lit(ellipsis[:n])))


def pad_start(s: Column, n: int, fill: str = " ") -> Column:
    """Never cuts, unlike lpad."""
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, fill))


def pad_end(s: Column, n: int, fill: str = " ") -> Column:
    return F.when(F.length(s) >= n, s).otherwise(F.rpad(s, n, fill))


def count_occurrences(s: Column, sub: str) -> Column:
    """Non-overlapping; 0 for an empty pattern."""
    if not sub:
        return F.lit(0)
    return ((F.length(s) - F.length(F.replace(s, F.lit(sub), F.lit("")))) / len(sub)).cast("int")


def is_palindrome(s: Column) -> Column:
    """By letters and digits, without case."""
    t = F.lower(F.regexp_replace(s, r"[^A-Za-z0-9]", ""))
    return t == F.reverse(t)


def is_anagram(a: Column, b: Column) -> Column:
    letters = lambda s: F.array_sort(F.split(F.lower(F.regexp_replace(s, r"[^A-Za-z0-9]", "")), ""))
    return letters(a) == letters(b)


def strip_html(s: Column) -> Column:
    return F.regexp_replace(s, r"<[^>]*>", "")


# fixed values: the characters that HTML text escapes, and their entities; & comes first
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def escape_html(s: Column) -> Column:
    for raw, entity in ENTITIES:
        s = F.replace(s, F.lit(raw), F.lit(entity))
    return s


def unescape_html(s: Column) -> Column:
    for raw, entity in reversed(ENTITIES):
        s = F.replace(s, F.lit(entity), F.lit(raw))
    return s


def slugify(s: Column) -> Column:
    """Small letters and digits joined by single hyphens; accents are kept off by the caller's normalisation."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), r"[^a-z0-9\s_-]", ""), r"[\s_-]+", "-"), F.lit("-"))


def word_count(s: Column) -> Column:
    t = F.regexp_replace(s, r"^\s+|\s+$", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def line_count(s: Column) -> Column:
    return F.when(s == "", 0).otherwise(F.size(F.split(s, "\n")))


def trim_lines(s: Column) -> Column:
    return F.array_join(F.transform(F.split(s, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), "\n")


def dedent(s: Column) -> Column:
    """Without the indentation that all lines with text share."""
    lines = F.split(s, "\n")
    indents = F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.length(F.regexp_extract(x, r"^[ \t]*", 0)))
    n = F.coalesce(F.array_min(indents), F.lit(0))
    return F.array_join(F.transform(lines, lambda x: F.substring(x, n + 1, F.length(x))), "\n")


def interpolate(template: Column, values: Mapping[str, Column]) -> Column:
    """{{name}} replaced by its value as text; unknown names stay."""
    for name, value in values.items():
        template = F.regexp_replace(template, F.lit(r"\{\{\s*" + name + r"\s*\}\}"), F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"([\\$])", r"\\$1"))
    return template


def is_email(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit(False))


def is_url(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^(?i)https?://[^\s/?#]+[^\s]*$"), F.lit(False))


def normalize_whitespace(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"\s+", " "), "^ | $", "")


def sanitize_filename(s: Column) -> Column:
    """Without characters that file systems refuse, dots at the ends, and past 255 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(s, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^\.+|[. ]+$", ""), 1, 255)


def highlight(s: Column, term: str, tag: str = "mark") -> Column:
    """Each occurrence, without case, wrapped in a tag."""
    import re

    return F.regexp_replace(s, "(?i)" + re.escape(term), f"<{tag}>$0</{tag}>") if term else s


def find_all(s: Column, pattern: str) -> Column:
    """Offsets of all occurrences, overlapping ones too."""
    if not pattern:
        return F.array().cast("array<int>")
    last = F.length(s) - len(pattern)
    return F.when(last < 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(s, i + 1, F.lit(len(pattern))) == pattern))


def hamming(a: Column, b: Column) -> Column:
    """Null for unlike lengths."""
    return F.when(F.length(a) == F.length(b), F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d)))


def jaccard_characters(a: Column, b: Column) -> Column:
    """Over the sets of characters; 1 if both are empty."""
    x, y = F.split(a, ""), F.split(b, "")
    n = F.size(F.array_union(x, y))
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.size(F.array_intersect(x, y)) / n)


def bigrams(s: Column) -> Column:
    n = F.length(s)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2))))


def jaccard_bigrams(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(bigrams(a)), F.array_distinct(bigrams(b))
    n = F.size(F.array_union(x, y))
    return F.when(n == 0, F.when(a == b, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(x, y)) / n)


def similarity_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / n)


def soundex(s: Column) -> Column:
    """Empty for texts without letters."""
    letters = F.regexp_replace(s, r"[^A-Za-z]", "")
    return F.when(letters == "", "").otherwise(F.soundex(letters))


def is_subsequence(query: Column, text: Column) -> Column:
    """Whether the query's characters stand in the text in order, without case."""
    rest = F.aggregate(F.split(F.lower(query), ""), F.lower(text), lambda t, c: F.when(t.isNull() | (c == ""), t).when(F.instr(t, c) > 0, F.substring(t, F.instr(t, c) + 1, F.length(t))))
    return rest.isNotNull()


# fixed values: personal data patterns for redaction, by kind
REDACTIONS = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}\b",
    "phone": r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "creditCard": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "date": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    "ipv4": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}


def redact(s: Column, kinds: Mapping[str, str] | None = None, mask: str = "*") -> Column:
    """All matches of the kinds replaced by the mask."""
    for pattern in (kinds or REDACTIONS).values():
        s = F.regexp_replace(s, pattern, mask)
    return s


def count_matches(s: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(s, F.lit(pattern)), F.lit(0))
