"""Text statistics and readability as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(s: Column) -> Column:
    """Lower-cased runs between blanks, without marks at any place, empty ones left out."""
    return F.filter(F.transform(F.split(F.lower(s), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}'_-]", "")), lambda w: w != "")


def sentences(s: Column) -> Column:
    """Parts between runs of . ! ?, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(s, r"[.!?]+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def paragraphs(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, r"\n\s*\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def word_total(s: Column) -> Column:
    return F.size(tokens(s))


def average_word_length(s: Column) -> Column:
    t = tokens(s)
    return ratio(F.aggregate(t, F.lit(0), lambda a, w: a + F.length(w)), F.size(t))


def average_sentence_length(s: Column) -> Column:
    return ratio(F.size(tokens(s)), F.size(sentences(s)))


def syllables(word: Column) -> Column:
    """Groups of vowels, a silent e at the end left off, at least 1; 0 without letters."""
    w = F.regexp_replace(F.lower(word), r"[^a-z]", "")
    stem = F.when(F.length(w) > 3, F.regexp_replace(w, r"(?:[^laeiouy]es|ed|[^laeiouy]e)$", "")).otherwise(w)
    return F.when(w == "", 0).otherwise(F.greatest(F.regexp_count(stem, F.lit("[aeiouy]+")), F.lit(1)))


def syllable_total(s: Column) -> Column:
    return F.aggregate(F.transform(tokens(s), syllables), F.lit(0), lambda a, n: a + n)


def complex_words(s: Column) -> Column:
    """Words of three syllables or more."""
    return F.size(F.filter(tokens(s), lambda w: syllables(w) >= 3))


def flesch_ease(s: Column) -> Column:
    w, n = F.size(tokens(s)), F.size(sentences(s))
    return F.when((w == 0) | (n == 0), 0.0).otherwise(206.835 - 1.015 * w / n - 84.6 * syllable_total(s) / w)


def flesch_kincaid_grade(s: Column) -> Column:
    w, n = F.size(tokens(s)), F.size(sentences(s))
    return F.when((w == 0) | (n == 0), 0.0).otherwise(0.39 * w / n + 11.8 * syllable_total(s) / w - 15.59)


def gunning_fog(s: Column) -> Column:
    w, n = F.size(tokens(s)), F.size(sentences(s))
    return F.when((w == 0) | (n == 0), 0.0).otherwise(0.4 * (w / n + 100 * complex_words(s) / w))


def smog(s: Column) -> Column:
    n = F.size(sentences(s))
    return F.when(n == 0, 0.0).otherwise(1.043 * F.sqrt(complex_words(s) * 30 / n) + 3.1291)


def automated_readability(s: Column) -> Column:
    t = tokens(s)
    w, n = F.size(t), F.size(sentences(s))
    letters = F.aggregate(t, F.lit(0), lambda a, x: a + F.length(x))
    return F.when((w == 0) | (n == 0), 0.0).otherwise(4.71 * letters / w + 0.5 * w / n - 21.43)


def coleman_liau(s: Column) -> Column:
    t = tokens(s)
    w, n = F.size(t), F.size(sentences(s))
    letters = F.aggregate(t, F.lit(0), lambda a, x: a + F.length(x))
    return F.when(w == 0, 0.0).otherwise(0.0588 * 100 * letters / w - 0.296 * 100 * n / w - 15.8)


def reading_minutes(s: Column, per_minute: int = 200) -> Column:
    return F.ceil(F.size(tokens(s)) / per_minute)


def word_frequency(df: DataFrame, text: str, *by: str) -> DataFrame:
    """word and count, over all rows or within ``by``."""
    return df.select(*by, F.explode(tokens(F.col(text))).alias("word")).groupBy(*by, "word").agg(F.count(F.lit(1)).alias("count"))


def top_words(df: DataFrame, text: str, n: int, *by: str) -> DataFrame:
    """The n most frequent words, ties in word order; each task keeps n before the shuffle."""
    counts = word_frequency(df, text, *by)
    if not by:
        return counts.orderBy(F.desc("count"), "word").limit(n)
    return counts.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), "word"))).where(F.col("_n") <= n).drop("_n")
