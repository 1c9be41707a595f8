"""Text search: postings, term-frequency and TF-IDF scores, matches with context, prefixes, tags and summaries."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: English words that search leaves out
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were", "will", "with", "but", "not", "you")


def terms(s: Column, least: int = 2, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-cased runs of letters and digits of ``least`` characters or more, but for stop words."""
    found = F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= least)
    return F.filter(found, lambda w: ~w.isin(*stop)) if stop else found


def postings(docs: DataFrame, id: str, *fields: str, stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    """term, id, tf over the fields together: the inverted index, one aggregation."""
    text = F.concat_ws(" ", *fields)
    return docs.select(id, F.explode(terms(text, stop=stop)).alias("term")).groupBy("term", id).agg(F.count(F.lit(1)).alias("tf"))


def query_terms(query: str, stop: Sequence[str] = STOP_WORDS) -> list[str]:
    return [w for w in dict.fromkeys(re.split(r"[^\w]+|_", query.lower())) if len(w) >= 2 and w not in stop]


def search_tf(docs: DataFrame, id: str, fields: Sequence[str], query: str, limit: int | None = None) -> DataFrame:
    """id and score, the summed frequencies of the query's terms; ties by id. Rows without a term are cut before they are split."""
    found = query_terms(query)
    if not found:
        return docs.select(id, F.lit(0).cast("long").alias("score")).limit(0)
    hits = F.filter(terms(F.concat_ws(" ", *fields)), lambda w: w.isin(*found))
    ranked = docs.select(id, F.size(hits).cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), id)
    return ranked if limit is None else ranked.limit(limit)


def search_boolean(docs: DataFrame, id: str, text: str, words: Sequence[str], every: bool = True) -> DataFrame:
    """Ids of rows with all, or any, of the words."""
    have = F.array_distinct(terms(F.col(text), 1, ()))
    tests = [F.array_contains(have, w.lower()) for w in words]
    keep = tests[0]
    for t in tests[1:]:
        keep = keep & t if every else keep | t
    return docs.where(keep).select(id)


def occurrences(s: Column, word: str) -> Column:
    low = F.lower(s)
    return (F.length(low) - F.length(F.replace(low, F.lit(word.lower()), F.lit("")))) / len(word)


def search_fields(docs: DataFrame, id: str, query: str, weights: dict[str, float], least: float = 0.0, limit: int = 20) -> DataFrame:
    """Score: occurrences of each query word by the weight of the field they stand in."""
    words = [w for w in query.lower().split() if w]
    score = sum((F.coalesce(occurrences(F.col(f), w), F.lit(0.0)) * k for f, k in weights.items() for w in words), F.lit(0.0))
    return docs.select(id, score.alias("score")).where((F.col("score") > 0) & (F.col("score") >= least)).orderBy(F.desc("score"), id).limit(limit)


def matches_with_context(docs: DataFrame, id: str, text: str, query: str, around: int = 30, whole: bool = False) -> DataFrame:
    """id, at (offset) and context of every occurrence, without case, overlapping ones too."""
    q = query.lower()
    low = F.lower(F.col(text))
    last = F.length(low) - len(q)
    at = F.when(last < 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(last, F.lit(0))))
    hit = lambda i: F.substring(low, i + 1, F.lit(len(q))) == q
    rows = docs.where(F.contains(low, F.lit(q))).select(id, text, F.explode(F.filter(at, hit)).alias("at"))
    if whole:
        edge = lambda p: ~F.coalesce(F.substring(F.col(text), p, F.lit(1)).rlike(r"[\p{L}\p{N}_]"), F.lit(False))
        rows = rows.where(((F.col("at") == 0) | edge(F.col("at"))) & edge(F.col("at") + len(q) + 1))
    start = F.greatest(F.col("at") - around, F.lit(0))
    return rows.select(id, "at", F.substring(F.col(text), start + 1, F.col("at") - start + len(q) + around).alias("context"))


def count_by_row(docs: DataFrame, id: str, text: str, query: str) -> DataFrame:
    """id and how often the query occurs, rows without it left out."""
    return docs.select(id, occurrences(F.col(text), query).cast("long").alias("count")).where("count > 0")


def idf_table(docs: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, term, tf) with tf the share of the row's terms, and (term, idf) with idf = ln((N + 1) / (df + 1)) + 1."""
    tokens = F.filter(F.split(F.lower(F.regexp_replace(text, r"[^A-Za-z0-9\s]", " ")), r"\s+"), lambda w: w != "")
    rows = docs.select(id, tokens.alias("_t"))
    tf = rows.select(id, F.size("_t").alias("_n"), F.explode("_t").alias("term")).groupBy(id, "term", "_n").agg(F.count(F.lit(1)).alias("_c")).select(id, "term", (F.col("_c") / F.col("_n")).alias("tf"))
    n = docs.agg(F.count(F.lit(1))).scalar()
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("_df")).select("term", (F.log((n + 1) / (F.col("_df") + 1)) + 1).alias("idf"))
    return tf, df


def tfidf(docs: DataFrame, id: str, text: str) -> DataFrame:
    """id, term and weight: term frequencies joined with the idf of their terms; a hot term is split by the adaptive join."""
    tf, idf = idf_table(docs, id, text)
    return tf.join(idf, "term").select(id, "term", (F.col("tf") * F.col("idf")).alias("weight"))


def with_prefix(words: DataFrame, word: str, weight: str, prefix: str, limit: int) -> DataFrame:
    """The heaviest words with a prefix; the prefix test reaches the scan."""
    return words.where(F.col(word).startswith(prefix)).orderBy(F.desc(weight), word).limit(limit)


def longest_prefix(keys: Sequence[str], s: Column) -> Column:
    """The longest of the keys (a written list) that the text starts with, or null."""
    return F.array_max(F.filter(F.array(*[F.struct(F.lit(len(k)).alias("n"), F.lit(k).alias("k")) for k in keys]), lambda x: F.startswith(s, x["k"])))["k"]


def fuzzy_words(words: DataFrame, word: str, query: str, distance: int) -> DataFrame:
    """Words within an edit distance, nearest first; the bounded distance stops early."""
    d = F.levenshtein(F.col(word), F.lit(query), distance)
    return words.withColumn("distance", d).where("distance >= 0").orderBy("distance", word)


def extract_tags(docs: DataFrame, id: str, text: str, n: int, least: int = 4, stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    """The n most frequent words of each row, of ``least`` letters or more, ties in word order."""
    counts = docs.select(id, F.explode(terms(F.col(text), least, stop)).alias("tag")).groupBy(id, "tag").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(id).orderBy(F.desc("count"), "tag"))).where(F.col("rank") <= n)


def summarize(docs: DataFrame, id: str, text: str, n: int) -> DataFrame:
    """The n sentences of each row with the highest sum of word frequencies, the first weighed 1.5 and the last 1.2, in order."""
    parts = F.filter(F.split(F.col(text), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    rows = docs.select(id, F.size(parts).alias("_n"), F.posexplode(parts).alias("at", "sentence"))
    words = rows.select(id, "at", F.explode(terms(F.col("sentence"))).alias("w"))
    freq = words.groupBy(id, "w").agg(F.count(F.lit(1)).alias("f"))
    score = words.join(freq, [id, "w"]).groupBy(id, "at").agg(F.sum("f").alias("s"))
    scored = rows.join(score, [id, "at"], "left").withColumn("score", F.coalesce("s", F.lit(0)) * F.when(F.col("at") == 0, 1.5).when(F.col("at") == F.col("_n") - 1, 1.2).otherwise(1.0))
    best = scored.withColumn("_k", F.row_number().over(Window.partitionBy(id).orderBy(F.desc("score"), "at"))).where(F.col("_k") <= n)
    return best.groupBy(id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "sentence"))), lambda x: x["sentence"]), " ").alias("summary"))
