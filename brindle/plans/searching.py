"""Queries of search, vectors and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search, vectors
from .base import Tables, query

_STOP = "(" + ", ".join(f"'{w}'" for w in search.STOP_WORDS) + ")"
_TERMS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


@query(f"SELECT doc_id, score FROM (SELECT doc_id, len(list_filter({_TERMS}, lambda w: w IN ('thing', 'rent', 'est'))) AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def search_frequency(t: Tables):
    return search.search_tf(t.documents, "doc_id", ["text"], "Thing of the rent est", 20)


@query(f"SELECT doc_id FROM documents WHERE list_contains({_TERMS}, 'the') AND list_contains({_TERMS}, 'rent')")
def search_and(t):
    return search.search_boolean(t.documents, "doc_id", "text", ["the", "Rent"])


@query(f"SELECT doc_id FROM documents WHERE list_contains({_TERMS}, 'der') OR list_contains({_TERMS}, 'rent')")
def search_or(t):
    return search.search_boolean(t.documents, "doc_id", "text", ["der", "Rent"], every=False)


@query("SELECT doc_id, score FROM (SELECT doc_id, 3.0 * (length(lower(lang)) - length(replace(lower(lang), 'en', ''))) / 2 + 1.0 * (length(lower(text)) - length(replace(lower(text), 'en', ''))) / 2 AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def search_weighted(t):
    return search.search_fields(t.documents, "doc_id", "en", {"lang": 3.0, "text": 1.0})


@query("SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'tion', ''))) // 4 AS count FROM documents WHERE contains(lower(text), 'tion')")
def search_counts(t):
    return search.count_by_row(t.documents, "doc_id", "text", "tion")


@query("SELECT doc_id, i - 1 AS at, substr(text, greatest(i - 30, 1), i - greatest(i - 30, 1) + 36) AS context FROM (SELECT doc_id, text, unnest(list_filter(range(1, length(text) - 5 + 1), lambda i: lower(substr(text, i, 6)) = 'renten')) AS i FROM documents WHERE contains(lower(text), 'renten'))")
def search_context(t):
    return search.matches_with_context(t.documents, "doc_id", "text", "Renten").withColumn("at", F.col("at").cast("long"))


@query(f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) WHERE length(term) >= 2 AND term NOT IN {_STOP} GROUP BY 1, 2")
def search_postings(t):
    """The index of all documents."""
    return search.postings(t.documents, "doc_id", "text")


@query("WITH w AS (SELECT conv_id * 1000 + turn AS id, regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z0-9\\s]', ' ', 'g')), '[^\\s]+') AS t FROM conversations), f AS (SELECT id, term, count(*)::DOUBLE / any_value(n) AS tf FROM (SELECT id, len(t) AS n, unnest(t) AS term FROM w) GROUP BY 1, 2), d AS (SELECT term, ln(((SELECT count(*) FROM w) + 1.0) / (count(*) + 1)) + 1 AS idf FROM f GROUP BY 1) SELECT id, term, round(tf * idf, 6) AS weight FROM f JOIN d USING (term)")
def search_tfidf(t):
    rows = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return search.tfidf(rows, "id", "text").withColumn("weight", F.round("weight", 6))


@query("SELECT p_name, p_retailprice FROM part WHERE starts_with(p_name, 'part') ORDER BY p_retailprice DESC, p_name LIMIT 10")
def search_prefix(t):
    return search.with_prefix(t.part.select("p_name", "p_retailprice"), "p_name", "p_retailprice", "part", 10)


@query("SELECT n_name, levenshtein(n_name, 'NATION_1') AS distance FROM nation WHERE levenshtein(n_name, 'NATION_1') <= 2 ORDER BY 2, 1")
def search_fuzzy(t):
    return search.fuzzy_words(t.nation.select("n_name"), "n_name", "NATION_1", 2).withColumn("distance", F.col("distance").cast("long"))


@query(f"SELECT doc_id, tag, count, CAST(rank AS INTEGER) AS rank FROM (SELECT doc_id, tag, count(*) AS count, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, tag) AS rank FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS tag FROM documents) WHERE length(tag) >= 4 AND tag NOT IN {_STOP} GROUP BY 1, 2) WHERE rank <= 3")
def text_tags(t):
    return search.extract_tags(t.documents, "doc_id", "text", 3)


@query()
def text_summary(t):
    return search.summarize(t.documents, "doc_id", "text", 2)


_Q = "[sin(i + 1) FOR i IN range(64)]"


def _q():
    import math

    return [math.sin(i + 1) for i in range(64)]


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q}) DESC, vec_id LIMIT 15")
def vector_search(t):
    return vectors.search(t.embeddings, "vec_id", "embedding", _q(), 15).withColumn("score", F.round("score", 6))


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], {_Q}) >= 0.1")
def vector_threshold(t):
    return vectors.search_threshold(t.embeddings, "vec_id", "embedding", _q(), 0.1).withColumn("score", F.round("score", 6))


@query("SELECT query, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT q.vec_id AS query, d.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) DESC, d.vec_id) AS rank FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0) WHERE rank <= 5")
def vector_search_many(t):
    """Every fiftieth row as a query, against all rows."""
    queries = t.embeddings.where("vec_id % 50 = 0")
    return vectors.search_many(queries, t.embeddings, "vec_id", "embedding", 5).withColumn("score", F.round("score", 6))


@query(f"SELECT label, count(*) AS votes FROM (SELECT label, list_distance(embedding::DOUBLE[], {_Q}) AS d FROM embeddings ORDER BY d, vec_id LIMIT 9) GROUP BY label ORDER BY votes DESC, sum(d), label LIMIT 1")
def vector_knn(t):
    return vectors.knn_predict(t.embeddings, _q(), "embedding", "label", 9, "vec_id")


@query()
def cluster_kmeans(t):
    centroids = vectors.kmeans(t.embeddings, "embedding", 5, 5, id="vec_id")
    return t.embeddings.select("vec_id", vectors.nearest_centroid(centroids, F.col("embedding")).alias("cluster"))


@query()
def cluster_dbscan(t):
    points = t.part.select("p_partkey", F.array((F.col("p_size") / 5).cast("double"), (F.col("p_retailprice") / 100).cast("double")).alias("v"))
    return vectors.dbscan(points, "p_partkey", "v", 0.3, 5)


@query("""WITH r AS (SELECT doc_id, lang, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents),
c AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM r) GROUP BY 1, 2), p AS (SELECT lang, count(*) AS docs, sum(len(w)) AS words FROM r GROUP BY 1),
v AS (SELECT count(DISTINCT word) AS v FROM c), s AS (SELECT doc_id, w FROM r),
f AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS word FROM s) GROUP BY 1, 2),
g AS (SELECT doc_id, lang, sum(tf * ln(n + 1.0)) AS gain FROM f JOIN c USING (word) GROUP BY 1, 2),
z AS (SELECT s.doc_id, p.lang, ln(docs / (SELECT sum(docs) FROM p)) + coalesce(gain, 0) - len(s.w) * ln(words + v) AS score FROM s CROSS JOIN p CROSS JOIN v LEFT JOIN g ON g.doc_id = s.doc_id AND g.lang = p.lang)
SELECT doc_id, arg_max(lang, (score, lang)) AS label FROM z GROUP BY 1""")
def learn_naive_bayes(t):
    """Languages of all documents, learnt from all."""
    counts, priors = vectors.naive_bayes_train(t.documents, "text", "lang")
    return vectors.naive_bayes_predict(t.documents, "doc_id", "text", counts, priors).select("doc_id", "label")


_H = "(SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h, any_value(k) AS k, sum(n) AS n FROM (SELECT {k} AS k, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY k)"


@query(f"SELECT round((SELECT h FROM {_H.format(k='1')}) - (SELECT sum(n * h) / sum(n) FROM {_H.format(k='o_orderpriority')}), 8) AS gain")
def learn_information_gain(t):
    return vectors.information_gain(t.orders, "o_orderpriority", "o_orderstatus").select(F.round("gain", 8).alias("gain"))


@query("SELECT event_type, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM (SELECT event_type, user_id % 5 AS b, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def learn_entropy(t):
    return vectors.entropy(t.events.withColumn("b", F.col("user_id") % 5), "b", "event_type").select("event_type", F.round("entropy", 6).alias("entropy"))


@query()
def learn_logistic(t):
    rows = t.part.select("p_partkey", (F.col("p_size") / 50).alias("x"), (F.col("p_size") > 25).cast("int").alias("y"))
    weights = vectors.logistic_fit(rows, ["x"], "y", 1.0, 20)
    return rows.select("p_partkey", F.round(vectors.logistic_probability(["x"], weights), 6).alias("p"))


@query("""WITH s AS (SELECT event_type AS "from", lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS "to" FROM events), n AS (SELECT "from", "to", count(*) AS n FROM s WHERE "to" IS NOT NULL GROUP BY 1, 2) SELECT "from", "to", n, round(n / sum(n) OVER (PARTITION BY "from"), 6) AS p FROM n""")
def learn_markov(t):
    return vectors.markov_transitions(t.events, "event_type", "user_id", "ts", "event_id").withColumn("p", F.round("p", 6))
