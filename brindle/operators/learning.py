"""Decision trees, discrete Bayesian networks and text quality heuristics, as aggregations and compiled expressions."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import information_gain


def train_tree(df: DataFrame, attributes: Sequence[str], label: str, depth: int = 4) -> dict | str | None:
    """An ID3 tree: {'attribute': ..., 'most': ..., 'children': {value: tree}} or a label. Each node is a few aggregations of its rows; attributes should have few values."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label).collect()  # one row for each label
    if not counts:
        return None
    most = counts[0][label]
    if len(counts) == 1 or not attributes or depth == 0:
        return most
    gains = [(information_gain(df, a, label).first()["gain"] or 0.0, a) for a in attributes]
    gain, best = max(gains, key=lambda g: (g[0], -list(attributes).index(g[1])))
    if gain <= 1e-12:
        return most
    rest = [a for a in attributes if a != best]
    values = [r[0] for r in df.select(best).distinct().orderBy(best).collect()]  # the attribute's values
    return {"attribute": best, "most": most, "children": {v: train_tree(df.where(F.col(best).eqNullSafe(F.lit(v))), rest, label, depth - 1) for v in values}}


def predict_tree(tree: dict | str | None) -> Column:
    """The tree as one expression; values that a node does not know get its most frequent label."""
    if not isinstance(tree, dict):
        return F.lit(tree)
    out = F.lit(tree["most"])
    for value, child in tree["children"].items():
        out = F.when(F.col(tree["attribute"]).eqNullSafe(F.lit(value)), predict_tree(child)).otherwise(out)
    return out


def bayes_query(network: Mapping[str, tuple[Sequence[str], Mapping[tuple[bool, ...], float]]], variable: str, value: bool, evidence: Mapping[str, bool]) -> float:
    """P(variable = value | evidence) of a small network, variable -> (parents, P(true | parents' values)), by summing over the rest."""
    names = list(network)

    def joint(world: dict[str, bool]) -> float:
        p = 1.0
        for n, (parents, table) in network.items():
            t = table[tuple(world[x] for x in parents)]
            p *= t if world[n] else 1 - t
        return p

    def total(fixed: Mapping[str, bool]) -> float:
        free = [n for n in names if n not in fixed]
        return sum(joint({**fixed, **dict(zip(free, values))}) for values in itertools.product((False, True), repeat=len(free)))

    below = total(evidence)
    return total({**evidence, variable: value}) / below if below and evidence.get(variable, value) == value else 0.0


def perceptron(inputs: Sequence[Column], layers: Sequence[tuple[Sequence[Sequence[float]], Sequence[float]]]) -> list[Column]:
    """The outputs of a network of sigmoid layers (weights, biases) as expressions."""
    values = list(inputs)
    for weights, biases in layers:
        values = [1 / (1 + F.exp(-sum((F.lit(float(w)) * v for w, v in zip(row, values)), F.lit(float(b))))) for row, b in zip(weights, biases)]
    return values


# fixed values: frequent words and own letters of languages
LANGUAGES = {
    "en": (("the", "and", "of", "to", "in", "is", "that", "for"), ""),
    "de": (("der", "die", "und", "das", "ist", "nicht", "ein", "zu"), "äöüß"),
    "fr": (("le", "la", "les", "et", "des", "est", "une", "que"), "àâçéèêëîïôûù"),
    "es": (("el", "la", "los", "que", "del", "las", "por", "una"), "áíóúñ¿¡"),
}


def detect_language(s: Column, least: int = 20) -> Column:
    """The language whose frequent words and letters the text has most of; en for texts under ``least`` characters and without any."""
    words = F.filter(F.split(F.lower(s), r"[^\p{L}]+"), lambda w: w != "")
    n = F.greatest(F.size(words), F.lit(1))
    length = F.greatest(F.length(s), F.lit(1))

    def score(ws: Sequence[str], letters: str) -> Column:
        hits = F.size(F.filter(words, lambda w: w.isin(*ws))) / n
        return hits + F.regexp_count(F.lower(s), F.lit(f"[{letters}]")) / length * 5 if letters else hits + F.lit(0.0)

    scores = [F.struct(score(ws, letters).alias("p"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, (ws, letters)) in enumerate(LANGUAGES.items())]
    return F.when(F.length(s) < least, "en").otherwise(F.array_max(F.array(*scores))["name"])


def word_confidence(w: Column) -> Column:
    """0 to 1: lower for marks inside words, digits among letters, runs of one letter and words without vowels."""
    low = F.lower(w)
    flaws = (
        F.when(low.rlike(r"[\p{L}\p{N}][^\p{L}\p{N}'’-]+[\p{L}\p{N}]"), 0.3).otherwise(0.0) + F.when(low.rlike(r"\p{L}\d|\d\p{L}"), 0.3).otherwise(0.0)
        + F.when(low.rlike(r"(\p{L})\1{3}"), 0.3).otherwise(0.0) + F.when((F.length(w) > 3) & low.rlike(r"^\p{L}+$") & ~low.rlike("[aeiouyäöüàâéèêíóú]"), 0.4).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), 1 - flaws)
