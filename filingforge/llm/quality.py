"""Quality by naive Bayes support vectors.

N-gram indicators are scaled by the log ratio of their smoothed shares in either class; a linear hinge-loss model is
fitted on them by dual coordinate descent; its margin becomes a score by a logistic curve fitted on the learning rows.

N-grams: words (lowered), and runs of one to three word shapes. A shape is the case of a word and the marks after it;
a word that repeats the one before has the shape "=". Indicators, so length does not dilute; whole texts count.

Bounds (parameters): `most_rows` labelled rows by lowest hash of the id; `most` n-grams by rows and log ratio. Null or
empty texts have the one n-gram "empty". Without learning rows of both classes every score is the share of label 1, or 0.
Null keys are scored, never learnt from; repeated rows are scored alike; empty tables give no rows; other columns are
not read.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import CACHED_WORDS, feature_counts, feature_rows, fold, lowest_hashes, sample_texts, scored, sigmoid


def shape(word: str) -> str:
    """Case and trailing marks of a word: 'Haus.' is 'Xx.'."""
    body = word.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    marks = word[len(body) :][:4]
    if not body:
        return marks
    if not any(map(str.isalpha, body)):
        return "9" + marks
    return ("xx" if body.islower() else "X" if len(body) == 1 else "XX" if body.isupper() else "Xx" if body[1:].islower() else "xX") + marks


def _grams(words: list[str], shapes: list[str]) -> set:
    if not words:
        return {("empty",)}
    line = ["=" if a == b else s for a, b, s in zip(words, ["", *words], shapes)]
    return {*zip(line), *zip(line, line[1:]), *zip(line, line[1:], line[2:])}


def text_features(text: str) -> set[str]:
    words = text.split()
    shapes = {w: shape(w) for w in set(words)}
    return {" ".join(g) for g in _grams(words, [shapes[w] for w in words])} | {"w " + w.lower() for w in shapes}


def fit_hinge(rows: list[np.ndarray], signs: np.ndarray, scale: np.ndarray, cost: float = 0.1, rounds: int = 15, seed: int = 0):
    """Weights (of scaled indicators) and bias by dual coordinate descent; both classes weigh the same in all."""
    n = len(rows)
    values = [scale[r] for r in rows]
    diagonal = np.array([v @ v + 1 for v in values])
    cap = cost * n / 2 / np.where(signs > 0, max(1, (signs > 0).sum()), max(1, (signs < 0).sum()))
    alpha, weights, bias = np.zeros(n), np.zeros(len(scale)), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(n):
            gradient = signs[i] * (weights[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), cap[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * signs[i]
                weights[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return weights, bias


def fit_curve(margins: np.ndarray, ones: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, both classes weighing the same."""
    a, b = 1.0, 0.0
    weight = np.where(ones, 1 / max(1, ones.sum()), 1 / max(1, (~ones).sum()))
    for _ in range(30):
        p = sigmoid(a * margins + b)
        slope, bend = weight * (p - ones), weight * p * (1 - p) + 1e-9
        g = np.array([(slope * margins).sum() + 1e-3 * (a - 1), slope.sum()])
        h = np.array([[(bend * margins**2).sum() + 1e-3, (bend * margins).sum()], [(bend * margins).sum(), bend.sum() + 1e-9]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return float(max(a, 1e-3)), float(b)


def learn_quality(docs: DataFrame, labels: DataFrame, most_rows: int = 8000, most: int = 8000, folds: int = 3, out: int = 1):
    """({n-gram: weight}, bias) for the score's logit; (None, share of label 1) without rows of both classes."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), folds) != out))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").cast("int").alias("group"))
    sample = sample_texts(docs, lowest_hashes(marked, most_rows), "quality")
    sizes = {r[0]: r[1] for r in sample.groupBy("group").count().collect()}
    if len(sizes) < 2:
        return None, float(max(sizes, default=0))
    counts = feature_counts(sample, text_features).where("ones + zeros >= 5")
    total = counts.agg(F.sum(F.col("ones") + 1).alias("ones"), F.sum(F.col("zeros") + 1).alias("zeros")).first()
    if not total["ones"]:
        return None, sizes[1] / sum(sizes.values())
    ratio = F.log(((F.col("ones") + 1) / total["ones"]) / ((F.col("zeros") + 1) / total["zeros"]))
    top = counts.withColumn("ratio", ratio).orderBy(F.desc(F.abs("ratio") * F.sqrt(F.col("ones") + F.col("zeros"))), "feature").limit(most).collect()
    names, scale = [r["feature"] for r in top], np.array([r["ratio"] for r in top])
    rows, groups = feature_rows(sample, text_features, {f: i for i, f in enumerate(names)})
    weights, bias = fit_hinge(rows, np.where(groups == 1, 1.0, -1.0), scale)
    combined = weights * scale
    a, b = fit_curve(np.array([combined[r].sum() + bias for r in rows]), groups == 1)
    return dict(zip(names, (combined * a).tolist())), a * bias + b


def quality_scorer(model):
    """A task's function from a text to its score."""
    if model[0] is None:
        return lambda text: model[1]
    grams = {tuple(f.split(" ")): w for f, w in model[0].items() if not f.startswith("w ")}
    singles = {f[2:]: w for f, w in model[0].items() if f.startswith("w ")}
    bias, known = model[1], {}

    def of(text: str) -> float:
        words = text.split()
        shapes, found = [], set(words)
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in found:
            if w not in known:
                known[w] = shape(w)
        shapes = [known[w] for w in words]
        total = sorted(grams[g] for g in _grams(words, shapes) if g in grams)
        total += sorted(singles[w] for w in {w.lower() for w in found} if w in singles)
        return float(sigmoid(bias + sum(total)))

    return of


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, out: int = 1, **bounds) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; labels of the held-out fold are not learnt."""
    model = learn_quality(docs, labels, folds=folds, out=out, **bounds)
    return scored(docs, "doc_id", "text", folds, out, lambda: quality_scorer(model))
