"""Toxicity by non-negative positive-unlabelled learning.

Learns from confirmed toxic texts (label 1) and unlabelled texts (any document, whatever its label); texts marked 0
are never used as negatives. The risk is corrected by the class prior: prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)),
with logistic loss; where the second part turns negative, the step goes the other way, so that the classifier does
not fit unlabelled toxic texts as clean. The prior is the toxic share of the labelled learning rows.

Features: the words of a text (A-Z and other letters lowered, outer punctuation dropped) and their first four to six
letters, present or not, so that length does not dilute a word. Whole texts count.

Bounds (parameters): `positives` and `unlabelled` rows to learn from, taken by lowest hash of the id; `most` features, whose shares in the two
groups differ by at least `least` standard errors.
Null or empty texts have no features and get the score of the bias. Without toxic learning rows every score is 0. Null
keys are scored, never learnt from; repeated rows are scored alike; empty tables give no rows; other columns are not read.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import CACHED_WORDS, feature_counts, feature_rows, fold, lowest_hashes, sample_texts, scored, sigmoid

_OUTER = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…¿¡–—"


def word_features(word: str) -> list[str]:
    """A word and its beginnings; the star tells a beginning from a word."""
    word = word.strip(_OUTER)
    return [word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) >= n)] if word else []


def text_features(text: str) -> set[str]:
    return {f for w in set(text.lower().split()) for f in word_features(w)}


def fit_nnpu(rows: list[np.ndarray], positive: np.ndarray, size: int, prior: float, steps: int = 250, rate: float = 0.05, decay: float = 1e-4):
    """Weights and bias of the linear classifier; `rows` hold the places of the features that are present."""
    counts = np.array([len(r) for r in rows])
    at, row = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), counts)
    positive = positive.astype(bool)
    share = np.where(positive, 1 / max(1, positive.sum()), 1 / max(1, (~positive).sum()))
    weights, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        margin = bias + np.bincount(row, weights=weights[at], minlength=len(rows))
        p = sigmoid(margin)
        # Derivatives of the logistic losses for + and for - by the margin are p - 1 and p.
        plus = np.where(positive, prior * share * (p - 1), 0)
        minus = np.where(positive, -prior * share * p, share * p)
        loss = np.logaddexp(0, margin) * share
        negative_risk = loss[~positive].sum() - prior * loss[positive].sum()
        slope = plus + minus if negative_risk >= 0 else -minus
        gradient = np.r_[np.bincount(at, weights=slope[row], minlength=size) + decay * weights, slope.sum()]
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def learn_toxicity(docs: DataFrame, labels: DataFrame, positives: int = 2500, unlabelled: int = 5000, most: int = 2000, least: float = 4.5, folds: int = 5, out: int = 0):
    """({feature: weight}, bias), or None without toxic learning rows; rows of fold `out` are left out."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id"), folds) != out))
    prior = marked.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not prior:
        return None
    prior = min(prior, 0.95)
    toxic = marked.where("toxic = 1").select(F.col("doc_id").cast("long").alias("id")).distinct()
    free = docs.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != out)).select(F.col("doc_id").cast("long").alias("id"))
    chosen = lowest_hashes(toxic, positives).withColumn("group", F.lit(1)).unionByName(lowest_hashes(free, unlabelled).distinct().withColumn("group", F.lit(0)))
    sample = sample_texts(docs, chosen, "toxicity")
    sizes = {r[0]: r[1] for r in sample.groupBy("group").count().collect()}
    if len(sizes) < 2:
        return None
    counts = feature_counts(sample, text_features).where("ones + zeros >= 5")
    share, rest = F.col("ones") / sizes[1], F.col("zeros") / sizes[0]
    mean = (F.col("ones") + F.col("zeros") + 1) / (sizes[0] + sizes[1] + 2)
    sigmas = F.abs(share - rest) / F.sqrt(mean * (1 - mean) * (1 / sizes[1] + 1 / sizes[0]))
    names = [r[0] for r in counts.where(sigmas >= least).orderBy(F.desc(sigmas), "feature").limit(most).select("feature").collect()]
    places = {f: i for i, f in enumerate(names)}
    rows, groups = feature_rows(sample, text_features, places)
    weights, bias = fit_nnpu(rows, groups, len(names), prior)
    return dict(zip(names, weights.tolist())), bias


def toxicity_scorer(model):
    """A task's function from a text to its score."""
    if model is None:
        return lambda text: 0.0
    names = list(model[0])
    places, weights, bias = {f: i for i, f in enumerate(names)}, [model[0][f] for f in names], model[1]
    known: dict[str, tuple[int, ...]] = {}

    def of(text: str) -> float:
        found = set()
        for word in set(text.lower().split()):
            hit = known.get(word)
            if hit is None:
                if len(known) > CACHED_WORDS:
                    known.clear()
                hit = known[word] = tuple(places[f] for f in word_features(word) if f in places)
            if hit:
                found.update(hit)
        return float(sigmoid(bias + sum(weights[i] for i in sorted(found))))

    return of


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, out: int = 0, **bounds) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; labels of the held-out fold are not learnt."""
    model = learn_toxicity(docs, labels, folds=folds, out=out, **bounds)
    return scored(docs, "doc_id", "text", folds, out, lambda: toxicity_scorer(model))


def without_toxic(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns; narrow, no shuffle."""
    model = learn_toxicity(docs, labels, **bounds)

    def keep(batches):
        import pyarrow as pa

        of = toxicity_scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([of(t or "") < 0.5 for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
