import random
import zlib

import numpy as np
import pytest

from filingforge.llm.quality import fit_curve, fit_hinge, quality_scores, shape
from filingforge.llm.quality import text_features as quality_features
from filingforge.llm.toxicity import fit_nnpu, text_features, toxicity_scores, without_toxic

from .conftest import ODD

LABELS = "doc_id long, quality int, toxic int, text string, score double"


def labels_of(spark, rows):
    return spark.createDataFrame([(i, q, t, "x", 0.1) for i, q, t in rows], LABELS)


def corpus(n, seed):
    """Texts with labels: a toxic word somewhere in an often long text; shouting or repeating in bad ones."""
    rng = random.Random(seed)
    texts, labels, truth = [], [], {}
    for i in range(n):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.choice([20, 80, 600]))]
        toxic, bad = rng.random() < 0.15, rng.random() < 0.2
        if bad:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w for w in words for _ in range(3)]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["grobian", "lump,", "Schuft."]))
        texts.append((i, " ".join(words)))
        truth[i] = (int(not bad), int(toxic))
        if rng.random() < 0.6:
            labels.append((i, int(not bad), int(toxic)))
    return texts, labels, truth


def test_positive_unlabelled_learning_finds_positives_among_unlabelled():
    rng = np.random.default_rng(0)
    # Feature 0 marks positives, feature 1 negatives, the rest nothing; a third of the unlabelled rows are positive.
    draw = lambda p: np.r_[[0] if p else [1], 2 + rng.choice(20, 4, replace=False)]
    rows = [draw(True) for _ in range(200)] + [draw(i % 3 == 0) for i in range(600)]
    weights, bias = fit_nnpu(rows, np.r_[np.ones(200), np.zeros(600)], 22, 1 / 3)
    margins = np.array([weights[r].sum() + bias for r in rows[200:]])
    truth = np.arange(600) % 3 == 0
    assert ((margins > 0) == truth).mean() > 0.98


def test_dual_coordinate_descent_reaches_the_primal_optimum():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.choice(12, 5)) for _ in range(80)]
    signs = np.where([0 in r for r in rows], 1.0, -1.0) * np.where(rng.random(80) < 0.1, -1, 1)
    scale = rng.normal(0, 1, 12)
    weights, bias = fit_hinge(rows, signs, scale, rounds=3000)
    x = np.zeros((80, 13))
    for i, r in enumerate(rows):
        x[i, r] = scale[r]
    x[:, 12] = 1
    cap = 0.1 * 80 / 2 / np.where(signs > 0, (signs > 0).sum(), (signs < 0).sum())
    loss = lambda w: w @ w / 2 + (cap * np.maximum(0, 1 - signs * (x @ w))).sum()
    found = np.r_[weights, bias]
    assert all(loss(found) <= loss(found + rng.normal(0, s, 13)) + 1e-6 for s in (0.01, 0.1, 1) for _ in range(300))


def test_curve_is_half_where_both_classes_weigh_the_same():
    margins = np.r_[np.linspace(-2, 0.5, 200), np.linspace(-0.5, 2, 50)]
    a, b = fit_curve(margins, np.r_[np.zeros(200, bool), np.ones(50, bool)])
    assert a > 0 and abs(b) < 0.2


def test_features():
    assert text_features("Idiot! idiot") == {"idiot", "idio*", "idiot*"} and text_features(" !? ") == set()
    assert [shape(w) for w in ("Haus.", "HAUS!!", "a", "I", "12,", "***", "iPad")] == ["Xx.", "XX!!", "xx", "X", "9,", "***", "xX"]
    assert "= =" in quality_features("so so so it is") and quality_features("") == {"empty"}


@pytest.mark.parametrize("which", ["toxic", "quality"])
def test_held_out_rows_are_told_apart(spark, documents, which):
    texts, labels, truth = corpus(1500, 3)
    frame, marked = documents([*texts, *((10_000 + i if k is None else -1000 - k, t) for i, (k, t) in enumerate(ODD))]), labels_of(spark, labels)
    scores, folds, out, at = (toxicity_scores, 5, 0, 1) if which == "toxic" else (quality_scores, 3, 1, 0)
    rows = scores(frame, marked).collect()
    assert len(rows) == len(texts) + len(ODD)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == out)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    right = [r.predicted == truth[r.doc_id][at] for r in rows if r.held_out and r.doc_id in truth]
    assert len(right) > 200 and np.mean(right) > 0.97
    # Labels of held-out rows change nothing.
    turned = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % folds == out else (i, q, t) for i, q, t in labels]
    again = scores(frame, labels_of(spark, turned)).collect()
    assert sorted((r.doc_id, r.score) for r in rows) == sorted((r.doc_id, r.score) for r in again)


def test_odd_rows_and_missing_labels(spark, documents):
    none = labels_of(spark, [(None, 1, 1), (1, None, None), (2, 1, 0)])
    for labels in (none, labels_of(spark, [])):
        assert {r.score for r in toxicity_scores(documents(ODD), labels).collect()} == {0.0}
        rows = quality_scores(documents(ODD), labels).collect()
        assert len(rows) == len(ODD) and len({r.score for r in rows}) == 1
    assert toxicity_scores(documents([]), none).collect() == [] and quality_scores(documents([]), none).collect() == []


def test_toxic_documents_go_and_others_stay_whole(spark, documents):
    texts, labels, truth = corpus(900, 4)
    frame = documents([*texts, *((None, t) for _, t in ODD)])
    left = without_toxic(frame, labels_of(spark, labels))
    assert left.columns == frame.columns
    kept = {r.doc_id for r in left.collect()}
    toxic = {i for i, (_, t) in truth.items() if t}
    assert len(toxic - kept) > 0.97 * len(toxic) and len(set(truth) - toxic - kept) < 0.01 * len(truth) and None in kept
