import random

import numpy as np
import pytest

from filingforge.llm import near_duplicates as module
from filingforge.llm.graphs import components
from filingforge.llm.near_duplicates import near_duplicates, sketch, without_copies

from .conftest import ODD


def sets_of(texts, k):
    out = []
    for _, text in texts:
        words = (text or "").lower().split()
        out.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()})
    return out


def brute(texts, k, percent):
    sets = sets_of(texts, k)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if texts[i][0] is not None and texts[j][0] is not None and (
                texts[i][0] == texts[j][0] or a and b and 100 * len(a & b) >= percent * len(a | b)
            ):
                root[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(texts):
        if key is not None:
            low[find(i)] = min(key, low.get(find(i), key))
    return [(key, len(sets[i]), None if key is None else low[find(i)]) for i, (key, _) in enumerate(texts)]


def edited(rng, words, share):
    return [f"e{rng.randint(0, 10**6)}" if rng.random() < share else w for w in words]


def corpus(seed):
    """Chains of edits, copies, and documents that share most of one passage but are not alike enough."""
    rng = random.Random(seed)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([2, 30, 120, 400]))]
        for _ in range(rng.randint(1, 6)):
            texts.append(" ".join(words))
            words = edited(rng, words, rng.choice([0, 0.01, 0.02, 0.05]))
    passage = [f"p{i}" for i in range(200)]
    texts += [" ".join(passage + [f"t{i}x{j}" for j in range(rng.choice([10, 25, 30, 40, 60]))]) for i in range(60)]
    rng.shuffle(texts)
    return [(i * 3 % 1009 + 100, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("k", "percent", "seed"), [(3, 85, 1), (5, 80, 2)])
def test_equals_brute_force(documents, k, percent, seed):
    texts = [*corpus(seed), *ODD]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(documents(texts), k, percent).collect()), key=repr)
    assert got == sorted(brute(texts, k, percent), key=repr)


def test_large_buckets_are_searched_in_blocks(documents, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 8)
    texts = corpus(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(documents(texts), 3, 85, rows=2, bands=60).collect())
    assert got == sorted(brute(texts, 3, 85))


def test_kept_documents_keep_their_columns(documents):
    frame = documents([*ODD, (50, "a b c d e f g h"), (51, "A b c d e f g h"), (52, "other words stand here now")])
    left = without_copies(frame)
    assert left.columns == frame.columns
    ids = [r.doc_id for r in left.collect()]
    assert 50 in ids and 51 not in ids and 52 in ids and ids.count(None) == 2 and 5 in ids and 6 not in ids and ids.count(7) == 1


def test_ids_with_several_texts(documents):
    a, b = "a b c d e f g h i j k l", "m n o p q r s t u v w x"
    for rows in (
        [(1, a), (1, b), (2, b + " y")], [(1, b), (1, a), (2, b + " y")], [(5, a), (7, a), (7, b), (9, b)], [(7, b), (9, b), (5, a), (7, a)],
        [(3, a), (3, a + "  "), (2, b), (3, b)], [(1, a), (2, None), (2, a), (4, ""), (4, b), (6, b)],
    ):
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(documents(rows), 3, 80).collect()))
        assert got == sorted(brute(rows, 3, 80)), rows


def test_repeated_ids_in_a_corpus(documents):
    rng = random.Random(6)
    texts = [(rng.randint(0, 60) if rng.random() < 0.5 else i, t) for i, t in corpus(7)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(documents(texts), 3, 85).collect()))
    assert got == sorted(brute(texts, 3, 85))


def test_repeated_rows_are_dropped_once(documents):
    left = without_copies(documents([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (3, None), (4, "x"), (4, "y")]))
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == [(1, "a b c d e f"), (3, None), (4, "x"), (4, "y")]


def test_a_group_of_close_texts_gives_few_links(documents, monkeypatch):
    """Of a large group with no link but many pairs close to the threshold, no pair leaves a task."""
    made = []
    plain = module._across
    monkeypatch.setattr(module, "_across", lambda *a: made.append(module.stage(plain(*a), "seen")) or made[0])
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(200)]
    texts = [(i, " ".join(passage + [f"t{i}x{j}" for j in range(rng.choice([19, 20, 21, 22, 26]))])) for i in range(150)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(documents(texts), 3, 85).collect())
    assert got == sorted(brute(texts, 3, 85))
    assert made and made[0].count() < len(texts)


def test_no_rows(documents):
    assert near_duplicates(documents([]), 3, 85).collect() == []


def test_sketches_estimate_similarity_and_fill():
    rng = np.random.default_rng(0)
    base = rng.integers(1, 1 << 62, 1000).astype(np.uint64)
    sets = [np.unique(base[:900]), np.unique(base[100:]), base[:1], base[:0]]
    table = sketch(np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])], 252)
    assert abs((table[0] == table[1]).mean() - 0.8) < 0.12
    assert (table[2] < 1 << 63).all() and (table[3] == 0xFFFFFFFFFFFFFFFF).all()


def test_components_of_long_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2001, 2000), (2001, 2002), (7, 7)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.id: r.root for r in rows} == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1200), 1000), 2000: 2000, 2001: 2000, 2002: 2000}
    assert len(rows) == 264
