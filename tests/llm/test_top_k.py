import math
import random

import pytest

from filingforge.llm.top_k import exact_top_k


def brute(rows, k=10, every=100):
    kept = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, v in kept:
        if q % every == 0:
            scored = sorted(((sum(a * b for a, b in zip(v, w)), c) for c, w in kept if c != q), key=lambda x: (-x[0], x[1]))
            out += [(q, n + 1, c, s) for n, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def result(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<float>, score long, rank int, row string")
    return sorted(tuple(r) for r in exact_top_k(frame, **more).collect())


@pytest.mark.parametrize("dims", [1, 3, 16, 37])
def test_equals_brute_force_with_ties(spark, dims):
    rng = random.Random(dims)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0, rng.uniform(-1, 1) // 0.001 / 1024]) for _ in range(dims)]) for i in range(-300, 900)]
    rows += [(2000 + i, rows[5][1]) for i in range(30)]
    assert result(spark, rows) == brute(rows)


def test_odd_vectors_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (100, [0.5, -0.5]), (100, [0.5, -0.5]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [1.0, -inf]), (None, [1.0, 1.0]),
        (5, []), (6, [1.0]), (7, [1.0, 1.0, 1.0]),
    ]
    assert result(spark, rows) == brute(rows)
    assert result(spark, [(0, [1.0])]) == [] and result(spark, []) == []


def test_large_components_stay_exact(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randint(-(2**20), 2**20)) for _ in range(4)]) for i in range(0, 400)]
    assert result(spark, rows) == brute(rows)


def test_blocks(spark, monkeypatch):
    from filingforge.llm import top_k

    monkeypatch.setattr(top_k, "QUERIES_A_BLOCK", 2)
    monkeypatch.setattr(top_k, "VECTORS_A_BLOCK", 50)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.125) // (1 / 4096) / 4096 for _ in range(8)]) for i in range(600)]
    assert result(spark, rows) == brute(rows)


def test_repeated_ids_with_different_vectors(spark):
    unit = lambda *v: [x / 1024 for x in v]
    nine = [(i, unit(*[15 * (i % 3 == d) for d in range(4)])) for i in range(1, 10)]
    rows = [(0, unit(1, 1, 1, 1)), (50, unit(10, 0, 0, 0)), (50, unit(0, 10, 0, 0)), *nine]
    assert result(spark, rows) == brute(rows)
    rng = random.Random(3)
    rows = [(i % 40 * 5, [rng.randint(-9, 9) / 1024 * rng.choice([1, 8]) for _ in range(8)]) for i in range(400)]
    assert result(spark, rows, lists=8) == brute(rows)


def test_tiles_and_kinds_of_numbers(spark, monkeypatch):
    from filingforge.llm import top_k

    monkeypatch.setattr(top_k, "TILE", (3, 7))
    monkeypatch.setattr(top_k, "FIRST", 11)
    monkeypatch.setattr(top_k, "LEAST_A_BLOCK", 90)
    rng = random.Random(4)
    for peak in (0.25, 2.0**8, 2.0**18):  # of 32 and of 64 bits, integers
        rows = [(i * 10 % 1900 - 300, [peak * rng.choice([-1.0, -0.5, 0.25, 0.75]) for _ in range(6)]) for i in range(400)]
        assert result(spark, rows) == brute(rows)


def test_components_beyond_the_integers_are_cut_to_them(spark):
    from filingforge.llm.top_k import _whole_numbers

    frame = spark.createDataFrame([(1, [1e308, -1e308, -0.5 / 1024, 0.0]), (2, [1.0, None]), (3, [])], "id long, x array<double>")
    found = frame.mapInArrow(_whole_numbers, "id long, v array<long>, square double").collect()
    assert {r.id: r.v for r in found} == {1: [2**63 - 1, -(2**63), -1, 0], 3: []}


def test_the_cutoff_is_safe_and_close(spark, monkeypatch):
    """Of 16,000 pairs only some hundreds may have to be ranked: nearly all reached the cutoff made of partial scores."""
    from filingforge.llm import top_k

    staged = {}
    stage = top_k.stage
    monkeypatch.setattr(top_k, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.125) for _ in range(64)]) for i in range(1600)]
    assert result(spark, rows) == brute(rows)
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    cutoffs = {r.id: r.cutoff for r in staged["cutoffs"].join(staged["vectors"], "row").collect()}
    assert sorted(cutoffs) == list(range(0, 1600, 100))
    for q, cutoff in cutoffs.items():
        scores = sorted((sum(a * b for a, b in zip(whole[q], whole[c])) for c in whole if c != q), reverse=True)
        assert scores[9] >= cutoff >= scores[50]
