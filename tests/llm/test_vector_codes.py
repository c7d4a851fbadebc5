import hashlib
import math
import random

import numpy as np
import pytest

from filingforge.llm import vector_codes as module
from filingforge.llm.vector_codes import nearest_entries, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code int, id string, same double, v string, error string"


def brute(rows, parts, entries, rounds, scale):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(r[1]) for r in kept), default=0) // parts)
    cut = [[(r[1] + [0] * (width * parts))[p * width : (p + 1) * width] for p in range(parts)] for r in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for c in cut:
                own[best(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(col) // len(xs) for col in zip(*xs)] if xs else y for xs, y in zip(own, books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for y in book for x in y).encode()).hexdigest()
    coded = []
    for (i, _, label), c in zip(kept, cut):
        found = [best(c[p], books[p]) for p in range(parts)]
        coded.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    return sorted([(i, code, error, sum(x[2] for x in coded if x[3] == label), digest) for i, code, error, label in coded], key=repr)


def result(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, label, 1, "x", 0.5, "y", "z") for i, v, label in rows], SCHEMA)
    return sorted((tuple(r) for r in vector_codes(frame, **more).collect()), key=repr)


@pytest.mark.parametrize(("dims", "parts", "entries", "rounds"), [(64, 16, 64, 2), (12, 4, 5, 3), (6, 6, 3, 1), (7, 3, 8, 2)])
def test_equals_brute_force(spark, monkeypatch, dims, parts, entries, rounds):
    monkeypatch.setattr(module, "_ROWS", 50)
    rng = random.Random(dims)
    rows = [(i, [rng.choice([rng.gauss(0, 0.2), -0.25, 0.0, 0.125]) for _ in range(dims)], rng.choice([None, 1, 2, 3])) for i in rng.sample(range(-200, 900), 220)]
    rows += [(5000 + i, rows[0][1], 1) for i in range(60)] + [rows[1]] * 3
    assert result(spark, rows, parts=parts, entries=entries, rounds=rounds) == brute(rows, parts, entries, rounds, 256)


def test_odd_vectors_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (3, [1.0, 2.0, 3.0], None), (1, [0.5], 7), (1, [0.25, -1.0], 7), (2, [], 7), (4, None, 1), (5, [nan], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 1),
        (None, [9.0, 9.0, 9.0], None), (None, None, None),
    ]
    assert result(spark, rows, parts=2, entries=4) == brute(rows, 2, 4, 2, 256)
    assert result(spark, []) == [] and result(spark, [(1, None, 2)]) == []
    assert [r[1:4] for r in result(spark, [(1, [], 2), (2, [], 2)])] == [("00" * 16, 0, 0)] * 2


def test_tabulated_distances_equal_plain_ones():
    rng = np.random.default_rng(1)
    values, books = rng.integers(-500, 500, size=(300, 12)), rng.integers(-500, 500, size=(3, 10, 4))
    books[:, 7] = books[:, 2]  # ties go to the lower entry
    codes, errors = nearest_entries(values, books)
    plain = ((values.reshape(300, 3, 1, 4) - books[None]) ** 2).sum(axis=3)
    assert (codes == plain.argmin(axis=2)).all() and (errors == plain.min(axis=2).sum(axis=1)).all() and not (codes == 7).any()
