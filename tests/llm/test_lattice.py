import itertools

import numpy as np
import pytest

from filingforge.llm import lattice_links as module
from filingforge.llm.lattice import nearest, shortest_vectors
from filingforge.llm.lattice_links import near_vectors

SCHEMA = "vec_id long, embedding array<double>, label int, node long, key string, held int, n_links string, v int"


def frame_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else list(map(lambda x: x if x is None else float(x), v)), 1, 2, "x", 3, "y", 4) for i, v in rows], SCHEMA)


def brute(rows, least=0.9):
    """(id, links, component, kept) of every row, by all pairs."""
    def usable(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [k for k, (_, v) in enumerate(rows) if usable(v)]
    dims = max((len(rows[k][1]) for k in good), default=0)
    x = np.array([[*rows[k][1], *[0.0] * (dims - len(rows[k][1]))] for k in good]).reshape(len(good), dims)
    x = x / np.abs(x).max(axis=1, keepdims=True) if good else x
    norms = np.sqrt((x * x).sum(axis=1))
    linked = x @ x.T / (norms[:, None] * norms[None, :] + (len(good) == 0)) >= least
    np.fill_diagonal(linked, False)
    root = list(range(len(good)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in zip(*np.nonzero(linked)):
        root[find(a)] = find(b)
    low = {}
    for a, k in enumerate(good):
        if rows[k][0] is not None:
            low[find(a)] = min(low.get(find(a), rows[k][0]), rows[k][0])
    out = []
    place = {k: a for a, k in enumerate(good)}
    for k, (i, _) in enumerate(rows):
        component = low.get(find(place[k])) if k in place else i
        out.append((i, int(linked[place[k]].sum()) if k in place else 0, component, component == i))
    return sorted(out, key=repr)


def result(spark, rows, **more):
    return sorted((tuple(r) for r in near_vectors(frame_of(spark, rows), **more).collect()), key=repr)


def turned(rng, x, cosine):
    other = rng.normal(size=x.shape)
    other -= (other @ x) / (x @ x) * x
    return cosine * x / np.linalg.norm(x) + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


def sample(seed, dims=32):
    """Pairs well over and well under the threshold, chains, a group of near copies, exact copies, other lengths of vectors."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(40):
        x = rng.normal(size=dims)
        for cosine in rng.choice([0.999, 0.97, 0.95, 0.8, 0.6], size=rng.integers(1, 6)):
            rows.append(x)
            x = turned(rng, x, cosine)
    centre = rng.normal(size=dims)
    rows += [turned(rng, centre, 0.98) * rng.uniform(0.1, 30) for _ in range(150)]
    rows += [rows[3]] * 20 + [2 * rows[3]] * 5 + [-rows[3]]
    return [(int(i), v.tolist()) for i, v in zip(rng.permutation(5000)[: len(rows)], rows)]


def test_nearest_point_is_nearest():
    rng = np.random.default_rng(0)
    walls = shortest_vectors()
    assert len({tuple(w) for w in walls}) == 240 and np.allclose((walls**2).sum(axis=1), 2)
    points = rng.uniform(-4, 4, size=(3000, 8))
    found = nearest(points)
    assert ((found * 2) % 1 == 0).all() and (found.sum(axis=1) % 2 == 0).all()
    assert all(len(set(row % 1)) == 1 for row in found)
    own = ((points - found) ** 2).sum(axis=1)
    # A point lies in its cell if no neighbour's centre is nearer; no point is farther than 1 from the lattice.
    around = ((points[:, None] - found[:, None] - walls) ** 2).sum(axis=2).min(axis=1)
    assert (own <= around + 1e-9).all() and (own <= 1 + 1e-9).all()


@pytest.mark.parametrize("block", [512, 8])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK", block)
    rows = sample(block)
    assert result(spark, rows, tables=60) == brute(rows)


def test_small_parts_of_the_stream(spark, monkeypatch):
    monkeypatch.setattr(module, "_ROWS", 7)
    monkeypatch.setattr(module, "_PAIRS", 10)
    rows = sample(5)
    assert result(spark, rows, tables=60) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [-1.0, 2.0]), (3, [2.0, 4.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [1.0, -inf]),
        (9, [1.0, None]), (None, [-3.0, 6.0]), (None, [5.0, -5.0]), (None, None), (10, [1e300, 2e300]), (11, [1e-300, 2e-300]), (12, [-1.0]), (-4, [-1e-3]),
    ]
    assert result(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert result(spark, []) == [] and result(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(600):
        x = rng.normal(size=64)
        rows += [(2 * i, x.tolist()), (2 * i + 1, turned(rng, x, 0.901).tolist())]
    want, got = brute(rows), result(spark, rows)
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want)


def test_every_pair_counts_in_one_cell():
    """Over all cells that hold both, exactly one is the first meeting of a pair with a common home."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 16))
    x[30:] = x[:30] + 0.2 * rng.normal(size=(30, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cells = module.Tables(16, 4, 2, 6, 2.0).cells(x)
    for a, b in itertools.combinations(range(60), 2):
        together = [(t, c) for t in range(4) for c in set(cells[a, t]) & set(cells[b, t]) if c in (cells[a, t, 0], cells[b, t, 0])]
        firsts = [bool(module.first_meeting(cells, np.array([a]), np.array([b]), np.array([t]), np.array([c], np.int64))[0]) for t, c in together]
        assert sum(firsts) == (1 if together else 0)
