import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from filingforge.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, c long, d int, name string, len int, pos string, size string"


def token(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows, every=100, heads=6):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, token(role or "", text or ""), role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(found)] for c, found in convs.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % every) * (1 if c >= 0 else -1)
        rebuilt[c] = turns.get(base, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
        saved[path] = sum(saved[k] for k in children[path]) + (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
    out = []
    for path, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(rebuilt[c]) == len(path))))
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(spark, rows, **more):
    frame = spark.createDataFrame([(*r, 1, 2, "x", 3, "y", "z") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in prefix_trie(frame, **more).collect()), key=repr)


def talk(rng, c, n, kinds):
    return [(c, t, rng.choice("ua"), rng.choice(kinds)) for t in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 420), 260):
        rows += talk(rng, c, rng.choice([1, 2, 3, 7, 8, 9]), ["", "hello", "日本語 🙂"])
    same = talk(rng, 0, 7, ["one", "two"])
    rows += [(c, *r[1:]) for c in range(500, 700) for r in same]  # a third of all rows are one conversation
    rng.shuffle(rows)
    assert result(spark, rows) == brute(rows)


def test_long_conversation_that_holds_most_rows(spark):
    rng = random.Random(4)
    rows = talk(rng, 100, 150, ["a", "b"])
    rows += [(c, *r[1:]) for c, upto in ((207, 150), (303, 64), (305, 65), (401, 63), (402, 1)) for r in rows[:upto]]
    rows += [(207, 200, "u", "an end of its own")]
    assert result(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "u", "no conversation"), (1, None, None, None), (1, 0, "u", "x"), (1, 0, "u", "x"), (1, 0, "a", "y"), (2, None, "", ""), (2, 0, "u", "x"),
        (3, 5, "u", "x" * 100_000), (4, -3, "ux", ""), (4, -2, "u", "x"), (5, 1, "u", ":"), (0, 1, "u", "base"), (-7, 1, "u", "base"), (-7, 2, None, "more"),
    ]
    assert result(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert result(spark, []) == [] and result(spark, [(None, 1, "u", "x")]) == []
    for c in (3, 7):
        assert result(spark, [(c, 0, "u", "x")]) == brute([(c, 0, "u", "x")])
