import hashlib
import random
import re

import numpy as np
import pytest

from filingforge.llm import repeats
from filingforge.llm.repeats import without_repeats
from filingforge.llm.text_arrays import Hasher

from .conftest import LONG, ODD


def brute(texts, depth):
    first = {}
    for key, text in texts:
        data = (text or "").encode()
        for p in range(len(data) - depth + 1):
            if key is not None:
                w = data[p : p + depth]
                first[w] = min(first.get(w, (key, p)), (key, p))
    out = []
    for key, text in texts:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - depth + 1):
            if key is not None and first[data[p : p + depth]] < (key, p):
                gone[p : p + depth] = b"\x01" * depth
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out.append((key, len(data), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(frame, **more):
    return sorted((tuple(r) for r in without_repeats(frame, **more).collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    line = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passages = [line(n) for n in (60, 99, 100, 101, 130, 300, 700)]
    texts = []
    for i in range(120):
        parts = [line(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(passages)
            if rng.random() < 0.4:  # a change in the middle, or a part only
                a = rng.randrange(len(passage))
                passage = passage[:a] + "#" + passage[a + 1 :] if rng.random() < 0.5 else passage[a:]
            parts += [passage, line(rng.randint(0, 90))]
        texts.append((rng.randint(-50, 10**6), "".join(parts)))
    return texts + [(i, texts[3][1]) for i in range(2_000_000, 2_000_020)] + [(77, "ab" * 400), (78, "z" * 250), (79, "ab" * 130)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(documents, seed):
    texts = corpus(seed)
    assert len({k for k, _ in texts}) == len(texts)
    assert result(documents(texts)) == brute(texts, 100)


def test_other_depths_and_slices(documents, monkeypatch):
    texts = corpus(3)
    frame = documents(texts).repartition(7)
    assert result(frame, depth=40, gram=16) == brute(texts, 40)


def test_odd_rows(documents):
    texts = [t for t in ODD if t[1] != LONG and t[0] != 10] + [(None, "A" * 5000), (20, "A" * 300), (21, ""), (21, "")]
    assert result(documents(texts)) == brute(texts, 100)
    assert result(documents([])) == []


def test_a_very_long_text_and_its_copy_with_more(documents):
    rows = {r.doc_id: r for r in without_repeats(documents([(4, LONG), (10, LONG + " tail")])).collect()}
    assert rows[10].n_bytes - rows[10].n_removed == len(" tail") and rows[10].n_spans == 1


def test_ids_with_several_texts_are_told_apart(documents):
    rng = random.Random(5)
    shared = "".join(rng.choice("abcdefgh") for _ in range(400))
    rows = without_repeats(documents([(1, "x" + shared), (1, "other " * 5), (2, shared), (2, "own text " + shared[:150] + "!")])).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in rows) == [(1, 30, 0), (1, 401, 0), (2, 160, 150), (2, 400, 400)]


def test_texts_longer_than_a_place_can_say(monkeypatch):
    rng = np.random.default_rng(6)
    data = rng.integers(97, 105, 9000).astype(np.uint8)
    offsets = np.array([0, 40, 7300, 7300, 9000])

    def windows():
        h, _, text, first, last = repeats.anchors(Hasher(), data, offsets, 100, 32)
        found = [(s, x, t) for x, t, a, b in zip(h.tolist(), text.tolist(), first.tolist(), last.tolist()) for s in range(a, b + 1)]
        assert len({s for s, _, _ in found}) == len(found)
        return sorted(found)

    want = windows()
    assert len(want) == 7260 - 99 + 1700 - 99
    monkeypatch.setattr(repeats, "_PLACE", np.uint64((1 << 10) - 1))
    monkeypatch.setattr(repeats, "_PIECE", 900, raising=False)
    assert windows() == want
