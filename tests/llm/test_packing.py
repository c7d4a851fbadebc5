import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from filingforge.llm import packing
from filingforge.llm.packing import pack_shard, packed, token_frequencies

from .conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ids_of():
    library = Tokenizer.from_file(PATH)
    return lambda text: [*library.encode(text or "", add_special_tokens=False).ids, 1]


def test_round_trip(documents, ids_of):
    texts = [*ODD, *((100 + i, f"text {i} " + "some more words here " * (i % 90)) for i in range(400))]
    rows = packed(documents(texts), PATH).collect()
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for line in sequences.values():
        line.sort(key=lambda r: r.offset)
        assert [r.offset for r in line] == [sum(x.length for x in line[:i]) for i in range(len(line))]
        assert sum(r.length for r in line) <= 2048
    sizes = [sum(r.length for r in line) for line in sequences.values()]
    assert sum(s < 2048 for s in sizes) <= 1
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    wanted = collections.defaultdict(list)
    for key, text in texts:
        wanted[key].append(ids_of(text))
    assert set(by_doc) == set(wanted)
    for key, lists in wanted.items():
        if len(lists) == 1 or lists[0] == lists[1]:
            covered = np.zeros(len(lists[0]), int)
            for r in by_doc[key]:
                assert r.doc_tokens == len(lists[0])
                part = lists[0][r.start : r.start + r.length]
                assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and len(part) == r.length > 0
                covered[r.start : r.start + r.length] += 1
            assert (covered == len(lists)).all()
    assert sum(r.length for r in rows) == sum(len(x) for lists in wanted.values() for x in lists)


def test_many_shards(documents, ids_of, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 5000)
    texts = [(i, f"text {i} " + "some more words here " * (i % 60)) for i in range(500)]
    rows = packed(documents(texts), PATH).collect()
    assert sum(r.length for r in rows) == sum(len(ids_of(t)) for _, t in texts)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) and len({r.sequence_id >> 32 for r in rows}) > 3
    assert packed(documents([]), PATH).collect() == []


def test_neighbours_share_a_shard(documents, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 5000)
    rng = np.random.default_rng(4)
    words = ["orchard quince apple cider", "harbor vessel anchor sailor", "granite quartz basalt mineral", "violin cello sonata rhythm"]
    texts = [(i, " ".join(rng.choice(words[i % 4].split(), 120))) for i in range(320)]
    rows = packed(documents(texts), PATH).collect()
    shards = collections.defaultdict(lambda: collections.Counter())
    for r in rows:
        shards[r.sequence_id >> 32][r.doc_id % 4] += r.length
    tokens = sum(r.length for r in rows)
    assert len(shards) > 6 and max(sum(c.values()) for c in shards.values()) < 2 * 5000
    assert sum(max(c.values()) for c in shards.values()) > 0.8 * tokens


def test_copies_are_dealt_evenly(documents, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 5000)
    rows = packed(documents([(i, "the very same words " * 25) for i in range(500)]), PATH).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.sequence_id >> 32] += r.length
    assert len(sizes) > 6 and max(sizes.values()) < 2 * 5000


def test_neighbours_share_words():
    rng = np.random.default_rng(0)
    topics = [rng.choice(1000, 60) + 1000 * t for t in range(4)]
    rests = [rng.choice(topics[i % 4], 100) for i in range(80)]
    counts = np.bincount(np.concatenate([np.unique(r) for r in rests]), minlength=5000)
    lines = pack_shard(rests, np.log(1 + (80 - counts + 0.5) / (counts + 0.5)), 100.0, 500, 12)
    assert sorted((p for line in lines for p in line)) == sorted((i, 0, 100) for i in range(80))
    assert all(len({i % 4 for i, _, _ in line}) == 1 for line in lines)


def _packed_one_by_one(rests, rarity, mean, window):
    """The same by a plain loop over all rests with all tokens."""
    parts = [collections.Counter(r.tolist()) for r in rests]

    def score(a, b):
        k = packing.K1 * (1 - packing.B + packing.B * len(rests[b]) / mean)
        return sum(rarity[t] * parts[b][t] * (packing.K1 + 1) / (parts[b][t] + k) for t in parts[a] if t in parts[b])

    unused, left, out = sorted(range(len(rests)), key=lambda i: -len(rests[i])), None, []
    while unused or left:
        seed, start = left or (unused.pop(0), 0)
        line, left = [(seed, start, len(rests[seed]))], None
        room = window - len(rests[seed]) + start
        order = sorted(unused, key=lambda i: (-round(score(seed, i), 9), i)) if room else []
        order = [i for i in order if score(seed, i) > 0] + [i for i in unused if not score(seed, i) > 0]
        while room and order:
            other = order.pop(0)
            unused.remove(other)
            last = min(room, len(rests[other]))
            line.append((other, 0, last))
            room -= last
            left = (other, last) if last < len(rests[other]) else None
        out.append(line)
    return out


@pytest.mark.parametrize(("sizes", "words"), [((2, 12), 6000), ((20, 90), 400)])
def test_all_terms_and_all_neighbours(sizes, words):
    rng = np.random.default_rng(8)
    rests = [np.r_[rng.integers(2, words, rng.integers(*sizes)), 1] for _ in range(400)]
    rests += [np.r_[7, rng.integers(words, 9000, 3), 1] for _ in range(150)]  # more than 64 neighbours by one token
    counts = np.bincount(np.concatenate([np.unique(r) for r in rests]), minlength=9000)
    rarity = np.log(1 + (len(rests) - counts + 0.5) / (counts + 0.5))
    rarity[1] = 0
    mean = float(np.mean([len(r) for r in rests]))
    # Scores of equal rests differ in the last places, depending on the order of addition.
    got, want = pack_shard(rests, rarity, mean, 600), _packed_one_by_one(rests, rarity, mean, 600)
    assert [len(x) for x in got] == [len(x) for x in want]
    assert sum(set(a) == set(b) for a, b in zip(got, want)) == len(want)


def test_frequencies_count_documents(spark):
    lists = [[1, 1, 2], [2, 3], [70000, 2]]
    rows = [(len(x), bytearray(np.array(x, "<u2" if max(x) < 65536 else "<u4").tobytes())) for x in lists]
    found = token_frequencies(spark.createDataFrame(rows, "length long, ids binary"))
    assert {r.token: r.docs for r in found.collect()} == {1: 1, 2: 3, 3: 1, 70000: 1}
