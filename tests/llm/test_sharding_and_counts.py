import collections
import zlib

import public_tokenizers
import sentencepiece

from filingforge.llm.sharding import shard_rows
from filingforge.llm.token_counts import token_counts

from .conftest import ODD

SP = public_tokenizers.path("piece_bpe_32k.model")


def jump(key, shards):
    b, j, key = -1, 0, key & (1 << 64) - 1
    while j < shards:
        b = j
        key = key * 2862933555777941757 + 1 & (1 << 64) - 1
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_equal_the_published_loop(documents):
    texts = [*ODD, *((i * i * 7919 - 5000, f"t{i % 90}") for i in range(1500))]
    rows = shard_rows(documents(texts), 24).collect()
    assert len(rows) == len(texts)
    sizes = collections.Counter((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in texts)
    assert sizes == collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    slots = collections.defaultdict(list)
    for r in rows:
        assert (r.shard, r.grown_shard, r.law) == (jump(r.doc_id or 0, 24), jump(r.doc_id or 0, 25), "key")
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 24


def test_one_shard_and_no_rows(documents):
    assert {(r.shard, r.grown_shard in (0, 1)) for r in shard_rows(documents([(i, "x") for i in range(50)]), 1).collect()} == {(0, True)}
    assert shard_rows(documents([]), 24).collect() == []


def test_a_row_repeated_very_often_has_all_slots(documents):
    rows = shard_rows(documents([(5, "same")] * 700 + [(i, "x") for i in range(300)]), 3).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == 1000 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_run_no_python(documents):
    plan = shard_rows(documents(ODD), 24)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_token_counts_equal_the_library(documents):
    library = sentencepiece.SentencePieceProcessor(model_file=SP)
    want = collections.Counter((k, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for k, t in ODD)
    assert collections.Counter(tuple(r) for r in token_counts(documents(ODD), SP).collect()) == want
    assert token_counts(documents([]), SP).collect() == []
