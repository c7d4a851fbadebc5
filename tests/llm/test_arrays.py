import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from filingforge.llm import ragged_bpe
from filingforge.llm.pieces import ByteLevel, SentencePieces
from filingforge.llm.text_arrays import BATCH_BYTES, Hasher, flat_bytes, shingle_sets, shingles, slices

ODD = [
    "", None, "  a  b ", "a\nb\tc", "<s> hi </s> <unk>", "\x00x", "日本語𐍈", "a　b", "<0x0A>", "▁a", "it's they'll 'so ''s we're\n's 'll  've x'rex",
    "a" * 1000, " " * 500 + "x", "ab" * 700, "the " * 50, "x<|endoftext|>y z", "  \n\n  a", "a  \n", "12 345x7 !!a!!'s", " 's", "\xa0a b", "﻿x", "a\r\nb",
]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("a b'stlre\n !1\té▁ñ日") for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def pieces():
    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return SentencePieces(f.read()), sentencepiece.SentencePieceProcessor(model_file=path)


@pytest.fixture(scope="module")
def bytes_():
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return ByteLevel(f.read()), Tokenizer.from_file(path)


@pytest.mark.parametrize("texts", [ODD, random_texts(300, 1), ["x" * 1, *random_texts(50, 2), ""], []])
def test_piece_counts_equal_the_library(pieces, texts):
    ours, library = pieces
    assert ours.counts(pa.array(texts, pa.string())).tolist() == [len(library.encode(t or "")) for t in texts]


@pytest.mark.parametrize("texts", [ODD, random_texts(300, 3), []])
def test_byte_ids_equal_the_library(bytes_, texts):
    ours, library = bytes_
    ids, at = ours.ids(pa.array(texts, pa.string()))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want


def test_a_full_memory_changes_nothing(pieces, monkeypatch):
    ours, library = pieces
    monkeypatch.setattr(type(ours.seen), "MOST", 3)
    texts = random_texts(40, 5)
    for _ in range(3):
        assert ours.counts(pa.array(texts)).tolist() == [len(library.encode(t)) for t in texts]


def test_long_sequences_take_the_same_merges(monkeypatch):
    table = ragged_bpe.PairTable([0, 3, 1, 3], [1, 2, 1, 3], [3, 4, 5, 6], [0, 1, 2, 3])
    rng = np.random.default_rng(0)
    symbols = rng.integers(0, 3, 4000)
    offsets = np.arange(0, 4001, 40)
    short, ends = ragged_bpe.encode(symbols, offsets, table)
    monkeypatch.setattr(ragged_bpe, "LONG", 5)
    long, ends2 = ragged_bpe.encode(symbols, offsets, table)
    assert short.tolist() == long.tolist() and ends.tolist() == ends2.tolist()


def test_words_and_shingles_equal_plain_python():
    texts = [t or "" for t in ODD] + ["The the THE", "a b c d", "b c d a b c d", "É é", "x"]
    hasher = Hasher()
    data, offsets = flat_bytes(pa.array(texts))
    words, owner = hasher.words(data, offsets)
    lowered = [re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    assert np.bincount(owner, minlength=len(texts)).tolist() == [len(w) for w in lowered]
    names = {}
    for h, w in zip(words.tolist(), [w for ws in lowered for w in ws]):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    sets, at = shingle_sets(hasher, pa.array(texts), 3)
    plain = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} - {()} for w in lowered]
    assert np.diff(at).tolist() == [len(s) for s in plain]
    ours = [set(sets[a:b].tolist()) for a, b in zip(at[:-1], at[1:])]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(ours[i] & ours[j]) == len(plain[i] & plain[j])
    assert len(shingles(words[:0], owner[:0], 3)[0]) == 0


def test_slices_keep_every_row():
    column = pa.array(["a" * 100, None, "", "b" * 3000, "c"] * 5)
    parts = list(slices([pa.RecordBatch.from_arrays([column], ["text"])], "text", 500))
    assert pa.concat_arrays([p.column(0) for p in parts]).to_pylist() == column.to_pylist() and len(parts) > 5


def test_stages_of_the_pipeline_pass_small_batches(spark, monkeypatch):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)]), pa.array([batch.nbytes])], ["n", "size"])

    monkeypatch.setattr(corpus_pipeline, "masked", lambda docs: docs.mapInArrow(sizes, "n long, size long"))
    docs = spark.range(0, 3000, 1, 2).selectExpr("id AS doc_id", "repeat('word ', 400 + cast(id % 200 AS int)) AS text")
    try:
        found = corpus_pipeline.personal_data(spark, docs, "").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert sum(r.n for r in found) == 3000 and max(r.size for r in found) < 2 * BATCH_BYTES
