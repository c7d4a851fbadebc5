"""Pre-tokens of public vocabularies as ragged arrays: texts to code points, cuts, symbols, and merged ids.

Both tokenizers find the distinct pre-tokens of a slice by a 64-bit hash, merge only these (`ragged_bpe`), and put
the results back for every occurrence.
"""

import json

import numpy as np

from .ragged_bpe import PairTable, encode
from .text_arrays import Hasher, flat_bytes, mix, spans_of

_LAST = 0x110000
_SPACE = 0x2581  # stands for a blank in the pieces


def _code_points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)


def _heads(data: np.ndarray) -> np.ndarray:
    """Places of the bytes that begin a code point."""
    return np.flatnonzero((data & 0xC0) != 0x80)


class _Seen:
    """Results of pre-tokens by hash, kept from slice to slice; emptied when it holds MOST, which changes no result."""

    MOST = 1 << 19

    def __init__(self):
        self._empty()

    def _empty(self):
        self.keys = np.zeros(0, np.uint64)
        self.first = self.size = np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def get(self, keys: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """First place and size in `flat` for ascending distinct keys; make(indices) gives the values of new ones and their sizes."""
        if len(self.keys) > self.MOST:
            self._empty()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        lost = np.flatnonzero(new)
        if len(lost):
            values, sizes = make(lost)
            if self.used + len(values) > len(self.flat):
                self.flat = np.r_[self.flat[: self.used], np.zeros(self.used + 2 * len(values), np.int32)]
            self.flat[self.used : self.used + len(values)] = values
            firsts = self.used + np.cumsum(sizes) - sizes
            self.used += len(values)
            self.keys = np.insert(self.keys, at[lost], keys[lost])
            self.first = np.insert(self.first, at[lost], firsts)
            self.size = np.insert(self.size, at[lost], sizes)
            at = np.searchsorted(self.keys, keys)
        return self.first[at], self.size[at]


class SentencePieces:
    """Counts by a sentencepiece BPE model with byte fallback, identity normalisation and a leading blank."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        read = proto.ModelProto()
        read.ParseFromString(model)
        spec, norm = read.trainer_spec, read.normalizer_spec
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        if spec.model_type != 2 or not spec.byte_fallback or spec.treat_whitespace_as_suffix or not plain:
            raise ValueError("not a BPE model with byte fallback and identity normalisation")
        normal = [(p.piece, p.score) for p in read.pieces if p.type == 1]
        if any(a != "▁" and b == "▁" for piece, _ in normal for a, b in zip(piece, piece[1:])):
            raise ValueError("pieces run over blanks")
        order = {s: r for r, s in enumerate(sorted({s for _, s in normal}, reverse=True))}
        ids = {piece: i for i, (piece, _) in enumerate(normal)}
        singles = sorted({c for piece in ids for c in piece} - ids.keys())
        names = ids | {c: len(ids) + i for i, c in enumerate(singles)}  # parts of pieces that are none themselves
        rows = [
            (names[piece[:cut]], names[piece[cut:]], ids[piece], order[score])
            for piece, score in normal for cut in range(1, len(piece)) if piece[:cut] in names and piece[cut:] in names
        ]
        self.table = PairTable(*zip(*rows))
        self.known = len(ids)
        self.unknown = len(names)
        self.char = np.full(_LAST, self.unknown, np.int32)
        for name, i in names.items():
            if len(name) == 1:
                self.char[ord(name)] = i
        self.width = np.ones(_LAST, np.uint8)
        self.width[0x80:], self.width[0x800:], self.width[0x10000:] = 2, 3, 4
        #: Tokens of a symbol that is left: a piece is one, other characters are their bytes.
        self.bytes_of = np.ones(len(names) + 1, np.int64)
        self.bytes_of[len(ids) : -1] = [len(c.encode()) for c in singles]
        values = mix(np.arange(1, _LAST + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
        self.values = values
        self.hasher, self.seen = Hasher(), _Seen()

    def counts(self, column) -> np.ndarray:
        """Number of tokens of every text."""
        data, offsets = flat_bytes(column)
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(n, np.int64)
        points = _code_points(data).astype(np.int64)
        starts = np.searchsorted(_heads(data), offsets)  # texts in code points
        full = np.flatnonzero(np.diff(starts))
        points[points == 32] = _SPACE
        points = np.insert(points, starts[full], _SPACE)
        starts = starts[full] + np.arange(len(full))
        symbols = self.char[points]
        odd = symbols == self.unknown
        blank = points == _SPACE
        cut = odd.copy()
        cut[1:] |= odd[:-1] | (blank[1:] & ~blank[:-1])
        cut[starts] = True
        first = np.flatnonzero(cut)
        last = np.r_[first[1:], len(points)]
        owner = full[np.searchsorted(starts, first, "right") - 1]
        odd_first = odd[first]
        out = np.bincount(owner[odd_first], weights=self.width[points[first[odd_first]]], minlength=n).astype(np.int64)
        first, last, owner = first[~odd_first], last[~odd_first], owner[~odd_first]
        if not len(first):
            return out
        self.hasher._grow(len(points))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(self.values[points] * self.hasher.powers[: len(points)], out=sums[1:])
        keys, at, back = np.unique(self.hasher.ranges(sums, first, last), return_index=True, return_inverse=True)

        def make(which):
            a, lengths = first[at[which]], (last - first)[at[which]]
            left, ends = encode(symbols[spans_of(a, lengths)], np.r_[0, np.cumsum(lengths)], self.table)
            return np.add.reduceat(self.bytes_of[left], ends[:-1]), np.ones(len(which), np.int64)

        places, _ = self.seen.get(keys, make)
        return out + np.bincount(owner, weights=self.seen.flat[places][back], minlength=n).astype(np.int64)


class ByteLevel:
    """Ids by a byte-level BPE vocabulary of the `tokenizers` library, without added tokens."""

    #: Fixed: characters that stand for bytes in the vocabulary file.
    @staticmethod
    def _letters() -> dict[str, int]:
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}

    def __init__(self, text: str):
        import regex

        spec = json.loads(text)
        vocabulary, letters = spec["model"]["vocab"], self._letters()
        if spec["normalizer"] or spec["pre_tokenizer"].get("add_prefix_space") or not spec["pre_tokenizer"]["use_regex"]:
            raise ValueError("not a plain byte-level vocabulary")
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.table = PairTable(
            [vocabulary[a] for a, _ in merges], [vocabulary[b] for _, b in merges], [vocabulary[a + b] for a, b in merges],
            range(len(merges)),
        )
        self.byte = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.byte[b] = vocabulary[letter]
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.text = text
        every = np.r_[:0xD800, 0xE000:_LAST].astype("<u4").tobytes().decode("utf-32-le")
        self.kind = np.zeros(_LAST, np.uint8)  # 0 other, 1 letter, 2 number, 3 white space
        for k, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
            for found in regex.finditer(pattern, every):
                a, b = ord(every[found.start()]), ord(every[found.end() - 1])
                self.kind[a : b + 1] = k
        self.hasher, self.seen = Hasher(), _Seen()

    def _cuts(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """True where a pre-token begins."""
        n = len(points)
        kind = self.kind[points]
        border = np.zeros(n + 1, bool)
        border[starts] = border[n] = True
        turn = border[:n].copy()
        turn[1:] |= kind[1:] != kind[:-1]
        white = kind == 3
        blank = points == 32
        begins = turn.copy()
        joined = np.zeros(n, bool)  # the character before is a blank of the same text, which it takes along
        joined[1:] = blank[:-1] & ~border[1:n]
        begins &= white | ~joined
        ends = np.zeros(n, bool)  # the last white space before other characters of the text stands alone or joins them
        ends[:-1] = white[:-1] & ~white[1:] & ~border[1:n]
        begins |= ends
        marks = np.flatnonzero((points == 39) & begins)
        if len(marks):
            after = np.full((len(marks), 2), -1, np.int64)
            for j in (1, 2):
                at = marks + j
                inside = at < n
                inside[inside] &= ~border[at[inside]]
                if j == 2:
                    inside &= after[:, 0] >= 0
                after[inside, j - 1] = points[at[inside]]
            one = np.isin(after[:, 0], [ord(c) for c in "stmd"])
            two = np.zeros(len(marks), bool)
            for a, b in ("re", "ve", "ll"):
                two |= (after[:, 0] == ord(a)) & (after[:, 1] == ord(b))
            for hit, size in ((one, 2), (two & ~one, 3)):
                at = marks[hit]
                begins[at + 1] = False
                follow = at + size
                begins[follow[follow < n]] = True
        return begins

    def ids(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the offsets of the texts in them."""
        data, offsets = flat_bytes(column)
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        raw = data.tobytes()
        if any(a.encode() in raw for a in self.added):  # their strings are cut out first: leave such texts to the library
            texts = [x or "" for x in column.to_pylist()]
            special = [any(a in t for a in self.added) for t in texts]
            if any(special):
                import pyarrow as pa
                from tokenizers import Tokenizer

                whole = Tokenizer.from_str(self.text)
                plain, at = self.ids(pa.array([None if s else t for s, t in zip(special, texts)], pa.string()))
                parts = [
                    np.array(whole.encode(t, add_special_tokens=False).ids, np.int32) if s else plain[at[i] : at[i + 1]]
                    for i, (s, t) in enumerate(zip(special, texts))
                ]
                return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
        points = _code_points(data)
        heads = _heads(data)
        starts = np.searchsorted(heads, offsets)
        begins = heads[self._cuts(points, starts[:-1][np.diff(starts) > 0])]
        ends = np.r_[begins[1:], len(data)]
        hashes = self.hasher.ranges(self.hasher.sums(data, False), begins, ends)
        keys, at, back = np.unique(hashes, return_index=True, return_inverse=True)

        def make(which):
            a, lengths = begins[at[which]], (ends - begins)[at[which]]
            merged, bounds = encode(self.byte[data[spans_of(a, lengths)]], np.r_[0, np.cumsum(lengths)], self.table)
            return merged, np.diff(bounds)

        places, sizes = self.seen.get(keys, make)
        sizes = sizes[back]
        total = np.r_[0, np.cumsum(sizes)]
        owner = np.searchsorted(begins, offsets)  # the first pre-token of each text
        return self.seen.flat[spans_of(places[back], sizes)], total[owner]
