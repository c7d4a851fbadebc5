"""Many terms in one pass: an automaton of all terms (Aho and Corasick) over the flat bytes of an Arrow column.

The automaton is built once and travels with the job; its size goes by the list of terms. A task runs it over the bytes
of many texts at a time, cut into strips that are stepped side by side; strips overlap by the longest term, so that none
is lost at a cut, and terms that would run over the end of a text do not count. The cost goes by the bytes, not by the
number of terms. Texts are whole: a long one only takes more strips.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

#: Bytes of a strip, and bytes of text handled at once; a longer text is handled in windows of this size.
STRIP, WINDOW = 512, 1 << 22


class Automaton:
    """All places of all terms in a run of bytes."""

    def __init__(self, terms: list[str]):
        self.terms = [t.encode() for t in terms]
        if not all(self.terms):
            raise ValueError("a term is empty")
        letters = sorted({b for t in self.terms for b in t})
        self.letter = np.zeros(256, np.uint8 if len(letters) < 255 else np.int16)
        self.letter[letters] = np.arange(1, len(letters) + 1)
        self.lengths = np.array([len(t) for t in self.terms], np.int64)
        self.longest = int(self.lengths.max(initial=0))
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        self.same = np.arange(len(terms))  # equal terms share the place of the first
        for n, term in enumerate(self.terms):
            state = 0
            for b in term:
                if b not in children[state]:
                    children[state][b] = len(children)
                    children.append({})
                    ends.append(-1)
                state = children[state][b]
            ends[state] = n if ends[state] < 0 else ends[state]
            self.same[n] = ends[state]
        # Breadth first: what follows a state is what follows its longest proper suffix, but for its own children.
        table = np.zeros((len(children), len(letters) + 1), np.int32)
        suffix = [0] * len(children)
        self.shorter = np.full(len(children), -1)  # the next shorter state that ends a term
        queue = [0]
        for state in queue:
            table[state] = table[suffix[state]] if state else 0
            for b, child in children[state].items():
                suffix[child] = int(table[state, self.letter[b]]) if state else 0
                table[state, self.letter[b]] = child
                queue.append(child)
            if state:
                back = suffix[state]
                self.shorter[state] = back if ends[back] >= 0 else self.shorter[back]
        self.ends = np.array(ends)
        self.first_end = np.where(self.ends >= 0, np.arange(len(ends)), self.shorter)
        self.width = table.shape[1]
        self.table = (table * self.width).ravel()
        # Terms that can overlap themselves: their places are thinned as a search from left to right would.
        self.folded = np.array([any(t.startswith(t[i:]) for i in range(1, len(t))) for t in self.terms], bool)

    def find(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, term) of every occurrence, overlapping ones too, by end."""
        lead, lanes = self.longest - 1, -(-len(data) // STRIP)
        if not lanes or not self.terms:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        letters = np.zeros(lead + lanes * STRIP, self.letter.dtype)
        letters[lead : lead + len(data)] = self.letter[data]
        strips = np.lib.stride_tricks.sliding_window_view(letters, lead + STRIP)[::STRIP].T
        states = np.zeros(lanes, np.int32)
        seen = np.empty((STRIP, lanes), np.int32)
        for step in range(lead + STRIP):
            states = self.table[states + strips[step]]
            if step >= lead:
                seen[step - lead] = states
        seen = self.first_end[seen.T.ravel() // self.width]
        at = np.flatnonzero(seen >= 0)
        state = seen[at]
        places, terms = [], []
        while len(at):
            places.append(at + 1)
            terms.append(self.ends[state])
            state = self.shorter[state]
            at, state = at[state >= 0], state[state >= 0]
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        places, terms = np.concatenate(places), np.concatenate(terms)
        order = np.lexsort((terms, places))
        return places[order], terms[order]


def _word_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the characters that hold the bytes `at` are letters, digits or underscores; outside the text none is."""
    inside = (at >= 0) & (at < len(data))
    at = np.where(inside, at, 0)
    for _ in range(3):
        at = at - ((data[at] & 0xC0) == 0x80)
    ascii_ = np.array([chr(b).isalnum() or b == ord("_") for b in range(128)] + [False] * 128)
    word = ascii_[data[at]]
    wide = np.flatnonzero(inside & (data[at] >= 0xC0))
    if len(wide):
        bytes_ = [data[np.minimum(at[wide] + k, len(data) - 1)].astype(np.int64) for k in range(4)]
        low = [b & 0x3F for b in bytes_]
        two = ((bytes_[0] & 0x1F) << 6) | low[1]
        three = ((bytes_[0] & 0x0F) << 12) | (low[1] << 6) | low[2]
        four = ((bytes_[0] & 0x07) << 18) | (low[1] << 12) | (low[2] << 6) | low[3]
        points = np.where(bytes_[0] >= 0xF0, four, np.where(bytes_[0] >= 0xE0, three, two))
        kinds, places = np.unique(points, return_inverse=True)
        word[wide] = np.array([chr(p).isalnum() for p in kinds.tolist()], bool)[places]
    return word & inside


def _thinned(starts: np.ndarray, ends: np.ndarray, terms: np.ndarray, folded: np.ndarray) -> np.ndarray:
    """Which places stay if each term is searched from left to right and never within its last place."""
    kept = np.ones(len(starts), bool)
    for term in np.unique(terms[folded[terms]]):
        own = np.flatnonzero(terms == term)
        until = -1
        for k in own[np.argsort(starts[own], kind="stable")].tolist():
            kept[k] = starts[k] >= until
            until = int(ends[k]) if kept[k] else until
    return kept


def _bytes_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of the texts in them; null is empty."""
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, data = texts.buffers()
    if ends is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def places_of(automaton: Automaton, texts, whole_word: bool, overlapping: bool = False):
    """Arrays (row, start, end, term) of the places of all terms in an Arrow array of texts, by term and start; starts and
    ends count bytes of the texts together. A term is searched from left to right, so that its places do not overlap, unless
    `overlapping`."""
    data, offsets = _bytes_of(texts)
    found = []
    for at in range(0, len(data), WINDOW):
        since = max(0, at - automaton.longest + 1)
        ends, terms = automaton.find(data[since : at + WINDOW])
        new = ends + since > at
        found.append((ends[new] + since, terms[new]))
    ends, terms = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    starts = ends - automaton.lengths[terms]
    rows = np.searchsorted(offsets, starts, "right") - 1
    fits = ends <= offsets[rows + 1] if len(rows) else np.zeros(0, bool)
    if whole_word and len(rows):
        before = (starts > offsets[rows]) & _word_at(data, starts - 1)
        after = (ends < offsets[rows + 1]) & _word_at(data, ends)
        fits &= (_word_at(data, starts) != before) & (_word_at(data, ends - 1) != after)
    rows, starts, ends, terms = rows[fits], starts[fits], ends[fits], terms[fits]
    order = np.lexsort((starts, rows, terms))
    rows, starts, ends, terms = (x[order] for x in (rows, starts, ends, terms))
    kept = _thinned(starts, ends, terms, automaton.folded) if not overlapping else slice(None)
    return rows[kept], starts[kept], ends[kept], terms[kept], data, offsets


def _counted(automaton: Automaton, texts, whole_word: bool) -> np.ndarray:
    """(row, term) -> number of places."""
    n = len(automaton.terms)
    rows, _, _, terms, _, _ = places_of(automaton, texts, whole_word)
    counts = np.bincount(rows * n + terms, minlength=len(texts) * n).reshape(len(texts), n)
    return counts[:, automaton.same]


def term_counts(text: Column, terms: list[str], whole_word: bool = True) -> Column:
    """ARRAY<BIGINT>: how often each term occurs, as `\\b` around it would have it if `whole_word`. A null text has none."""
    automaton = Automaton(list(terms))

    @arrow_udf("array<bigint>")
    def counts(texts: pa.Array) -> pa.Array:
        found = _counted(automaton, texts, whole_word)
        ends = np.arange(len(texts) + 1, dtype=np.int32) * len(automaton.terms)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel().astype(np.int64)))

    return counts(text)


def holds_any(text: Column, terms: list[str], whole_word: bool = False) -> Column:
    """Whether a text holds any of the terms; for a list table, join words instead (`words_listed`)."""
    automaton = Automaton(list(terms))

    @arrow_udf("boolean")
    def held(texts: pa.Array) -> pa.Array:
        rows = places_of(automaton, texts, whole_word)[0]
        found = np.zeros(len(texts), bool)
        found[rows] = True
        return pa.array(found, mask=pc.is_null(texts).to_numpy(zero_copy_only=False))

    return held(text)


def _characters_before(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For byte places, the characters that begin before each, counted in windows: nothing is kept for every byte."""
    order = np.argsort(places, kind="stable")
    ordered, total = places[order], 0
    found = np.empty(len(places), np.int64)
    for at in range(0, max(len(data), 1), WINDOW):
        upto = np.r_[0, np.cumsum((data[at : at + WINDOW] & 0xC0) != 0x80)]
        low = np.searchsorted(ordered, at)
        high = np.searchsorted(ordered, at + WINDOW) if at + WINDOW < len(data) else len(ordered)
        found[order[low:high]] = total + upto[ordered[low:high] - at]
        total += int(upto[-1])
    return found


def near_terms(text: Column, names: list[str], context: list[str], reach: int, whole_word: bool = False) -> Column:
    """ARRAY<INT>: places in `names` of those with a place that has a context term beside it, wholly within the `reach`
    characters before its start or after its end; a term within the name itself is none. One pass gives the places of all names and context terms; two pointers meet them.
    `whole_word` is about the names."""
    automaton, around = Automaton(list(names)), Automaton(list(context))

    def met(texts) -> np.ndarray:
        rows, starts, ends, terms, data, _ = places_of(automaton, texts, whole_word)
        other_rows, other_starts, other_ends, others, _, _ = places_of(around, texts, False, overlapping=True)
        found = np.zeros((len(texts), len(names)), bool)
        if len(rows) and len(other_rows):
            # Rows lie apart by more than any reach, so that one sorted line holds them all.
            apart = len(data) + 4 * reach + 1
            start, end = (_characters_before(data, x) + rows * apart for x in (starts, ends))
            other_start, other_end = (_characters_before(data, x) + other_rows * apart for x in (other_starts, other_ends))
            for term in np.unique(others):
                own = others == term
                begins, stops = other_start[own], other_end[own]
                for low, high in ((start - reach, start), (end, end + reach)):
                    # The first context place from `low` on; later ones end later.
                    first = np.searchsorted(begins, low)
                    hit = first < len(begins)
                    hit[hit] = stops[first[hit]] <= high[hit]
                    found[rows[hit], terms[hit]] = True
        return found[:, automaton.same]

    @arrow_udf("array<int>")
    def near(texts: pa.Array) -> pa.Array:
        found = met(texts)
        ends = np.r_[0, np.cumsum(found.sum(axis=1))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(found)[1].astype(np.int32)))

    return near(text)


_TOKEN = re.compile(r"\w+")


def _names_counted(text: str, names: list[str]) -> list[int]:
    """How often each name, which begins with a word, stands in the text between word edges. One pass over the words of the
    text; at each, one look for every length of the names that begin with it."""
    wanted: dict[str, dict[int, set[str]]] = {}
    for name in names:
        wanted.setdefault(_TOKEN.match(name)[0], {}).setdefault(len(name), set()).add(name)
    found, until = dict.fromkeys(names, 0), dict.fromkeys(names, 0)
    for word in _TOKEN.finditer(text):
        start = word.start()
        for size, own in wanted.get(word[0], {}).items():
            end = start + size
            name = text[start:end]
            if name in own and start >= until[name] and (_TOKEN.match(name[-1]) is None) != (_TOKEN.match(text, end) is None):
                found[name] += 1
                until[name] = end
    return [found[n] for n in names]


def name_counts(text: Column, names: Column) -> Column:
    """ARRAY<BIGINT>: how often each of a text's own names occurs as whole words, as a search for each one would count it."""

    @arrow_udf("array<bigint>")
    def counts(texts: pa.Array, names: pa.Array) -> pa.Array:
        rows = [_names_counted(t, n) if t and n else [0] * len(n or ()) for t, n in zip(texts.to_pylist(), names.to_pylist())]
        return pa.array(rows, pa.list_(pa.int64()))

    return counts(text, names)
