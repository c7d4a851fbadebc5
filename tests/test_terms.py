import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filingforge.operators import features as K
from filingforge.operators import terms as T

WORDS = ["ai", "app", "data", "a a", "é", "über", "machine learning", "e-commerce", "x_y", "aa", "aaa", "ñandú", "ai", "日", ".net", "c++"]
PIECES = ["ai", "app", " ", "a", "-", "_", "data", "é", "über", "ñandú", "machine learning", "日", "e-commerce", " a a a ", "x_y", "🙂", "1", ".net", "c++"]


def texts_of(seed, n=150):
    rng = random.Random(seed)
    return [None if rng.random() < 0.05 else "".join(rng.choices(PIECES, k=rng.choice([0, 1, 5, 60, 700]))) for _ in range(n)]


@pytest.mark.parametrize(("strip", "window"), [(512, 1 << 22), (7, 64), (1, 1)])
def test_counts_equal_a_search_for_each_term(monkeypatch, strip, window):
    monkeypatch.setattr(T, "STRIP", strip)
    monkeypatch.setattr(T, "WINDOW", window)
    texts = texts_of(1) if strip > 1 else texts_of(1, 12)
    automaton = T.Automaton(WORDS)
    for whole in (True, False):
        edge = r"\b" if whole else ""
        want = [[len(re.findall(edge + re.escape(w) + edge, t or "")) for w in WORDS] for t in texts]
        assert T._counted(automaton, pa.array(texts, pa.string()), whole).tolist() == want
        assert T._counted(automaton, pa.array([None, *texts], pa.large_string())[1:], whole).tolist() == want


def test_long_lists_cost_no_more_than_short_ones():
    rng = random.Random(2)
    text = pa.array([" ".join(rng.choices(["alpha", "software", "cloud", "data", "ing", "term"], k=300_000)) for _ in range(2)])
    spent = {}
    for n in (35, 500):
        automaton = T.Automaton([f"{rng.choice('abcdef')}{rng.randint(0, 9999)}term{i}" for i in range(n - 2)] + ["software", "cloud"])
        T._counted(automaton, text, True)
        started = time.perf_counter()
        found = T._counted(automaton, text, True)
        spent[n] = time.perf_counter() - started
        assert found[0, -1] == len(re.findall(r"\bcloud\b", text[0].as_py()))
    assert spent[500] < 2 * spent[35] + 0.2


def test_near_terms_equal_windows(spark):
    rng = random.Random(3)
    names, context = ["bank", "ubs", "übs b", "kk"], ["offer", "underwriter", "oo"]
    texts = ["".join(rng.choices([*names, *context, "é", "日本", " ", "x" * 9, "o"], k=rng.choice([0, 3, 12, 40]))) for _ in range(200)] + [None]
    reach = 25
    want = []
    for t in texts:
        found = []
        for n, name in enumerate(names):
            around = [t[max(0, m.start() - reach) : m.end() + reach] for m in re.finditer(re.escape(name), t or "")]
            if any(c in a for a in around for c in context):
                found.append(n)
        want.append(found)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", T.near_terms(F.col("t"), names, context, reach).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == want


def test_holds_any(spark):
    df = spark.createDataFrame([(1, "A cloud."), (2, "none"), (3, None), (4, "")], "i int, t string").repartition(2)
    assert {r.i: r.h for r in df.select("i", T.holds_any(F.col("t"), ["cloud", "x"]).alias("h")).collect()} == {1: True, 2: False, 3: None, 4: False}


def test_names_are_counted_as_a_search_would():
    names = ["Al Al", "Jo Smith", "Jo Smith-Jones", "J. R. Ray", "Ann Lee", "Li Bo Li"]
    text = "Al Al Al Al Jo Smith-Jones, Jo Smith's; xJo Smith Jo Smith2 J. R. Ray Ann Lee_ Ann Lee. Li Bo Li Bo Li Ann\nLee Ann Leeé"
    assert T._names_counted(text, names) == [len(re.findall(r"\b" + re.escape(n) + r"\b", text)) for n in names]


def test_many_names_take_linear_time():
    def spent(n):
        text = " ".join(f"Jo{chr(97 + i % 26)}{'abcdefghij'[i // 26 % 10]} Sm{'ith' * (i % 3 + 1)}{chr(97 + i // 260 % 26)}{chr(97 + i // 6760 % 26)}," for i in range(n))
        names = sorted(set(re.findall(r"Jo\w+ Sm\w+", text)))
        started = time.perf_counter()
        counts = T._names_counted(text, names)
        assert sum(counts) == n
        return time.perf_counter() - started, len(text)

    spent(1000)
    (one, size), (two, _) = min(spent(25_000) for _ in range(3)), min(spent(50_000) for _ in range(3))
    assert size > 400_000 and two < 3 * one + 0.1


def test_person_candidates_of_a_long_text_end(spark):
    text = " ".join(f"Jane D{'o' * (i % 9 + 1)}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}." for i in range(16_000))
    rows = K.person_candidates(spark.createDataFrame([("a", text), ("b", None), ("c", "")], "symbol string, text string")).collect()
    assert sum(r.value for r in rows) == 16_000 and {r.symbol for r in rows} == {"a"}


def test_listed_words_are_a_table(spark):
    rows = spark.createDataFrame([("s", "Jane Doe", 1), ("s", "Acme  Group", 2), ("t", None, 3), ("t", "Group", 4), ("t", "Groups Ltd", 5)], "symbol string, element string, value int")
    words = spark.createDataFrame([("Group",), ("Group",), (None,)], "word string")
    assert {r.value for r in K.without_listed_words(rows, words).collect()} == {1, 3, 5}
    assert K.without_listed_words(rows, words.limit(0)).count() == 5


def test_characters_are_counted_in_windows(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(T, "WINDOW", 64)
    data = np.frombuffer(("aé€😀 " * 40).encode(), np.uint8)
    places = np.random.default_rng(1).integers(0, len(data) + 1, 500)
    assert T._characters_before(data, places).tolist() == [int(((data[:p] & 0xC0) != 0x80).sum()) for p in places]
    assert T._characters_before(data[:0], np.array([0, 0])).tolist() == [0, 0]
    monkeypatch.setattr(T, "WINDOW", 1 << 16)
    data, places = np.zeros(8 << 20, np.uint8), np.arange(100)
    tracemalloc.start()
    T._characters_before(data, places)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(data) // 4
