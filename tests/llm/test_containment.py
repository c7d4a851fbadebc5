import random

from filingforge.llm.containment import contained_items, without_items

from .conftest import ODD

ITEMS = "item_id long, text string, size int, hash string, sketch string"


def items_of(spark, pairs):
    return spark.createDataFrame([(i, t, 1, "h", "s") for i, t in pairs], ITEMS)


def cut(text, k):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(docs, items, percent=80):
    found = set()
    for key, text in docs:
        for item, passage in items:
            n = len((passage or "").split())
            if key is None or item is None or not n:
                continue
            k = min(5, n)
            parts = cut(passage, k)
            shared = len(parts & set().union(*(cut(t, k) for d, t in docs if d == key)))
            if 100 * shared >= percent * len(parts):
                found.add((key, item, len(parts), shared))
    return found


def test_equals_brute_force(spark, documents):
    rng = random.Random(4)
    draw = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    items = [(i, " ".join(draw(rng.choice([3, 5, 6, 15, 40, 41, 90])))) for i in range(40)] + [(40, None), (41, ""), (None, "w1 w2"), (42, "w5")]
    docs = [*ODD]
    for i in range(100, 260):
        words = draw(rng.choice([0, 4, 60, 3000]))
        passage = (rng.choice(items)[1] or "").split()
        for _ in range(rng.choice([0, 0, 1, 3, 8])):  # some passages lose more than may be lost
            if passage:
                passage[rng.randrange(len(passage))] = "changed"
        half = len(passage) // 2 if rng.random() < 0.3 else len(passage)  # the two halves of a passage far apart
        place = rng.randint(0, len(words))
        docs.append((i, " ".join(words[:place] + passage[:half] + words[place:] + passage[half:]).upper() if i % 2 else " ".join(words[:place] + passage + words[place:])))
    got = contained_items(documents(docs), items_of(spark, items))
    rows = {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got.collect()}
    assert rows == brute(docs, items) and len(rows) > 40


def test_documents_that_hold_items_go(spark, documents):
    item = " ".join(f"q{i}" for i in range(20))
    docs = [*ODD, (100, f"before {item} after"), (101, "clean text " * 9)]
    frame = documents(docs)
    left = without_items(frame, items_of(spark, [(1, item)]))
    assert left.columns == frame.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(repr, (d for d in docs if d[0] != 100)))


def test_empty_tables(spark, documents):
    assert contained_items(documents([]), items_of(spark, [(1, "a b c d e f")])).collect() == []
    assert contained_items(documents(ODD), items_of(spark, [])).collect() == []
