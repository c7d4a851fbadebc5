import random
import re

from filingforge.operators import columns as C
from filingforge.operators import features as K
from filingforge.plans.text_features import feature_association, filing_features

DENIED = ["Capital", "Company", "ParagraphEnterprise"]


def test_keyword_counts(spark):
    docs = spark.createDataFrame([("a", "AI, ai-driven e-commerce; said Machine  learning machine learning éai"), ("b", "")], "symbol string, text string")
    got = {(r.symbol, r.element): r.value for r in K.keyword_counts(docs, ["ai", "e-commerce", "machine learning"]).collect()}
    assert got == {("a", "ai"): 2, ("a", "e-commerce"): 1, ("a", "machine learning"): 1} | {("b", t): 0 for t in ("ai", "e-commerce", "machine learning")}
    assert K.keyword_counts(docs).count() == 70
    first = [tuple(r) for r in K.keyword_frequency(docs, ["ai", "app", "e-commerce"]).where("symbol = 'a'").collect()]
    assert first == [("a", "ai", 2), ("a", "e-commerce", 1), ("a", "app", 0)]


def test_person_name(values_of):
    cases = {
        "Jane Doe": True, "Mary-Ann Le Roy": True, "J. Smith": True, "Jane": False, "Jane Capital": False, "jane Doe": False,
        "José Cruz": False, "A Smith": False, "Paragraph Smith": True, "Jane Doe 2": False, "Al B Co Do": False, "Jane O'Neil": False,
        "Jane " + "X" + "y" * 15: False, "": False,
    }
    assert values_of(lambda n: K.is_person_name(n, DENIED), list(cases)) == list(cases.values())


def test_person_candidates(spark):
    docs = spark.createDataFrame([("a", "Jane Doe met Bob Capital. Later Jane Doe, and J. Q. Public left. Jane Does not.")], "symbol string, text string")
    got = {r.element: r.value for r in K.person_candidates(docs, DENIED).collect()}
    assert got["Jane Doe"] == 2 and got["J. Q. Public"] == 1 and "Bob Capital" not in got


def test_underwriters_in_tables(spark):
    tables = spark.createDataFrame(
        [("a", "<td>Lead <b>Man</b>ager</td><td>Citigroup, our subsidiary</td>"), ("b", "<td>Citigroup</td>")], "symbol string, table_html string"
    )
    assert {tuple(r) for r in K.underwriters_in_tables(tables).collect()} == {("a", "Citigroup"), ("a", "Citi"), ("a", "Ubs")}


def test_underwriters_in_context(spark):
    pages = [
        ("near", "offering" + "-" * 192 + "citi"), ("far", "offering" + "-" * 193 + "citi"), ("after", "citi" + "-" * 192 + "offering"),
        ("sub", "the subsidiary makes an offering"), ("second", "citi" + "-" * 500 + "citi\n underwriter"), ("odd", "bmO capital offering"),
    ]
    df = spark.createDataFrame(pages, "symbol string, html string")
    assert {tuple(r) for r in K.underwriters_in_context(df).collect()} == {
        ("near", "Citi"), ("after", "Citi"), ("sub", "Ubs"), ("second", "Citi"),
    }
    assert {r.symbol for r in K.underwriters_in_context(df, whole_word=True).collect()} == {"near", "after", "second"}


def test_context_against_a_loop(spark):
    pick = random.Random(3)
    pages = [(str(i), "".join(pick.choice(["citi", "ubs", "offering", "lead manager", "x" * 60, "y" * 45, " "]) for _ in range(12))) for i in range(200)]
    want = set()
    for symbol, page in pages:
        for bank in ("citi", "ubs"):
            for m in re.finditer(bank, page):
                around = page[max(0, m.start() - 200) : m.end() + 200]
                if any(t in around for t in ("underwriter", "book-running", "lead manager", "offering")):
                    want.add((symbol, bank.title()))
    df = spark.createDataFrame(pages, "symbol string, html string")
    assert {tuple(r) for r in K.underwriters_in_context(df, ["citi", "ubs"]).collect()} == want


def test_rows_and_suffixes(spark):
    one = "symbol string, element string, value long"
    rows = K.feature_rows(
        spark.createDataFrame([("a", "ai", 0)], one), spark.createDataFrame([("a", "Goldman Sachs", 3)], one),
        spark.createDataFrame([("a", "Goldman Sachs"), ("a", "Goldman Sachs")], "symbol string, element string"),
    )
    assert {tuple(r) for r in K.suffix_duplicates(rows).collect()} == {
        ("a", "ai", 0, "keyword"), ("a", "Goldman Sachs", 3, "Person"), ("a", "Goldman Sachs.1", 1, "underwriter"),
    }


def test_column_droppers(spark):
    wide = spark.createDataFrame([(1, 2, 3)], "Symbol int, `Hong Kong` int, Cashier int")
    assert C.drop_columns(wide, ["Symbol", "none"]).columns == ["Hong Kong", "Cashier"]
    assert C.drop_columns_containing(wide, ["Cash", "cash"]).columns == ["Symbol", "Hong Kong"]
    assert C.drop_listed_columns(wide, spark.createDataFrame([("Hong Kong",), ("x",)], "column_name string")).columns == ["Symbol", "Cashier"]
    assert C.lowercase_columns(wide).columns == ["symbol", "hong kong", "cashier"]
    try:
        C.drop_columns(wide, ["none"], ignore_missing=False)
        raise AssertionError("a missing column must fail")
    except KeyError:
        pass


def test_batches_take_the_next_existing_row(spark):
    rows = spark.range(0, 20).selectExpr("id * 3 as pos", "id")
    existing = rows.where("id not in (5, 6, 10)")
    got = C.batch_slices(rows, existing, [(0, 5), (5, 10), (10, 15), (15, 40)], "pos", ["id"])
    found = {}
    for r in got.collect():
        found.setdefault(r.batch, []).append(r.id)
    assert {b: sorted(ids) for b, ids in found.items()} == {
        0: [0, 1, 2, 3, 4, 7], 1: [7, 8, 9, 11], 2: [11, 12, 13, 14, 15], 3: [15, 16, 17, 18, 19],
    }


def test_batches_of_a_size(spark):
    rows = spark.range(0, 230).selectExpr("id * 3 as pos", "id")
    for gone in ("id between 10 and 47 or id in (5, 60, 61) or id > 200", "id < 33", "id = -1", "true"):
        existing = rows.where(f"not ({gone})")
        want = C.batch_slices(rows, existing, [(n, n + 10) for n in range(0, 230, 10)], "pos", ["id"]).select("batch", "id", "pos", "position")
        got = C.sized_batches(rows, existing, 10, "pos", ["id"]).select("batch", "id", "pos", "position")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_the_plan_does_not_grow_with_the_batches(spark, monkeypatch):
    from workload import catalogs

    def aggregates():
        plan = catalogs.batch_slice(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("min(")

    few = aggregates()
    monkeypatch.setattr(catalogs, "_BATCH", 20)
    assert aggregates() == few


def test_features_to_association(spark):
    pages = [(f"s{i}", f"<p>{'cloud ' * (i % 4)} Jane Doe.</p>" + ("<table><td>underwriter citigroup</table>" if i % 2 else "")) for i in range(20)]
    features = filing_features(spark.createDataFrame(pages, "symbol string, html string"), terms=["cloud", "ai"])
    assert features.where("element = 'Jane Doe' and kind = 'Person'").count() == 20
    assert features.where("element = 'Citigroup'").count() == 10
    catalog = spark.createDataFrame([(f"s{i}", float(i % 4 - 1)) for i in range(20)], "symbol string, diff double")
    got = {r.column: (r.positive_mean, r.negative_mean, r["count"]) for r in feature_association(features, catalog, ["Jane"]).collect()}
    assert got == {}  # no feature has values on both sides of zero
    catalog = spark.createDataFrame([(f"s{i}", 1.0 if i < 10 else -1.0) for i in range(20)], "symbol string, diff double")
    got = {r.column: r["count"] for r in feature_association(features, catalog, ["Jane"]).collect()}
    assert got == {"cloud": 15, "Citigroup": 10, "Citi": 10}
