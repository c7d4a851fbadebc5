import pytest

from filingforge.operators import html as H
from filingforge.plans import failures as P

FINE = "<table><tr><td>Cash</td><td>1</td></tr></table>"
PAGES = [
    ("fine", FINE),
    ("wide", FINE + "<table><tr><td>a</td><td colspan=300000000>b</td></tr></table>"),
    ("deep", "<table><tr><td>a</td><td rowspan=300000000>b</td></tr></table>"),
    ("square", "<table><tr><td colspan=90000 rowspan=90000>b</td></tr></table>"),
    ("ragged", "<table><tr><td colspan=90000>b</td></tr>" + "<tr><td>x</td></tr>" * 200 + "</table>"),
    ("number", f"<table><tr><td colspan={'9' * 5000}>b</td></tr></table>"),
    ("markup", FINE + "<![if" + FINE),
    ("bare", "<p>no table</p>"),
    ("empty", ""),
    ("none", None),
    ("fine", FINE),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(f, h, "x") for f, h in PAGES], "filing string, html string, error string")


def test_a_page_that_cannot_be_read_is_one_error_row(pages):
    found = H.html_table_results(pages).collect()
    errors = {r.filing: r.error for r in found if r.error}
    assert {"wide", "deep", "square", "ragged", "number"} <= set(errors)
    assert all("spans add more than 10000000 cells" in errors[f] for f in ("wide", "deep", "square", "ragged"))
    assert len([r for r in found if r.error]) == len(errors)
    assert all(r.table_id is None and r.cells is None for r in found if r.error)
    rows = [r for r in found if not r.error]
    assert [r.cells for r in rows if r.filing == "fine"] == [["Cash", "1"]] * 2
    assert not {r.filing for r in rows} & (set(errors) | {"bare", "empty", "none"})
    assert {r.filing for r in H.html_table_rows(pages).collect()} == {r.filing for r in rows}


def test_only_added_cells_count(spark):
    page = "<table>" + "<tr><td>a</td><td colspan=2>b</td></tr>" * 50 + "</table>"
    frame = spark.createDataFrame([("f", page)], "filing string, html string")
    assert H.html_table_results(frame, most_added=50).where("error is null").count() == 50
    assert [r.error for r in H.html_table_results(frame, most_added=49).collect()] == ["ValueError: spans add more than 49 cells"]


def test_failures_of_the_chain(pages, spark):
    failed = {(r.filing, r.stage): r.message for r in P.filing_failures(pages).collect()}
    assert failed["bare", "tables"] == failed["none", "tables"] == failed["empty", "tables"] == P.NOTHING
    assert failed["fine", "finance tables"] == P.NOTHING
    assert failed["wide", "tables"] == "ValueError: spans add more than 10000000 cells"
    assert len(failed) == len({f for f, _ in PAGES} | {"markup"})
    nothing = spark.createDataFrame([], "filing string, html string")
    assert P.filing_failures(nothing).collect() == []


def test_summary_and_first_failures(spark):
    rows = [(f"f{i:03d}", "tables" if i % 3 else "facts", "m") for i in range(25)] + [("f000", "facts", "m")]
    failed = spark.createDataFrame(rows, "filing string, stage string, message string")
    assert sorted(map(tuple, P.failure_summary(failed).collect())) == [("facts", "m", 9, "f000"), ("tables", "m", 16, "f001")]
    first = P.first_failures(failed, 10, order=["stage"]).collect()
    assert [r["rank"] for r in first] == list(range(1, 11)) and {r.n_more for r in first} == {16}
    assert [r.filing for r in first] == ["f000", "f000", *(f"f{i:03d}" for i in range(1, 9))]
    assert {r.n_more for r in P.first_failures(failed, 40).collect()} == {0}
    assert P.first_failures(failed.where("false")).collect() == []
