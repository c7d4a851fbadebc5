import random
import re

import pytest

from filingforge import vocabulary as V
from filingforge.operators import statements as S
from filingforge.plans.documents import analyze_documents


def _docs(spark, docs):
    rows = [(d, i, line) for d, lines in docs.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "doc string, row_idx long, cells array<string>")


def test_clean_documents(spark):
    rows = _docs(spark, {"d": [[None, None, None], ["a", None, "—"], [None, None, None], ["N/A", None, "b"]]})
    got = sorted((r.row_idx, r.cells) for r in S.clean_documents(rows).collect())
    assert got == [(0, ["a", None]), (1, [None, "b"])]


def test_document_type(spark):
    docs = {
        "none": [["x"]], "tie": [["Claims", "Loans"]], "prospectus": [["Prospectus of Securities"], ["the offering"]],
        "cells": [["Trust", "Account"]], "rows": [["x", "Trust"], ["Account", "y"]], "null between": [["Trust", None, "Account"]],
        "narrow": [["Assets"], ["Under"], ["Management"], ["x"]],
        "wide": [["a", "Net Interest"], ["Margin", "b"]],
    }
    got = {r.doc: r.document_type for r in S.document_type(_docs(spark, docs)).collect()}
    assert got == {
        "none": "unknown", "tie": "insurance", "prospectus": "prospectus", "cells": "spac", "rows": "spac", "null between": "unknown",
        "narrow": "investment", "wide": "banking",
    }


def test_type_and_dates_against_whole_texts(spark):
    pick = random.Random(11)
    words = ["Trust", "Account", "Net", "Interest", "Margin", "Balance", "Sheet", "March", "5,", "5", "2020", "1/2/2020", "2020-1-2", None, "x", "Loss Ratio", "March 7", " ", "  "]
    docs = {
        f"d{n}": [[pick.choice(words) for _ in range(width)] if pick.random() < 0.7 else [" "] * width for _ in range(pick.randint(1, 14))]
        for n in range(250) for width in [pick.randint(1, 4)]
    }
    types, dates = {}, set()
    for doc, lines in docs.items():
        text = " ".join("nan" if c is None else c for line in lines for c in line)
        score = [sum(t.lower() in text.lower() for t in terms) for _, terms in V.DOCUMENT_TYPES]
        types[doc] = V.DOCUMENT_TYPES[score.index(max(score))][0] if max(score) else "unknown"
        dates |= {(doc, " ".join(d.split())) for p in V.DOCUMENT_DATE_PATTERNS for d in re.findall(p, text, re.I)}
    df = _docs(spark, docs)
    assert {r.doc: r.document_type for r in S.document_type(df).collect()} == types
    assert {tuple(r) for r in S.document_date_list(df).collect()} == dates and len(dates) > 50


def test_dates_run_over_blank_cells(spark):
    rows = _docs(spark, {"d": [["x", "December"], [" ", "31,"], ["1995", "y"]], "e": [["May", " "], [" ", "5", " "], [" ", "2001"]]})
    assert {tuple(r) for r in S.document_date_list(rows).collect()} == {("d", "December 31, 1995"), ("e", "May 5 2001")}


@pytest.mark.parametrize("between", [1, 3, 5000])
def test_dates_run_over_rows_of_blanks(spark, between):
    gap = [[" ", "  "]] * between
    rows = _docs(spark, {
        "d": [["x", "December"], *gap, ["31,", "1995"]], "e": [*gap, ["May", " "], *gap, [" ", "5"], *gap, ["2001", " "], *gap],
        "t": [["a", "Trust"], *gap, ["Account", "b"]], "n": [["x", "May 5,"], [" ", None], *gap, ["2001", "y"]],
    })
    assert {tuple(r) for r in S.document_date_list(rows).collect()} == {("d", "December 31, 1995"), ("e", "May 5 2001")}
    assert {r.doc: r.document_type for r in S.document_type(rows).collect()} == dict.fromkeys("dent", "unknown")


def test_more_terms_than_a_mask_holds(spark):
    types = [("many", [f"term{i}" for i in range(150)]), ("few", ["term149 x"])]
    rows = _docs(spark, {"a": [["term149 x"]], "b": [["term7", "term70", "term149 x"]], "c": [["nothing"]]})
    assert {r.doc: r.document_type for r in S.document_type(rows, types).collect()} == {"a": "many", "b": "many", "c": "unknown"}


def test_company_name(spark):
    docs = {
        "d": [["x", None], ["Acme (US) Holdings, Inc.", "Other Corp."]], "late": [["x"]] * 10 + [["Late Inc."]], "short": [["llc"], ["Company A"]],
    }
    got = {r.doc: r.company_name for r in S.company_name(_docs(spark, docs)).collect()}
    assert got == {"d": "Acme US Holdings, Inc.", "late": "Unknown Company", "short": "Company A"}


def test_line_items(spark):
    docs = {"d": [
        ["working capital (deficiency)", "$", "(512,320", ")"], ["total liabilities and shareholder’s equity", None, "$", "523475"],
        ["total assets", None, None, None], ["Current Ratio", "1.25", None, None], ["Current ratio", "n/a", None, None],
    ]}
    features = S.row_features(_docs(spark, docs))
    got = [(r.item, r.row_index, r.values, r.raw_text) for r in S.line_items(features, ["balance_sheet"]).orderBy("row_index").collect()]
    assert got == [
        ("working capital", 0, [-512320.0], "working capital (deficiency) $ (512,320 )"),
        ("total liabilities", 1, [523475.0], "total liabilities and shareholder’s equity $ 523475"),
    ]
    ratios = S.line_items(features, ["key_metrics"]).collect()
    assert [(r.row_index, r.ratios, r.values) for r in ratios] == [(3, [1.25], [1.25])]


def test_monetary_cells(spark):
    rows = _docs(spark, {"d": [["0", "1.0"], ["x, 31, 2020", "(512,320"]]})
    got = sorted(map(tuple, S.monetary_cells(rows).drop("doc").collect()))
    assert got == [
        (0, 0, 0, "0", 0.0, False), (0, 1, 0, "1.0", 1.0, False), (1, 0, 1, "31,", 31.0, False), (1, 0, 2, "2020", 2020.0, False),
        (1, 1, 0, "(512,320", -512320.0, True),
    ]


def test_metrics_take_the_last_row(spark):
    features = S.row_features(_docs(spark, {"d": [
        ["total assets", "5", "9"], ["Total Assets", "7", "3"], ["total assets", None, None], ["net income", "4", "8"],
        ["total deposits", "6", "2"], ["combined ratio", "1.25", "2.50"], ["trust", "(3", "1"],
    ]}))
    got = {(r.kind, r.metric): r.value for r in S.document_metrics(features).collect() if r.value is not None}
    assert got == {
        ("general", "total_assets"): 7.0, ("spac", "total_assets"): 7.0, ("general", "net_income"): 4.0,
        ("banking", "total_deposits"): 6.0, ("insurance", "combined_ratio"): 1.25, ("spac", "trust_account_value"): 1.0,
    }


def test_analysis_keeps_both_kinds_of_metrics(spark):
    rows = _docs(spark, {"a": [["Total assets", "5"], ["current ratio 1.25", None]], "b": [[None]]})
    documents = spark.createDataFrame([("a",), ("b",), ("c",)], "doc string")
    got = {r.doc: r for r in analyze_documents(rows, documents).collect()}
    assert got["a"].status == "success" and got["a"].key_metrics == {"total_assets": 5.0} and got["a"].key_metric_rows == 1
    assert got["b"].status == got["c"].status == "failed" and got["c"].n_values == 0


def test_first_items_and_dates(spark):
    rows = _docs(spark, {"d": [["sales 1"]] * 9 + [["May 1, 2020 May 2, 2020 May 3, 2020 May 4, 2020"]]})
    items = S.first_items(S.line_items(S.row_features(rows), ["income_statement"]))
    assert sorted(r.row_index for r in items.collect()) == [0, 1, 2, 3, 4]
    assert S.first_dates(S.document_date_list(rows)).count() == 3


def test_hot_document_is_renumbered_over_many_runs(spark):
    rows = spark.range(20_000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('d', id % 50)) as doc", "id as row_idx",
        "array(if(id % 5 = 0, null, string(id)), null, if(id = 9, 'x', null)) as cells",
    )
    got = {}
    for r in S.clean_documents(rows).collect():
        got.setdefault(r.doc, {})[r.row_idx] = r.cells
    want = {}
    for i in range(20_000):
        if i % 5 and i != 9 or i == 9:
            doc = "hot" if i % 3 == 0 else f"d{i % 50}"
            lines = want.setdefault(doc, {})
            lines[len(lines)] = [str(i)] + (["x" if i == 9 else None] if doc == "hot" else [])
    assert got == want


def test_first_items_of_the_workload_are_of_every_statement(spark):
    from workload.documents import document_first_items

    rows = document_first_items(spark, "/root/testdata/sf0.001").collect()
    assert {"balance_sheet", "income_statement"} <= {r.statement for r in rows} and max(r["rank"] for r in rows) == 5
