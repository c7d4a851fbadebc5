import datetime

import pytest
from pyspark.sql import functions as F

from filingforge.functions import dates, labels, numbers
from filingforge.operators.facts import period_context_filter


def test_parse_amount(values_of):
    cases = {
        "$(21.94)": -21.94, "$46,624": 46624.0, "(631)": -631.0, "1,234.5": 1234.5, "$100 (1)": -100.0,
        "about $5 each": 5.0, "(631": None, "-5": None, ",": None, "12%": None, None: None, "": None, "$,": None,
    }
    assert values_of(numbers.parse_amount, list(cases)) == list(cases.values())


def test_money_value(values_of):
    cases = {
        "(512,320": -512320.0, "$5,000,001": 5000001.0, "31,": 31.0, "$0.0001": 0.0001, "(1)": -1.0,
        "5M": 5e6, "(2)K": -2000.0, ",": None, "1.5b": 1.5e9, "7.": 7.0,
    }
    assert values_of(numbers.money_value, list(cases)) == list(cases.values())


def test_money_tokens(values_of):
    assert values_of(numbers.money_tokens, ["pay $5,000.50 or (3M), net 12"]) == [["$5,000.50", "(3M", ",", "12"]]
    assert values_of(numbers.money_values, ["pay $5,000.50 or (3M), net 12"]) == [[5000.5, -3e6, 12.0]]


def test_ratio_values(values_of):
    found = values_of(numbers.ratio_values, ["2.5x and 15.5% or 1.234", "15.5%p", "2.5X", "1.2345", "no"])
    assert found == [[2.5, 1.234], [15.5], [], [], []]


def test_humanize_money(spark):
    cases = [
        (1.25e9, "$1.2B"), (-3.45e6, "-$3.5M"), (1250.0, "$1.2K"), (999.999, "$1,000.00"), (-0.5, "-$0.50"),
        (0.0, "$0.00"), (None, "N/A"), (float("nan"), "N/A"), (1.5e13, "$15000.0B"),
    ]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v double")
    shown = [r[0] for r in df.orderBy("i").select(numbers.humanize_money(F.col("v"))).collect()]
    assert shown == [f"{s}" for _, s in cases][:1] + [s for _, s in cases][1:]


def test_humanize_matches_python_rounding(spark):
    values = [1150.0, 1250.0, 1349.9999, 2450000.0, 2.675, 0.125, 0.375, 12.345]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    shown = [r[0] for r in df.orderBy("i").select(numbers.humanize_money(F.col("v"))).collect()]

    def python(v):
        return f"${v / 1e6:.1f}M" if v >= 1e6 else f"${v / 1e3:.1f}K" if v >= 1e3 else f"${v:,.2f}"

    assert shown == [python(v) for v in values]


def test_extract_date_text(values_of):
    cases = {
        "For the year ended December 31,  2020": "December 31, 2020",
        "december 312020": "december 31, 2020",
        "5 March 98": "March 5, 98",
        "As of June 30, 2019 and 2018": "June 30, 2019",
        "12/31/2020": None, "Dec. 31, 2020": None, "March 2020": None, None: None,
    }
    assert values_of(dates.extract_date_text, list(cases)) == list(cases.values())


def test_header_date(values_of):
    cases = {
        "12/31/2020": True, "2020-12-31": True, "Dec. 31, 2020": True, "31 Dec 2020": True, "December 31, 2020": True,
        "DECEMBER 31 2020": True, "For the  quarter ended June 30, 2019x": True, "2020": False, "December 31,": False,
        "Year Ended": False, None: None,
    }
    assert values_of(dates.has_header_date, list(cases)) == list(cases.values())


def test_parse_mixed_date(values_of):
    day = datetime.date
    cases = {
        "December 31, 2020": day(2020, 12, 31), "december 1, 2020": day(2020, 12, 1), "March 5, 98": day(1998, 3, 5),
        "March 5, 45": day(2045, 3, 5), "March 5, 74": day(1974, 3, 5), "February 30, 2020": None, "n/a": None,
    }
    assert values_of(lambda t: dates.parse_mixed_date(t, 2024), list(cases)) == list(cases.values())


def test_labels(values_of):
    texts = ["Total Revenue (net)", "Shareholders’ Equity", "  Cash -- and: cash equivalents. ", "Owner's Equity"]
    assert values_of(labels.metric_name, texts) == [
        "total_revenue_net", "shareholders_equity", "cash_and_cash_equivalents", "owners_equity",
    ]
    assert values_of(lambda t: labels.metric_name(t, True), texts[:2]) == ["total_revenue", "shareholders’_equity"]
    assert values_of(labels.snake_case, ["netIncome (a) of-Year"]) == ["net_income_of_year"]


def test_names(values_of):
    assert values_of(labels.title_case, ["e-commerce", "bank of america", "owner's"]) == [
        "e-commerce".title(), "bank of america".title(), "owner's".title(),
    ]
    assert values_of(labels.url_basename, ["https://x/y/z.htm", "z.htm"]) == ["z.htm", "z.htm"]


def test_plain_number(values_of):
    cases = {"12": True, "-5": True, "1.5e3": True, ".5": True, "1,234": False, "$5": False, "(6)": False, "5d": False, "": False}
    assert values_of(numbers.is_plain_number, list(cases)) == list(cases.values())


@pytest.mark.parametrize(
    "context, kept",
    [
        ("December 31, 2020", True), ("Years Ended March 31, 2020", True), ("As of June 30, 2019", True),
        ("year ended 2020", True), ("Year End 2020", False), ("Six Months Ended June 30, 2020", False), (None, False),
    ],
)
def test_period_context(spark, context, kept):
    assert bool(period_context_filter(spark.createDataFrame([(context,)], "context string")).count()) == kept


def test_cells_without_dash_slash_or_letter_are_not_searched_for_dates(spark, values_of):
    texts = [None, "", "$1,234.56", "(12)", "1/2/2020", "2020-01-02", "5 ſep 2020", "May 1,  2020", "For the year ended March 31 2020", "a  b", "5"]
    plain = lambda t: F.replace(t, F.lit("  "), F.lit(" ")).rlike(dates._HEADER)
    assert values_of(dates.has_header_date, texts) == values_of(plain, texts)
    # The plan shows the look for a letter, which comes before the notations.
    df = spark.createDataFrame([("1 ",)], "t string")
    shown = df.select(dates.has_header_date(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in shown and r"\p{L}" in shown
