"""The header-date algorithm against a plain row loop on random grids."""

import random
import re

from filingforge.operators import grid as G
from filingforge.operators.tables import single_grid

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def cells_frame(spark, grids):
    """grids: {filing: {row_no: {col: text}}}"""
    rows = [
        (filing, row_no, [(col, text) for col, text in cells.items()])
        for filing, grid in grids.items()
        for row_no, cells in grid.items()
    ]
    return spark.createDataFrame(rows, f"filing string, row_no long, cells {G.CELLS_TYPE}")


def long(df):
    return {tuple(r) for r in G.explode_cells(df).collect()}


# ---------------------------------------------------------------- the row loop


def _amount(text):
    m = re.search(r"\$\([0-9,]+(\.[0-9]+)?\)|\$[0-9,]+(\.[0-9]+)?|^\([0-9,]+(\.[0-9]+)?\)$|^[0-9,]+(\.[0-9]+)?$", text)
    digits = re.sub(r"[$(),]", "", m.group()) if m else ""
    size = float(digits) if re.search(r"\d", digits) else None
    return -size if size is not None and "(" in text and ")" in text else size


def _said(text):
    m = re.search(rf"(?i)({MONTHS})\s*(\d{{1,2}}),?\s*(\d{{4}})", text)
    if m:
        return f"{m[1]} {m[2]}, {m[3]}"
    m = re.search(rf"(?i)\b(\d{{1,2}})\s+({MONTHS})\s+(\d{{2,4}})\b", text)
    return f"{m[2]} {m[1]}, {m[3]}" if m else None


def loop_facts(grid):
    columns = sorted({c for cells in grid.values() for c in cells})
    numeric = {
        c for c in columns
        if any(re.fullmatch(r"\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*", cells[c] or "x") for cells in grid.values() if c in cells)
    }
    kept = [c for c in columns if c == columns[0] or c in numeric]
    known, block, facts = {}, [], []
    for _, cells in sorted(grid.items()):
        row = {c: cells.get(c) for c in kept}
        row = {c: None if c != kept[0] and t in ("$", "$—", "—") else t for c, t in row.items()}
        if all(t is None for t in row.values()):
            continue
        if any(t and re.search(rf"\b\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\b|\b({MONTHS})\s*\d{{1,2}},?\s*\d{{4}}\b", t.replace("  ", " ")) for t in row.values()):
            block.append(row)
            continue
        for c in kept if block else []:
            context = " ".join(re.sub(r"\s+", " ", r[c].strip()) for r in block if r[c] and r[c].strip())
            if _said(context):
                known[c] = (_said(context), context)
        block = []
        facts += [
            (row[kept[0]] or "", *known[c], _amount(row[c]))
            for c in kept[1:] if row[c] is not None and c in known and _amount(row[c]) is not None
        ]
    return facts


def _random_grid(pick, hot):
    grid = {}
    for table in range(pick.randint(1, 4)):
        for i in range(pick.randint(1, 40 if hot else 9)):
            kind = pick.random()
            cells = {}
            for col in range(6):
                if pick.random() < 0.1:
                    continue
                if kind < 0.3:
                    text = pick.choice(["June 30, 2019", "December 31,", "2020", None, "12/31/2020", "Year  Ended", "As of March 3, 2018", ""])
                else:
                    text = pick.choice(["$1,200", "(31)", "7.5", "—", None, "$", "n.m.", "$5 (2)", "12"])
                if col == 0:
                    text = pick.choice(["Cash", "Total assets", None, "Net loss (1)"]) if kind >= 0.3 else pick.choice([None, "As of May 1, 2001", "x"])
                cells[col] = text
            grid[(table << 40) + i] = cells
    return grid


def test_facts_equal_row_loop(spark):
    pick = random.Random(7)
    grids = {f"f{n}": _random_grid(pick, n == 0) for n in range(60)}
    got = sorted(map(tuple, G.locate_facts(G.clean_grid(cells_frame(spark, grids), remove_empty=False)).collect()))
    want = sorted((f, *fact) for f, grid in grids.items() for fact in loop_facts(grid))
    assert len(want) > 300 and got == want


def test_facts_equal_at_any_partitioning(spark):
    pick = random.Random(8)
    grids = {f"f{n}": _random_grid(pick, n == 0) for n in range(10)}
    results = []
    for n in (1, 8, 50):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(tuple, G.locate_facts(G.clean_grid(cells_frame(spark, grids))).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert results[0] == results[1] == results[2]


# ---------------------------------------------------------------- single steps


def test_drop_empty_columns(spark):
    zero = "\u200b"
    grid = {
        0: {0: "a", 1: "", 2: None, 3: "", 4: zero + " ", 5: "x", 6: zero + " " + zero},
        1: {0: "b", 1: " ", 2: None, 3: None, 4: zero, 6: ""},
    }
    kept = {r[2] for r in long(G.drop_empty_columns(cells_frame(spark, {"f": grid})))}
    assert kept == {0, 3, 5, 6}  # 6: a blank between zero-width spaces is left over


def test_blank_column_of_one_table_counts_as_mixed(spark):
    grid = {0: {0: "a", 1: ""}, 1: {0: "b"}}
    assert {r[2] for r in long(G.drop_empty_columns(cells_frame(spark, {"f": grid})))} == {0, 1}


def test_clean_grid_equals_the_single_steps(spark):
    pick = random.Random(9)
    grids = {f"f{n}": {k: {c + 2: t for c, t in v.items()} for k, v in _random_grid(pick, False).items()} for n in range(20)}
    for grid in grids.values():
        for cells in grid.values():
            cells[0], cells[9] = None, "-5"
    df = cells_frame(spark, grids)
    steps = G.drop_empty_columns(df)
    steps = G.null_placeholders(G.with_first_column(steps)).drop("first_col")
    steps = G.drop_empty_rows(G.numeric_columns(steps))
    assert long(steps) == long(G.clean_grid(df))


def test_columns_without_numbers_go(spark):
    grid = {0: {0: "a", 1: "1,234", 2: "7", 3: "$5", 4: "(6)"}, 1: {0: None, 1: "$", 2: "—", 3: None, 4: "x"}}
    clean = G.clean_grid(cells_frame(spark, {"f": grid}))
    assert long(clean) == {("f", 0, 0, "a"), ("f", 0, 2, "7")}


def test_two_header_rows_and_trailing_block(spark):
    grid = {
        0: {0: "As of January 1, 1995", 1: "December 31,", 2: "December 31,"},
        1: {0: "As of January 1, 1995", 1: "2020", 2: "2019"},
        2: {0: "Cash", 1: "5", 2: "(6)"},
        3: {0: None, 1: "June 30, 2021", 2: None},
        4: {0: "Cash", 1: "7", 2: "$8"},
        5: {0: "July 1, 2022", 1: "July 1, 2022", 2: None},
    }
    facts = G.locate_facts(G.clean_grid(cells_frame(spark, {"f": grid})))
    assert sorted(map(tuple, facts.select("label", "context", "value").collect())) == [
        ("Cash", "December 31, 2019", -6.0), ("Cash", "December 31, 2019", 8.0),
        ("Cash", "December 31, 2020", 5.0), ("Cash", "June 30, 2021", 7.0),
    ]


def test_single_grid(spark):
    df = spark.createDataFrame([("f", 0, ["a", None])], "filing string, row_idx int, cells array<string>")
    assert long(single_grid(df)) == {("f", 0, 0, "a"), ("f", 0, 1, None)}


def test_no_python_in_the_facts_plan(spark):
    df = cells_frame(spark, {"f": {0: {0: "a", 1: "1"}}})
    plan = G.locate_facts(G.clean_grid(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_hot_filing_over_many_runs(spark):
    """One filing with most rows and a table longer than two runs; dates reach across the runs."""
    pick = random.Random(10)
    hot = {}
    for i in range(9500):
        cells = {0: f"item {i % 7}", 1: pick.choice(["$5", "(6)", "7", None]), 2: str(i)}
        if i in (3, 4, 4095, 4096, 9000):
            cells = {0: "As of May 1, 2001", 1: f"June {i % 28 + 1}, 2019", 2: "December 31," if i in (3, 4095) else "2018"}
        hot[(1 << 40) + i] = cells
    hot[0] = {0: "x", 1: "1", 2: "2"}
    hot[(2 << 40)] = {0: "Cash", 1: "1", 2: "2"}
    grids = {"hot": hot} | {f"f{n}": _random_grid(pick, False) for n in range(5)}
    got = sorted(map(tuple, G.locate_facts(G.clean_grid(cells_frame(spark, grids))).collect()))
    want = sorted((f, *fact) for f, grid in grids.items() for fact in loop_facts(grid))
    assert len(want) > 15_000 and got == want


def test_dates_of_alternating_rows_over_several_runs(spark):
    """Every other row is a header, so a run of rows holds as many dates as data rows."""
    n = 9000
    text = "if(id % 2 = 0, concat('December 31, ', 1000 + id div 2), string(id))"
    grid = spark.range(n).selectExpr(
        "'f' AS filing", "id AS row_no", "0L AS first_col",
        f"array(struct(0L AS col, 'Cash' AS text), struct(1L AS col, {text} AS text)) AS cells",
    )
    found = G.carry_header_dates(G.date_header_rows(grid)).collect()
    assert sorted((r.row_no, r.cell, r.date_text) for r in found) == [
        (i, str(i), f"December 31, {1000 + i // 2}") for i in range(1, n, 2)
    ]
