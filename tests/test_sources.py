import random

import pytest
from pyspark.sql import functions as F

from filingforge.operators import staging
from filingforge.operators.html import html_table_rows
from filingforge.plans import financials as P
from filingforge.sources import files


def test_filings_and_listing(spark, tmp_path):
    for symbol, name, text in [("NA", "a b.htm", "x\r\ny\rz\n"), ("B", "b.htm", "é")]:
        (tmp_path / symbol).mkdir()
        (tmp_path / symbol / name).write_bytes(text.encode())
    got = {tuple(r) for r in files.read_filings(spark, str(tmp_path)).collect()}
    assert got == {("NA", "a b.htm", "x\ny\nz\n"), ("B", "b.htm", "é")}
    assert {tuple(r) for r in files.list_files(spark, str(tmp_path)).collect()} == {("NA", "a b.htm"), ("B", "b.htm")}


def test_catalog(spark, tmp_path):
    path = tmp_path / "catalog.csv"
    path.write_text(
        "symbol,url,volume,day,ipo_date,open,close,diff,public_price_per_share,price_public_total\n"
        'NA,"https://x/a,b/f.htm",5,2020-01-02,2020-01-02,1.5,2.5,1,10,\n'
    )
    row = files.read_catalog(spark, str(path)).first()
    assert (row.symbol, row.url, row.volume, str(row.day), row.price_public_total) == ("NA", "https://x/a,b/f.htm", 5.0, "2020-01-02", None)
    assert files.read_catalog(spark, str(tmp_path / "missing.csv")) is None


def test_grids_of_both_encodings(spark, tmp_path):
    (tmp_path / "one.csv").write_bytes('a,"b ""q"", c",\n  \n\nNA,é,"x\ny"\n'.encode())
    (tmp_path / "two.csv").write_bytes("café,1\r\n".encode("latin-1"))
    got = sorted((r.doc, r.row_idx, r.cells) for r in files.read_grids(spark, str(tmp_path)).collect())
    assert got == [("one", 0, ["a", 'b "q", c', None]), ("one", 1, [None, "é", "x\ny"]), ("two", 0, ["café", "1"])]


def test_folder_of_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,\n")
    (tmp_path / "b.csv").write_text("y,z\n5,6\n")
    got = {tuple(r) for r in files.read_folder_long(spark, str(tmp_path)).collect()}
    assert got == {
        ("a.csv", 1, "x", "1"), ("a.csv", 1, "y", "2"), ("a.csv", 2, "x", "3"), ("a.csv", 2, "y", None),
        ("b.csv", 1, "y", "5"), ("b.csv", 1, "z", "6"),
    }


def test_export_and_words(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0], 'q "x"')], "s string, v array<double>, t string")
    files.export_csv(df, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out"), header=True, escape='"').collect()] == [("a", "[1.0]", 'q "x"')]
    (tmp_path / "words.txt").write_text("Capital\n\nBank\n")
    assert files.read_word_list(spark, str(tmp_path / "words.txt")) == ["Capital", "Bank"]


def test_candidates_in_folders(spark, tmp_path):
    for parent, symbol in [("one", "a"), ("two", "a"), ("two", "b")]:
        (tmp_path / parent / symbol).mkdir(parents=True)
        (tmp_path / parent / symbol / "x.htm").write_text("x")
    catalog = spark.createDataFrame([("a", "u/x.htm"), ("b", "u/x.htm")], "symbol string, url string")
    found = files.resolve_first_source(catalog, files.candidate_files(spark, str(tmp_path), ["one", "two"]))
    assert {tuple(r) for r in found.collect()} == {("a", "x.htm", "one"), ("b", "x.htm", "two")}


def _written(spark, root, rows):
    """Texts that `read_filings` gives for rows written before, by the parts of their paths that hold a `=`."""
    df = spark.createDataFrame(rows, "symbol string, name string, html string").repartition(5)
    found = files.read_filings(spark, files.write_filings(df, root)).collect()
    return sorted(("/".join(p for p in (r.symbol, r.file_name) if p.startswith("name=")), r.html) for r in found)


def test_filings_are_written_as_one_file_each_in_any_store(spark, tmp_path, monkeypatch):
    rows = [("S1", f"page-{n}", f"text {n}\nmore é") for n in range(40)] + [("S2", "page-1", "x"), ("S2", "null", None), ("S2", "blank", "")]
    rows += [("S2", "twice", "y"), ("S2", "twice", "y"), ("S-3", "page--3", "z"), (None, None, "a"), (None, "", "a")]
    want = [(f"name={n}", f"{t}\n") for s, n, t in rows[:41]] + [("name=null", "\n"), ("name=blank", "\n"), ("name=twice", "y\ny\n"), ("name=page--3", "z\n")]
    want = sorted([*want, ("name=__HIVE_DEFAULT_PARTITION__", "a\na\n")])
    for root in (f"{tmp_path}/plain", f"file:{tmp_path}/named", f"file://{tmp_path}/named again"):
        assert _written(spark, root, rows) == want
    assert all(p.is_file() for p in tmp_path.glob("*/*/*"))  # no folder for each, nothing unfinished
    assert len(list(tmp_path.glob("plain/*/*"))) == len(want)
    assert _written(spark, f"{tmp_path}/plain", rows) == want  # as a task that runs again
    monkeypatch.setattr(files, "_opened_by_tasks", lambda *_: None)
    by_spark = _written(spark, f"{tmp_path}/store", rows[:-2])
    assert by_spark == [w for w in want if "HIVE" not in w[0]]


def test_only_local_paths_are_opened_by_tasks(spark):
    opened = {p: files._opened_by_tasks(spark, p) for p in ("/a:b/c", "file:/a b", "file:///a", "s3a://b/a", "viewfs://store/in", "hdfs:/a", "a/b")}
    assert opened == {"/a:b/c": "/a:b/c", "file:/a b": "/a b", "file:///a": "/a"} | dict.fromkeys(["s3a://b/a", "viewfs://store/in", "hdfs:/a", "a/b"])


def test_first_source(spark):
    catalog = spark.createDataFrame([("a", "u/x.htm"), ("b", "u/y.htm")], "symbol string, url string")
    found = spark.createDataFrame([("p2", 2, "a", "x.htm"), ("p1", 1, "a", "x.htm"), ("p1", 1, "c", "x.htm")], "parent string, priority int, symbol string, file_name string")
    assert [tuple(r) for r in files.resolve_first_source(catalog, found).collect()] == [("a", "x.htm", "p1")]
    assert [r.symbol for r in files.file_semi_join(catalog, found, missing=True).collect()] == ["b"]


class _Session:
    def __init__(self, **settings):
        self.conf = type("Conf", (), {"get": lambda _, key, *default: settings.get(key.split(".")[-2], *default)})()


def test_shared_folder():
    assert staging.shared_folder(_Session(checkpoint="s3://bucket/shared/")) == "s3://bucket/shared"
    assert staging.shared_folder(_Session(warehouse="hdfs:/warehouse")) == "hdfs:/warehouse/_staged"


PAGE = """<table><tr><td>As of May 1, 2000</td><td>December 31, 2020</td><td>December 31, 2019</td></tr>
<tr><td>Total Revenue (net)</td><td>$1,500</td><td>$1,000</td></tr><tr><td>{cash}</td><td>{a}</td><td>(20)</td></tr>
<tr><td>Other</td><td>7</td><td>8</td></tr></table><p>ends here</p>"""


def test_pages_to_training_table(spark):
    pages = [(f"s{i}", PAGE.format(cash="Cash" if i % 3 else "Cash and cash equivalents", a=i)) for i in range(9)]
    pages += [("empty", "<p>no tables</p>"), ("small", "<table><tr><td>Cash<td>1</table>")]
    df = spark.createDataFrame(pages, "filing string, html string")
    keywords = spark.createDataFrame([(s, 1.0) for s, _ in pages], "symbol string, cloud double")
    got = {r.symbol: r for r in P.training_table(df, keywords).collect()}
    assert set(got) == {f"s{i}" for i in range(9)}
    assert got["s0"].total_revenue_net_trend == 500.0 and got["s0"].total_revenue_net_recent == 1500.0
    assert got["s3"].cash_recent == 3.0 and got["s3"].cash_trend == 23.0 and "cash_and_cash_equivalents_recent" not in got["s3"]
    assert got["s4"].word_count == 14 and got["s4"].document_length == len(pages[4][1])


def test_skip_report(spark):
    catalog = spark.createDataFrame([("a",), ("b",), ("c",)], "filing string")
    stages = {
        "file": spark.createDataFrame([("a",), ("b",)], "filing string"), "grid": spark.createDataFrame([("a",)], "filing string"),
        "facts": spark.createDataFrame([("a",)], "filing string"),
    }
    assert {tuple(r) for r in P.skip_report(catalog, stages).collect()} == {("b", "grid"), ("c", "file")}


def test_skip_report_of_the_chain(spark):
    dated = [["As of", "December 31, 1995"], ["Cash", "12"], ["Trucks", "3"], ["Notes", "4"]]
    filings = {
        "short": dated[:3], "other": [["Orders", "1"]] * 4, "undated": [["Cash", "1"]] * 4,
        "no item": [dated[0], ["Trucks", "3"], ["Notes", "4"], ["Cash", None]], "whole": dated,
    }
    rows = [(f, 0, n, ["0", "1"], cells) for f, lines in filings.items() for n, cells in enumerate(lines)]
    rows = spark.createDataFrame(rows, "filing string, table_id int, row_idx int, labels array<string>, cells array<string>")
    catalog = spark.createDataFrame([(f,) for f in [*filings, "none"]], "filing string")
    assert dict(map(tuple, P.skip_report(catalog, P.chain_stages(rows)).collect())) == {
        "none": "tables", "short": "finance tables", "other": "finance tables", "undated": "facts", "no item": "metrics",
    }


def test_skip_report_of_the_workload_has_every_stage(spark):
    from workload.pages import skip_report

    assert {r.stopped_before for r in skip_report(spark, "/root/testdata/sf0.001").collect()} == {"tables", "finance tables", "facts", "metrics"}


def test_copies_inherit_dates_from_the_copy_before(spark):
    page = PAGE.format(cash="Cash", a="5").replace("<tr><td>As of", "<tr><td>Cash due</td><td>1</td><td>2</td></tr><tr><td>As of", 1)
    df = spark.createDataFrame([("f", page)], "filing string, html string")
    once = {r.metric for r in P.grid_metrics(P.filing_grid(df)).collect()}
    copies = {r.metric for r in P.grid_metrics(P.filing_grid(df, "per_keyword")).collect()}
    assert "cash_due_recent" not in once and "cash_due_recent" in copies
    assert html_table_rows(df).agg(F.count("*")).first()[0] == 5


def _csv_text(pick):
    pieces = ["a", "b,", ",", "\n", '"x, y"', '"he said ""no"""', '"two\nlines"', '"\n\n"', "\r\n", "é", " ", "\t\n", "1,5", '"",', "\r"]
    return "".join(pick.choices(pieces, k=pick.choice([0, 1, 30, 400])))


@pytest.mark.parametrize("size", ["48b", "1k", "128m"])
def test_byte_ranges_give_the_records_of_whole_files(spark, tmp_path, size):
    pick = random.Random(len(size))
    texts = {f"g {i}.csv": _csv_text(pick) for i in range(25)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode("latin-1" if name == "g 3.csv" else "utf-8"))
    whole = spark.createDataFrame(list(texts.items()), "name string, text string").select(
        "name", F.posexplode(files.csv_records(F.col("text"))).alias("row_idx", "record")
    )
    want = {(r.name.removesuffix(".csv"), r.row_idx): r.cells for r in whole.select("name", "row_idx", files.csv_cells(F.col("record")).alias("cells")).collect()}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        rows = files.read_grids(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {(r.doc, r.row_idx): r.cells for r in rows}
    nulls = lambda cells: [None if c in files.READER_NULLS else c for c in cells]
    assert len(rows) == len(got) and got == {k: nulls(v) for k, v in want.items()}


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    line = '"a ""quoted""\nrecord, of two lines",12,é\n' + "plain," * 40 + "\n"
    (tmp_path / "big.csv").write_text(line * 80_000, encoding="utf-8")  # about 23 MB
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= 8
        rows = files.read_grids(spark, str(tmp_path))
        found = rows.groupBy(F.size("cells").alias("cells"), (F.col("row_idx") % 2).alias("odd")).agg(F.count("*").alias("n"), F.max("row_idx").alias("last")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r.cells, r.odd): (r.n, r["last"]) for r in found} == {(3, 0): (80_000, 159_998), (41, 1): (80_000, 159_999)}


def test_many_files_are_listed_in_few_tasks(spark, tmp_path):
    for n in range(60):
        (tmp_path / f"S{n}").mkdir()
        (tmp_path / f"S{n}" / "a.csv").write_text(f"{n},x\n")
    context = spark.sparkContext
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    context.setJobGroup("listing", "")
    try:
        found = [files.list_files(spark, str(tmp_path)), files.read_filings(spark, str(tmp_path)), files.read_grids(spark, f"{tmp_path}/*")]
        tracker = context.statusTracker()
        stages = [i for job in tracker.getJobIdsForGroup("listing") for i in tracker.getJobInfo(job).stageIds]
        tasks = [info.numTasks for info in map(tracker.getStageInfo, stages) if info]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert max(tasks) <= 4 * context.defaultParallelism < 60
    assert [f.count() for f in found] == [60, 60, 60]
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
