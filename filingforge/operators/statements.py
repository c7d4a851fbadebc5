"""Documents given as grids without header: type, names, dates, line items, key metrics.

Rows are (doc, row_idx, cells ARRAY<STRING>), row_idx dense from 0 after `clean_documents`.
Everything about a row is a plain expression; what spans rows is or-ed, maxed or carried.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filingforge import vocabulary as V
from filingforge.functions.dates import document_dates
from filingforge.functions.numbers import money_tokens, money_value, money_values, ratio_values
from filingforge.operators.ordered import RUN, number_rows, running_total
from filingforge.operators.staging import stage
from filingforge.operators.stats import top_k

UNKNOWN_COMPANY = "Unknown Company"


def null_tokens(rows: DataFrame) -> DataFrame:
    """Cells that spell a missing value become null."""
    return rows.withColumn("cells", F.transform("cells", lambda c: F.when(~c.isin(V.NULL_TOKENS), c)))


def drop_empty(rows: DataFrame) -> DataFrame:
    """Rows, then columns that are null throughout are dropped and the rows renumbered from 0.

    Rows are shuffled once, by (doc, run of rows); what a run needs to know, the rows before it
    and the columns to keep, is worked out on one summary row per run.
    """
    full = rows.where(F.exists("cells", lambda c: c.isNotNull())).withColumn("__run", F.shiftright(F.col("row_idx").cast("long"), RUN))
    columns = (
        full.select("doc", F.posexplode("cells").alias("pos", "cell"))
        .where("cell is not null")
        .groupBy("doc")
        .agg(F.array_sort(F.collect_set("pos")).alias("kept"))
    )
    sizes = full.groupBy("doc", "__run").agg(F.count(F.lit(1)).alias("n"))
    runs = running_total(sizes, ["doc"], "__run", "n", "before", shifts=(RUN,)).drop("n").join(columns, "doc")
    nth = F.row_number().over(W.partitionBy("doc", "__run").orderBy("row_idx"))
    placed = full.withColumn("__nth", nth).join(runs, ["doc", "__run"])
    cells = F.transform("kept", lambda i: F.get("cells", i))
    return placed.select("doc", (F.col("before") + F.col("__nth") - 1).alias("row_idx"), cells.alias("cells"))


def clean_documents(rows: DataFrame) -> DataFrame:
    """Empty rows and columns dropped, rows renumbered, then spelled-out nulls made null."""
    return null_tokens(drop_empty(rows))


def row_money(cells: Column) -> Column:
    """All money values of a row, in cell order."""
    return F.flatten(F.transform(_present(cells), money_values))


def row_ratios(cells: Column) -> Column:
    return F.flatten(F.transform(_present(cells), ratio_values))


def _present(cells: Column) -> Column:
    return F.filter(cells, lambda c: c.isNotNull())


def row_features(rows: DataFrame) -> DataFrame:
    """(doc, row_idx, row_text, money, ratios): computed once per row, shared by the finders."""
    cells = F.col("cells")
    return rows.select(
        "doc", "row_idx",
        F.lower(F.array_join(_present(cells), " ")).alias("row_text"),
        row_money(cells).alias("money"),
        row_ratios(cells).alias("ratios"),
    )


def _full_text(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit("nan"))), " ")


def _with_rows_before(rows: DataFrame, blank: DataFrame) -> DataFrame:
    """`rows` with `__before` and `__second`, the last rows before them that are not among `blank` (doc, row_idx), and
    `__gap`, whether blank rows lie between.

    Runs of blank rows are told by their numbers among the blank rows of a document, so that only those are ordered; a
    run is one row (first, last), met by the row after it.
    """
    numbered = number_rows(stage(blank, "blank-rows"), ["doc"], "row_idx", "n")
    runs = numbered.groupBy("doc", (F.col("row_idx") - F.col("n")).alias("run")).agg(F.min("row_idx").alias("first"), F.max("row_idx").alias("last"))
    runs = stage(runs.select("doc", "first", "last"), "blank-runs")

    def step(df: DataFrame, since: Column, out: str) -> DataFrame:
        own = runs.select("doc", (F.col("last") + 1).alias("__at"), (F.col("first") - 1).alias("__to"))
        joined = df.withColumn("__at", since).join(own, ["doc", "__at"], "left")
        return joined.withColumn(out, F.coalesce("__to", F.col("__at") - 1)).drop("__at")

    rows = step(rows, F.col("row_idx").cast("long"), "__before").withColumn("__gap", F.col("__to").isNotNull()).drop("__to")
    return step(rows, F.col("__before"), "__second").drop("__to")


def document_texts(rows: DataFrame) -> DataFrame:
    """(doc, text): pieces of the document's text that hold every run of up to three neighbouring
    cells, also across row ends.

    The text of a document is all its cells, row by row, joined by blanks. Looking for short
    things in it needs each row, and each seam: the last two cells of a row with the first two
    of what follows. So no document is ever put together in one task. Cells of blanks only stay
    in the text but do not count; rows of them only, however many, are stepped over and leave one
    blank more in the seam, so that dates are found across them and terms of one blank are not.
    """
    cells, n = F.col("cells"), F.size("cells")
    rows = rows.where(n > 0)
    places = F.filter(F.sequence(F.lit(1), n), lambda i: ~F.coalesce(F.element_at(cells, i).rlike(r"(?U)^\s*$"), F.lit(False)))
    rows = rows.withColumn("__places", places)
    count = F.size("__places")
    own = rows.select("doc", _full_text(cells).alias("text"))
    rows = _with_rows_before(rows.where(count > 0), rows.where(count == 0).select("doc", F.col("row_idx").cast("long").alias("row_idx")))
    after_gap = lambda text: F.concat(F.when(F.col("__gap"), " ").otherwise(""), text)
    upto = lambda k: F.slice("cells", F.lit(1), F.coalesce(F.get("__places", F.lit(k - 1)), n))
    since = F.coalesce(F.get("__places", F.greatest(count - 2, F.lit(0))), F.lit(1))
    ends = F.array(
        F.struct(
            F.col("row_idx").cast("long").alias("row"), _full_text(F.slice("cells", since, n - since + 1)).alias("tail"),
            F.lit(None).cast("string").alias("head"), F.lit(None).cast("int").alias("width"),
            F.lit(None).cast("string").alias("next"),
        ),
        F.struct(
            F.col("__before").alias("row"), F.lit(None).cast("string").alias("tail"),
            after_gap(_full_text(upto(2))).alias("head"), count.alias("width"),
            F.lit(None).cast("string").alias("next"),
        ),
        F.struct(
            F.col("__second").alias("row"), F.lit(None).cast("string").alias("tail"),
            F.lit(None).cast("string").alias("head"), F.lit(None).cast("int").alias("width"),
            after_gap(_full_text(upto(1))).alias("next"),
        ),
    )
    seams = (
        rows.select("doc", F.inline(ends))
        .groupBy("doc", "row")
        .agg(*[F.max(c).alias(c) for c in ("tail", "head", "width", "next")])
        .where("tail is not null and head is not null")
    )
    beyond = F.when(F.col("width") <= 1, F.col("next"))
    return own.union(seams.select("doc", F.concat_ws(" ", "tail", "head", beyond)))


def _check_terms(terms: list[str]) -> None:
    if any(t.count(" ") > 2 for t in terms):
        raise ValueError("terms of more than three words can span more cells than a seam holds")


def document_type(rows: DataFrame, types=V.DOCUMENT_TYPES) -> DataFrame:
    """(doc, document_type): the type most of whose terms occur; the earlier type on ties;
    `unknown` when none occurs. Occurrence is one bit mask, or-ed per document."""
    terms = [t for _, own in types for t in own]
    _check_terms(terms)
    # One mask per type and 62 terms.
    parts = [(rank, own[n : n + 62]) for rank, (_, own) in enumerate(types) for n in range(0, len(own), 62)]

    def seen(own):
        bits = [F.when(F.col("text").contains(t.lower()), F.lit(1 << i).cast("long")).otherwise(0) for i, t in enumerate(own)]
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    names = [f"seen{n}" for n in range(len(parts))]
    texts = document_texts(rows).select("doc", F.lower("text").alias("text"))
    masks = texts.select("doc", *[seen(own).alias(n) for n, (_, own) in zip(names, parts)])
    scores = []
    for rank, (name, _) in enumerate(types):
        score = reduce(lambda a, b: a + b, [F.bit_count(n) for n, (r, _) in zip(names, parts) if r == rank])
        scores.append(F.struct(score.alias("score"), F.lit(-rank).alias("rank"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scores))
    return masks.groupBy("doc").agg(*[F.bit_or(n).alias(n) for n in names]).select(
        "doc", F.when(best["score"] > 0, best["name"]).otherwise("unknown").alias("document_type")
    )


def document_date_list(rows: DataFrame) -> DataFrame:
    """(doc, date_text): the distinct dates in a document's text, as written, with one blank for any run of blanks inside."""
    found = document_texts(rows).select("doc", F.explode(document_dates(F.col("text"))).alias("date_text"))
    return found.withColumn("date_text", F.regexp_replace("date_text", r"(?U)\s+", " ")).distinct()


def company_name(rows: DataFrame, first_rows: int = 10) -> DataFrame:
    """(doc, company_name): the first cell of the first rows that looks like a company."""

    def tidy(c: Column) -> Column:
        marked = reduce(lambda a, b: a | b, [F.lower(c).contains(m) for m in V.COMPANY_MARKS])
        bare = F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\s.,&\-]", ""), r"(?U)^\s+|\s+$", "")
        return F.when(marked & (F.length(bare) > 3), bare)

    name = F.get(_present(F.transform("cells", tidy)), F.lit(0))
    early = rows.where(F.col("row_idx") < first_rows).select("doc", "row_idx", name.alias("name"))
    first = F.min_by("name", F.when(F.col("name").isNotNull(), F.col("row_idx")))
    return early.groupBy("doc").agg(F.coalesce(first, F.lit(UNKNOWN_COMPANY)).alias("company_name"))


def line_items(features: DataFrame, statements=("balance_sheet", "income_statement", "cash_flow", "key_metrics")) -> DataFrame:
    """(doc, statement, item_no, item, row_index, values, ratios, raw_text): one row per term a
    row's text contains, if the row has money values (key metrics: or ratios)."""
    text, money, ratios = F.col("row_text"), F.size("money") > 0, F.size("ratios") > 0
    hits = [
        F.when(
            text.contains(term) & ((money | ratios) if statement == "key_metrics" else money),
            F.struct(
                F.lit(statement).alias("statement"), F.lit(n).alias("item_no"), F.lit(term).alias("item")
            ),
        )
        for statement in statements
        for n, term in enumerate(V.STATEMENT_TERMS[statement])
    ]
    found = features.select("*", F.inline(F.array_compact(F.array(*hits))))
    return found.select(
        "doc", "statement", "item_no", "item", F.col("row_idx").alias("row_index"), F.col("money").alias("values"),
        F.when(F.col("statement") == "key_metrics", F.col("ratios")).alias("ratios"),
        F.left(text, F.lit(100)).alias("raw_text"),
    )


def monetary_cells(rows: DataFrame) -> DataFrame:
    """(doc, row, col, token, raw_value, cleaned_value, is_negative): every readable money token."""
    tokens = rows.select(
        "doc", F.col("row_idx").alias("row"), F.posexplode("cells").alias("col", "cell")
    ).select("doc", "row", "col", F.posexplode(money_tokens(F.col("cell"))).alias("token", "raw_value"))
    return tokens.withColumn("cleaned_value", money_value(F.col("raw_value"))).where("cleaned_value is not null").withColumn(
        "is_negative", F.col("raw_value").contains("(") | F.col("raw_value").contains("-")
    )


def document_metrics(features: DataFrame, kinds=tuple(V.METRIC_RULES)) -> DataFrame:
    """(doc, kind, metric, value) of every document under the rules of each kind.

    The last row that matches and has a value decides: one max_by per rule, one pass.
    """
    picks = {
        "max_money": F.array_max("money"),
        "first_money": F.get("money", F.lit(0)),
        "first_ratio": F.get("ratios", F.lit(0)),
    }
    lines = []
    for kind in kinds:
        for metric, groups, pick in V.METRIC_RULES[kind]:
            value = F.lit(None).cast("double")
            if groups:
                named = reduce(
                    lambda a, b: a & b,
                    [reduce(lambda a, b: a | b, [F.col("row_text").contains(t) for t in g]) for g in groups],
                )
                value = F.max_by(picks[pick], F.when(named & picks[pick].isNotNull(), F.col("row_idx")))
            lines.append(F.struct(F.lit(kind).alias("kind"), F.lit(metric).alias("metric"), value.alias("value")))
    return features.groupBy("doc").agg(F.array(*lines).alias("lines")).select("doc", F.inline("lines"))


def metrics_by_type(features: DataFrame, types: DataFrame) -> DataFrame:
    """(doc, document_type, metric, value): metrics under the rules of the document's own type;
    types without rules use the general ones."""
    kind = F.when(F.col("document_type").isin("spac", "insurance", "banking"), F.col("document_type")).otherwise("general")
    chosen = types.select("doc", "document_type", kind.alias("kind"))
    return document_metrics(features).join(chosen, ["doc", "kind"]).select("doc", "document_type", "metric", "value")


def document_stats(money: DataFrame) -> DataFrame:
    """(doc, n_values, largest, smallest) over monetary cells."""
    return money.groupBy("doc").agg(
        F.count("cleaned_value").alias("n_values"), F.max("cleaned_value").alias("largest"),
        F.min("cleaned_value").alias("smallest"),
    )


def first_items(items: DataFrame, k: int = 5) -> DataFrame:
    """First k line items per document and statement, with their `rank`."""
    return top_k(items, ["doc", "statement"], ["row_index", "item_no"], k)


def first_dates(dates: DataFrame, k: int = 3) -> DataFrame:
    return top_k(dates, ["doc"], ["date_text"], k)
