"""Text features, their tables, profiles and association."""

from pyspark.sql import functions as F

from filingforge import vocabulary as V
from filingforge.functions.labels import title_case
from filingforge.operators import features as feature_ops
from filingforge.operators import html as html_ops
from filingforge.operators import stats, wide
from filingforge.plans.text_features import feature_association as association
from filingforge.plans.text_features import filing_features as features_of_pages
from workload.inputs import (
    CATALOG, ELEMENT_LIST, ELEMENTS, FEATURES, KEYWORD_VALUES, KEYWORD_WIDE, METRICS, TERMS, catalog, features, keyword_values, keyword_wide,
    metrics, table, with_sql,
)
from workload.pages import PAGE_TEXT

_DENIED = ["The", "Der", "Die", "Les", "Una", "Of", "And", "La", "El"]
_SEGMENTS = ["automobile", "building", "furniture", "household", "machinery"]
_BANKS, _NEAR_TERMS = ["apache", "mit", "license"], ["license", "public", "copyright"]
_WORDS = ["Ring", "Blue"]


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("symbol"), "text"
    )


def _table_pages(spark, sf_dir):
    """A page with one table per customer; some mention underwriting."""
    role = F.when(F.col("c_acctbal") < 0, "Lead Manager").when(F.col("c_acctbal") < 500, "Under&shy;writer").otherwise("Client")
    html = F.concat(
        F.lit("<html><p>machinery</p><table><tr><td>"), F.col("c_name"), F.lit("</td><td>"), F.col("c_mktsegment"),
        F.lit("</td><td>"), role, F.lit("</td></tr></table></html>"),
    )
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol"), html.alias("html"))


def keyword_counts(spark, sf_dir):
    return feature_ops.keyword_counts(_docs(spark, sf_dir), TERMS)


def person_candidates(spark, sf_dir):
    return feature_ops.person_candidates(_docs(spark, sf_dir), _DENIED)


def person_filter(spark, sf_dir):
    """Names made of customer names, part names and brands, good and bad ones."""
    name = F.concat_ws(
        " ", F.initcap("p_name"), F.when(F.col("p_size") % 3 == 0, "Q."), F.when(F.col("p_size") % 5 == 0, "de"),
        F.when(F.col("p_size") % 7 == 0, F.lit("Müller")), F.when(F.col("p_size") % 11 == 0, F.col("p_brand")),
    )
    ok = feature_ops.is_person_name(F.col("name"), ["Blue", "Hot", "Gear"])
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).withColumn("is_person", ok)


def person_candidates_listed(spark, sf_dir):
    """Names without any word of a table: the first words of the benchmark items."""
    words = table(spark, sf_dir, "benchmark").select(F.split_part("text", F.lit(" "), F.lit(1)).alias("word"))
    return feature_ops.without_listed_words(feature_ops.person_candidates(_docs(spark, sf_dir)), words)


#: Words of invented prose: pairs of its syllables.
_PARTS = ["the", "an", "ing", "tion", "re", "th", "er", "on", "and", "at", "en", "or", "es", "st", "ed", "sh", "ha", "ti", "in", "wh", "ea", "ly"]
LONG_LIST = [a + b for a in _PARTS for b in _PARTS]


def long_list_counts(spark, sf_dir):
    """Whole-word counts of a list of several hundred words."""
    return feature_ops.keyword_counts(_docs(spark, sf_dir), LONG_LIST).where("value > 0")


def _prospectus(spark, sf_dir):
    """(symbol, text, html): an order as a prospectus that names terms and a bank of the default lists, some of them as
    parts of words, the bank at a distance that goes by the order."""
    key = F.col("o_orderkey")

    def pick(listed, place):
        return F.get(F.array(*map(F.lit, listed)), (place % len(listed)).cast("int"))

    word = lambda factor, more=0: pick(V.FREQUENCY_KEYWORDS, key * factor + more)
    text = F.concat(
        F.lit("Our "), word(1), F.lit(" and "), F.upper(word(7)), F.lit("-based "), word(11, 3), F.lit("s, x"), word(5, 1), F.lit("; "),
        word(3), F.lit("_"), word(1), F.lit(" ("), word(13, 2), F.lit(") "), word(13, 2), F.lit("."),
    )
    bank = F.initcap(pick(V.UNDERWRITERS, key))
    term = pick([*V.UNDERWRITING_CONTEXT_TERMS, "none"], key * 3)
    gap = F.repeat(F.lit("é"), (key % 211).cast("int"))
    html = F.when(key % 2 == 0, F.concat(bank, gap, term)).otherwise(F.concat(term, gap, F.upper(bank)))
    role = pick([*V.UNDERWRITING_TABLE_TERMS, "counsel"], key)
    marked = F.concat(F.lit("<table><tr><td>"), F.initcap(role), F.lit("</td><td>"), bank, F.lit("</td></tr></table>"))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("O"), key.cast("string")).alias("symbol"), text.alias("text"), html.alias("html"), marked.alias("table_html")
    )


def default_keyword_counts(spark, sf_dir):
    return feature_ops.keyword_counts(_prospectus(spark, sf_dir)).where("value > 0")


def default_keyword_frequency(spark, sf_dir):
    return feature_ops.keyword_frequency(_prospectus(spark, sf_dir)).where("frequency > 0")


def default_underwriters_in_context(spark, sf_dir):
    return feature_ops.underwriters_in_context(_prospectus(spark, sf_dir))


def default_underwriters_in_tables(spark, sf_dir):
    return feature_ops.underwriters_in_tables(_prospectus(spark, sf_dir))


def underwriters_in_tables(spark, sf_dir):
    pages = _table_pages(spark, sf_dir).withColumnRenamed("symbol", "filing")
    tables = html_ops.table_elements(pages).withColumnRenamed("filing", "symbol")
    return feature_ops.underwriters_in_tables(tables, _SEGMENTS)


def underwriters_in_context(spark, sf_dir):
    pages = _docs(spark, sf_dir).withColumnRenamed("text", "html")
    return feature_ops.underwriters_in_context(pages, _BANKS, _NEAR_TERMS)


def feature_rows(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return feature_ops.feature_rows(
        feature_ops.keyword_counts(docs, TERMS), feature_ops.person_candidates(docs, _DENIED),
        underwriters_in_context(spark, sf_dir),
    )


def pivot_duplicate_names(spark, sf_dir):
    return feature_ops.suffix_duplicates(features(spark, sf_dir))


def keyword_frequency(spark, sf_dir):
    return feature_ops.keyword_frequency(_docs(spark, sf_dir), TERMS)


def pivot_metrics(spark, sf_dir):
    rows = features(spark, sf_dir).where("kind = 'keyword'").select("symbol", "element", "value")
    return wide.pivot_metrics(rows, ELEMENTS, key="symbol", name="element")


def group_sum(spark, sf_dir):
    counts = features(spark, sf_dir).select(F.col("element").alias("column_name"), F.col("value").alias("count"))
    return stats.group_sum(counts)


def column_counts(spark, sf_dir):
    """Counts per term as a `Total` row below the wide table."""
    rows = keyword_wide(spark, sf_dir).drop("diff").replace(0.0, None, subset=TERMS)
    return stats.with_total_row(rows, "symbol")


def low_support_columns(spark, sf_dir):
    return stats.low_support_columns(features(spark, sf_dir), 600)


def min_support_columns(spark, sf_dir):
    return wide.min_support(metrics(spark, sf_dir), 0.735)


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def mean_difference_by_sign(spark, sf_dir):
    return _rounded(stats.mean_difference_by_sign(keyword_values(spark, sf_dir)), "positive_mean", "negative_mean", "difference")


def feature_correlation(spark, sf_dir):
    return _rounded(stats.feature_correlation(keyword_values(spark, sf_dir), min_count=1), "correlation")


def sort_abs(spark, sf_dir):
    return stats.sort_abs(catalog(spark, sf_dir).select("symbol", "position", "diff"), "diff")


def feature_association(spark, sf_dir):
    """Frequent features without denied words against the price change of the customer's first order."""
    first = wide.distinct_on(catalog(spark, sf_dir), ["symbol"], [F.col("position")])
    found = association(features(spark, sf_dir), first, _WORDS, 60)
    return _rounded(found, "positive_mean", "negative_mean", "difference")


def histogram(spark, sf_dir):
    value = F.when(F.col("event_id") % 50 == 0, float("nan")).otherwise(F.col("value"))
    return stats.histogram(table(spark, sf_dir, "events").select(value.alias("value")), "value", 200)


def winners_losers(spark, sf_dir):
    return stats.winners_losers(catalog(spark, sf_dir))


def profile_info(spark, sf_dir):
    return stats.profile_info(table(spark, sf_dir, "orders").withColumn("o_comment", F.expr("nullif(o_orderstatus, 'P')")))


def profile_describe(spark, sf_dir):
    described = stats.profile_describe(
        table(spark, sf_dir, "lineitem").withColumn("l_tax", F.when(F.col("l_orderkey") % 50 == 0, float("nan")).otherwise(F.col("l_tax"))),
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    )
    # Five places: the mean discount lies on a tie at the sixth, where the order of adding decides.
    return described.withColumns({c: F.round(c, 5) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")})


def group_count_desc(spark, sf_dir):
    return stats.group_count_desc(table(spark, sf_dir, "documents"), "lang")


def filing_features(spark, sf_dir):
    """Features of the given web pages, from markup to suffixed feature rows."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("symbol"), "html")
    return features_of_pages(pages, TERMS, _BANKS, _DENIED)


QUERIES = {
    "filing_features": filing_features,
    "pivot_metrics": pivot_metrics,
    "pivot_duplicate_names": pivot_duplicate_names,
    "group_sum": group_sum,
    "column_counts": column_counts,
    "low_support_columns": low_support_columns,
    "min_support_columns": min_support_columns,
    "mean_difference_by_sign": mean_difference_by_sign,
    "feature_correlation": feature_correlation,
    "feature_association": feature_association,
    "histogram": histogram,
    "winners_losers": winners_losers,
    "profile_info": profile_info,
    "profile_describe": profile_describe,
    "group_count_desc": group_count_desc,
    "keyword_frequency": keyword_frequency,
    "sort_abs": sort_abs,
    "keyword_counts": keyword_counts,
    "person_candidates": person_candidates,
    "person_candidates_listed": person_candidates_listed,
    "long_list_counts": long_list_counts,
    "default_keyword_counts": default_keyword_counts,
    "default_keyword_frequency": default_keyword_frequency,
    "default_underwriters_in_context": default_underwriters_in_context,
    "default_underwriters_in_tables": default_underwriters_in_tables,
    "person_filter": person_filter,
    "underwriters_in_tables": underwriters_in_tables,
    "underwriters_in_context": underwriters_in_context,
    "feature_rows": feature_rows,
}

# The text of a page as SQL: no blanks are collapsed here.
_PAGES = f"texts AS (SELECT 'P' || page_id AS symbol, {PAGE_TEXT} AS text FROM pages)"
_DOCS = "texts AS (SELECT 'D' || doc_id AS symbol, text FROM documents)"
_W = "[^\\pL\\pM\\p{Nd}_]"  # what is no word character
_WORD_COUNTS = f"""
doubled AS (SELECT symbol, regexp_replace(lower(text), '({_W})', '\\1\\1', 'g') AS text FROM texts),
word_counts AS (
  SELECT symbol, term AS element, CAST(len(regexp_extract_all(text, '(?:^|{_W})' || regexp_replace(term, '([ -])', '\\1\\1', 'g') || '(?:{_W}|$)')) AS BIGINT) AS value
  FROM doubled, (VALUES {", ".join(f"('{t}')" for t in TERMS)}) t(term))
"""
_PEOPLE = f"""
spaced AS (SELECT symbol, text, regexp_replace(text, '({_W})', '\\1\\1', 'g') AS doubled FROM texts),
runs AS (
  SELECT DISTINCT symbol, doubled, unnest(regexp_extract_all(' ' || text,
    '(?:^|{_W})((?:\\p{{Lu}}(?:\\.|[\\pL\\-]*\\pL)\\s){{1,2}}\\p{{Lu}}[\\pL\\-]*\\pL)', 1)) AS element
  FROM spaced),
people AS (
  SELECT symbol, element, CAST(len(regexp_extract_all(doubled,
      '(?:^|{_W})' || regexp_replace(element, '({_W})', '\\\\\\1\\\\\\1', 'g') || '(?:{_W}|$)')) AS BIGINT) AS value
  FROM (SELECT symbol, doubled, element, string_split_regex(element, '\\s+') AS words FROM runs)
  WHERE regexp_matches(element, '^[A-Za-z .\\-]+$') AND len(words) BETWEEN 2 AND 3
    AND NOT list_has_any(words, [{", ".join(f"'{w}'" for w in _DENIED)}])
    AND length(words[1]) BETWEEN 2 AND 12 AND length(words[-1]) BETWEEN 2 AND 15)
"""
_ANY_PEOPLE = _PEOPLE.replace(f"""
    AND NOT list_has_any(words, [{", ".join(f"'{w}'" for w in _DENIED)}])""", "")


def _pick_sql(listed, place):
    return "[" + ", ".join(f"'{x}'" for x in listed) + f"][({place}) % {len(listed)} + 1]"


def _word_sql(factor, more=0):
    return _pick_sql(V.FREQUENCY_KEYWORDS, f"o_orderkey * {factor} + {more}")


_TITLE = "array_to_string(list_transform(string_split({}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_PROSPECTUS = f"""
picked AS (
  SELECT o_orderkey, {_pick_sql(V.UNDERWRITERS, "o_orderkey")} AS bank, {_pick_sql([*V.UNDERWRITING_CONTEXT_TERMS, "none"], "o_orderkey * 3")} AS term,
    {_pick_sql([*V.UNDERWRITING_TABLE_TERMS, "counsel"], "o_orderkey")} AS role, repeat('é', CAST(o_orderkey % 211 AS INTEGER)) AS gap
  FROM orders),
texts AS (
  SELECT 'O' || o_orderkey AS symbol, 'Our ' || {_word_sql(1)} || ' and ' || upper({_word_sql(7)}) || '-based ' || {_word_sql(11, 3)} || 's, x'
    || {_word_sql(5, 1)} || '; ' || {_word_sql(3)} || '_' || {_word_sql(1)} || ' (' || {_word_sql(13, 2)} || ') ' || {_word_sql(13, 2)} || '.' AS text
  FROM orders),
markup AS (SELECT 'O' || o_orderkey AS symbol, lower(CASE WHEN o_orderkey % 2 = 0 THEN bank || gap || term ELSE term || gap || bank END) AS html FROM picked),
names AS (SELECT unnest([{", ".join(f"'{b}'" for b in V.UNDERWRITERS)}]) AS name)
"""
# Patterns are literals here: a pattern that is a column is compiled for every row.
_DEFAULT_COUNTS = f"""
doubled AS (SELECT symbol, regexp_replace(lower(text), '({_W})', '\\1\\1', 'g') AS text FROM texts),
word_counts AS (
  SELECT symbol, unnest([{", ".join(f"'{t}'" for t in V.FREQUENCY_KEYWORDS)}]) AS element, unnest([{", ".join(
    f"CAST(len(regexp_extract_all(text, '(?:^|{_W}){t.replace(' ', '  ').replace('-', '--')}(?:{_W}|$)')) AS BIGINT)" for t in V.FREQUENCY_KEYWORDS
  )}]) AS value FROM doubled)
"""


def _near_bank(bank):
    near = "|".join(
        f"{t}.{{0,{200 - len(t)}}}{bank}|{bank}.{{0,{200 - len(t)}}}{t}" for t in V.UNDERWRITING_CONTEXT_TERMS
    )
    return f"SELECT symbol, {_TITLE.format(chr(39) + bank + chr(39))} AS element FROM markup WHERE contains(html, '{bank}') AND regexp_matches(html, '(?s){near}')"


_NEAR_SQL = " OR ".join(
    f"regexp_matches(lower(text), '(?s){t}.{{0,{200 - len(t)}}}' || bank || '|' || bank || '.{{0,{200 - len(t)}}}{t}')" for t in _NEAR_TERMS
)
_CONTEXT = f"""
banks AS (
  SELECT 'D' || doc_id AS symbol, upper(bank[1]) || bank[2:] AS element
  FROM documents, (VALUES {", ".join(f"('{b}')" for b in _BANKS)}) b(bank) WHERE {_NEAR_SQL})
"""
_DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std,
      round(CAST(min({c}) AS DOUBLE), 5) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 5) AS q25,
      round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 5) AS q50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 5) AS q75,
      round(CAST(max({c}) AS DOUBLE), 5) AS max FROM (
        SELECT * REPLACE (CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE l_tax END AS l_tax) FROM lineitem)"""
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
)
_SIGNED = (
    'SELECT "column", round(p, 6) AS positive_mean, round(n, 6) AS negative_mean, c AS count, round(p - n, 6) AS difference FROM ('
    'SELECT "column", avg(CASE WHEN diff > 0 THEN nullif(value, 0) END) AS p, avg(CASE WHEN diff < 0 THEN nullif(value, 0) END) AS n, '
    'count(nullif(value, 0)) AS c FROM keyword_values GROUP BY ALL) WHERE p - n IS NOT NULL'
)

ORACLE = {
    "filing_features": with_sql(
        _PAGES, _WORD_COUNTS, _PEOPLE,
        select="""SELECT symbol, element, value, 'keyword' AS kind FROM word_counts
          UNION ALL SELECT symbol, element, value, 'Person' FROM people WHERE value > 0
          UNION ALL SELECT 'P' || page_id, 'Mit', 1, 'underwriter' FROM pages WHERE regexp_matches(lower(html), '(?s)mit.{0,192}offering')""",
    ),
    "pivot_metrics": with_sql(
        FEATURES,
        select="SELECT * FROM (PIVOT (SELECT symbol, element, value FROM features WHERE kind = 'keyword') ON " + ELEMENT_LIST + " USING max(value) GROUP BY symbol)",
    ),
    "pivot_duplicate_names": with_sql(
        FEATURES,
        """nth AS (SELECT *, row_number() OVER (PARTITION BY symbol, element
          ORDER BY list_position(['keyword', 'Person', 'underwriter'], kind)) - 1 AS n FROM features)""",
        select="SELECT symbol, CASE WHEN n = 0 THEN element ELSE element || '.' || n END AS element, kind, value FROM nth",
    ),
    "group_sum": with_sql(FEATURES, select="SELECT element AS column_name, CAST(sum(value) AS BIGINT) AS count FROM features GROUP BY ALL"),
    "column_counts": with_sql(
        KEYWORD_WIDE,
        select="SELECT symbol, " + ", ".join(f"nullif({t}, 0) AS {t}" for t in TERMS)
        + " FROM keyword_wide UNION ALL SELECT 'Total', " + ", ".join(f"CAST(count(nullif({t}, 0)) AS DOUBLE)" for t in TERMS) + " FROM keyword_wide",
    ),
    "low_support_columns": with_sql(
        FEATURES, select="SELECT element AS column_name, count(value) AS count FROM features GROUP BY ALL HAVING count(value) <= 600"
    ),
    "min_support_columns": with_sql(
        METRICS,
        select="""SELECT metric, filing, value FROM metrics WHERE metric IN (SELECT metric FROM metrics GROUP BY metric
          HAVING count(value) >= 0.735 * (SELECT count(DISTINCT filing) FROM metrics))""",
    ),
    "mean_difference_by_sign": with_sql(KEYWORD_VALUES, select=_SIGNED),
    "feature_association": with_sql(
        CATALOG, FEATURES,
        "kept AS (SELECT * FROM features WHERE NOT (" + " OR ".join(f"contains(element, '{w}')" for w in _WORDS) + "))",
        "frequent AS (SELECT element FROM kept GROUP BY element HAVING count(value) > 60)",
        "firsts AS (SELECT symbol, diff FROM catalog QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY position) = 1)",
        'keyword_values AS (SELECT element AS "column", value, diff FROM kept JOIN frequent USING (element) JOIN firsts USING (symbol))',
        select=_SIGNED,
    ),
    "feature_correlation": with_sql(
        KEYWORD_VALUES, select='SELECT "column", round(corr(value, diff), 6) AS correlation, count(value) AS count FROM keyword_values GROUP BY ALL'
    ),
    "histogram": """WITH numbers AS (SELECT value FROM events WHERE event_id % 50 <> 0),
      ends_ AS (SELECT min(value) AS lo, max(value) AS hi FROM numbers)
      SELECT least(CAST(floor((value - lo) / (hi - lo) * 200) AS BIGINT) + 1, 200) AS bin, count(*) AS count FROM numbers, ends_ GROUP BY ALL""",
    "winners_losers": with_sql(CATALOG, select="SELECT diff > 0 AS result, count(*) AS count FROM catalog GROUP BY ALL"),
    "profile_info": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS type, count({e}) AS non_null FROM orders"
        for c, t, e in [
            ("o_orderkey", "bigint", "o_orderkey"), ("o_custkey", "bigint", "o_custkey"), ("o_orderstatus", "string", "o_orderstatus"),
            ("o_totalprice", "double", "o_totalprice"), ("o_orderdate", "timestamp_ntz", "o_orderdate"), ("o_orderpriority", "string", "o_orderpriority"),
            ("o_comment", "string", "nullif(o_orderstatus, 'P')"),
        ]
    ),
    "profile_describe": _DESCRIBE,
    "group_count_desc": "SELECT lang, count(*) AS count FROM documents GROUP BY lang",
    "keyword_frequency": with_sql(_DOCS, _WORD_COUNTS, select="SELECT symbol, element AS keyword, value AS frequency FROM word_counts"),
    "sort_abs": with_sql(CATALOG, select="SELECT symbol, position, diff FROM catalog ORDER BY abs(diff) DESC, diff"),
    "keyword_counts": with_sql(_DOCS, _WORD_COUNTS, select="SELECT * FROM word_counts"),
    "person_candidates": with_sql(_DOCS, _PEOPLE, select="SELECT * FROM people WHERE value > 0"),
    "person_candidates_listed": with_sql(
        _DOCS, _ANY_PEOPLE, "listed AS (SELECT string_split(text, ' ')[1] AS word FROM benchmark)",
        select="""SELECT * FROM people WHERE value > 0 AND element NOT IN (
          SELECT element FROM (SELECT DISTINCT element, unnest(string_split_regex(element, '\\s+')) AS word FROM people) JOIN listed USING (word))""",
    ),
    "long_list_counts": with_sql(
        _DOCS,
        f"parts AS (SELECT unnest([{', '.join(f"'{p}'" for p in _PARTS)}]) AS part)",
        "words AS (SELECT symbol, unnest(regexp_extract_all(lower(text), '[\\pL\\pM\\p{Nd}_]+')) AS element FROM texts)",
        select="""SELECT symbol, element, count(*) AS value FROM words
          WHERE element IN (SELECT a.part || b.part FROM parts a, parts b) GROUP BY ALL""",
    ),
    "default_keyword_counts": with_sql(
        _PROSPECTUS, _DEFAULT_COUNTS,
        select=f"SELECT * FROM word_counts WHERE value > 0 AND element IN ({', '.join(f"'{t}'" for t in V.TARGET_KEYWORDS)})",
    ),
    "default_keyword_frequency": with_sql(
        _PROSPECTUS, _DEFAULT_COUNTS, select="SELECT symbol, element AS keyword, value AS frequency FROM word_counts WHERE value > 0"
    ),
    "default_underwriters_in_context": with_sql(
        _PROSPECTUS, select=" UNION ALL ".join(map(_near_bank, V.UNDERWRITERS))
    ),
    "default_underwriters_in_tables": with_sql(
        _PROSPECTUS,
        select=f"""SELECT DISTINCT 'O' || o_orderkey AS symbol, {_TITLE.format('name')} AS element FROM picked, names
          WHERE role <> 'counsel' AND contains(lower(bank), name)""",
    ),
    "person_filter": """WITH names AS (
      SELECT p_partkey, concat_ws(' ', array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '),
        CASE WHEN p_size % 3 = 0 THEN 'Q.' END, CASE WHEN p_size % 5 = 0 THEN 'de' END,
        CASE WHEN p_size % 7 = 0 THEN 'Müller' END, CASE WHEN p_size % 11 = 0 THEN p_brand END) AS name FROM part),
    split AS (SELECT *, string_split(name, ' ') AS words FROM names)
    SELECT p_partkey, name, len(words) BETWEEN 2 AND 3 AND NOT list_has_any(words, ['Blue', 'Hot', 'Gear'])
      AND len(list_filter(words, lambda w: NOT regexp_matches(w, '^\\p{Lu}'))) = 0 AND regexp_matches(name, '^[A-Za-z .\\-]+$')
      AND length(words[1]) BETWEEN 2 AND 12 AND length(words[-1]) BETWEEN 2 AND 15 AS is_person FROM split""",
    "underwriters_in_tables": """SELECT 'C' || c_custkey AS symbol, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS element
      FROM customer WHERE c_acctbal < 0""",
    "underwriters_in_context": with_sql(_CONTEXT, select="SELECT * FROM banks"),
    "feature_rows": with_sql(
        _DOCS, _WORD_COUNTS, _PEOPLE, _CONTEXT,
        select="""SELECT symbol, element, value, 'keyword' AS kind FROM word_counts
          UNION ALL SELECT symbol, element, value, 'Person' FROM people WHERE value > 0
          UNION ALL SELECT symbol, element, 1, 'underwriter' FROM banks""",
    ),
}
