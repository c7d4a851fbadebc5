"""Text features of filings: keyword counts, people, underwriters.

Feature rows are (symbol, element, value, kind) and stay long; see `wide` for the pivot.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filingforge import vocabulary as V
from filingforge.operators.html import strip_tags
from filingforge.operators.terms import name_counts, near_terms, term_counts

_NAME = r"(?U)\b(?:\p{Lu}(?:\.|[\p{L}\-]*\p{L})\s){1,2}\p{Lu}[\p{L}\-]*\p{L}\b"
# --- fixed values: order in which kinds of features are stacked ---
KINDS = ["keyword", "Person", "underwriter"]


_PAIRS = "array<struct<element:string,value:bigint>>"


def keyword_pairs(lower_text: Column, terms=V.TARGET_KEYWORDS) -> Column:
    """Array of (element, value): how often each term occurs as a whole word; zeros stay. One pass, however many terms."""
    counts = term_counts(lower_text, [t.lower() for t in terms])
    return F.arrays_zip(F.array(*map(F.lit, terms)).alias("element"), counts.alias("value")).cast(_PAIRS)


def keyword_counts(docs: DataFrame, terms=V.TARGET_KEYWORDS) -> DataFrame:
    """(symbol, element, value): whole-word, case-blind counts per (symbol, text); zeros stay."""
    lowered = docs.select("symbol", F.lower("text").alias("__text"))
    return lowered.select("symbol", F.inline(keyword_pairs(F.col("__text"), terms)))


def keyword_frequency(docs: DataFrame, terms=V.FREQUENCY_KEYWORDS) -> DataFrame:
    """(symbol, keyword, frequency), per document from the most frequent down."""
    counts = keyword_counts(docs, terms)
    return counts.select(
        "symbol", F.col("element").alias("keyword"), F.col("value").alias("frequency")
    ).orderBy("symbol", F.desc("frequency"), "keyword")


def is_person_name(name: Column, denied) -> Column:
    """Two or three capitalised words of letters, dots and hyphens, none of them denied; the
    first of 2-12 and the last of 2-15 characters. `denied` is the caller's word list."""
    words = F.filter(F.split(name, r"(?U)\s+"), lambda w: w != "")
    first, last = F.get(words, F.lit(0)), F.try_element_at(words, F.lit(-1))
    ok = (
        F.size(words).between(2, 3)
        & F.forall(words, lambda w: F.left(w, F.lit(1)).rlike(r"\p{Lu}"))
        & name.rlike(r"^[A-Za-z .\-]+$")
        & F.length(first).between(2, 12)
        & F.length(last).between(2, 15)
    )
    if denied:
        ok = ok & ~F.exists(words, lambda w: w.isin(list(denied)))
    return ok


def person_pairs(text: Column, denied=(), candidates: Column | None = None) -> Column:
    """Array of (element, value): person names and how often each occurs as whole words.

    Without a name tagger, candidates are runs of two or three capitalised words; pass an
    ARRAY<STRING> column (say, from a Pandas UDF around a tagger) to use other candidates. All names of
    a text are counted in one pass over its words.
    """
    found = F.regexp_extract_all(text, F.lit(_NAME), F.lit(0)) if candidates is None else candidates
    names = F.filter(F.array_distinct(found), lambda n: is_person_name(n, denied))
    pairs = F.arrays_zip(names.alias("element"), name_counts(text, names).alias("value")).cast(_PAIRS)
    return F.filter(pairs, lambda p: p["value"] > 0)


def person_candidates(docs: DataFrame, denied=(), candidates: Column | None = None) -> DataFrame:
    """(symbol, element, value): person names of a text and how often each occurs as whole words."""
    return docs.select("symbol", F.inline(person_pairs(F.col("text"), denied, candidates)))


def without_listed_words(rows: DataFrame, words: DataFrame, column: str = "element") -> DataFrame:
    """The rows none of whose words, split at blanks, is in the first column of `words`: a list that is a table, of any
    length, joined and not collected. Names are made distinct before."""
    listed = words.select(F.col(f"`{words.columns[0]}`").alias("__word"))
    parts = rows.select(column).distinct().select(column, F.explode(F.split(column, r"(?U)\s+")).alias("__word"))
    return rows.join(parts.join(listed, "__word", "left_semi").select(column).distinct(), column, "left_anti").select(rows.columns)


def _named(found: dict[str, Column]) -> Column:
    hits = [F.when(hit, F.lit(bank.title())) for bank, hit in found.items()]
    return F.array_compact(F.array(*hits))


def banks_in_table(lower_text: Column, banks=V.UNDERWRITERS, marks=V.UNDERWRITING_TABLE_TERMS) -> Column:
    """Array of the banks named anywhere in the text of a table that mentions underwriting."""
    marked = reduce(lambda a, b: a | b, [lower_text.contains(m) for m in marks])
    return _named({b: marked & lower_text.contains(b) for b in banks})


def banks_in_context(
    lower_html: Column, banks=V.UNDERWRITERS, terms=V.UNDERWRITING_CONTEXT_TERMS, reach: int = 200, whole_word: bool = False
) -> Column:
    """Array of the banks with a context term wholly within `reach` characters before or after, all in one pass.
    Substrings count (`ubs` in "subsidiary") unless `whole_word`."""
    titles = F.array(*[F.lit(b.title()) for b in banks])
    return F.transform(near_terms(lower_html, banks, terms, reach, whole_word), lambda n: F.get(titles, n))


def underwriters_in_tables(
    tables: DataFrame, banks=V.UNDERWRITERS, marks=V.UNDERWRITING_TABLE_TERMS
) -> DataFrame:
    """(symbol, element): banks named in the tables (symbol, table_html) that mention underwriting.
    Banks are found as substrings."""
    texts = tables.select("symbol", F.lower(strip_tags(F.col("table_html"))).alias("__text"))
    return texts.select("symbol", F.explode(banks_in_table(F.col("__text"), banks, marks)).alias("element")).distinct()


def underwriters_in_context(
    pages: DataFrame, banks=V.UNDERWRITERS, terms=V.UNDERWRITING_CONTEXT_TERMS,
    reach: int = 200, whole_word: bool = False,
) -> DataFrame:
    """(symbol, element): banks in the raw markup near a context term."""
    lowered = pages.select("symbol", F.lower("html").alias("__text"))
    banks_near = banks_in_context(F.col("__text"), banks, terms, reach, whole_word)
    return lowered.select("symbol", F.explode(banks_near).alias("element")).distinct()


def feature_rows(keywords: DataFrame, people: DataFrame, underwriters: DataFrame) -> DataFrame:
    """(symbol, element, value, kind): the three kinds stacked; an underwriter counts 1."""

    def kind(df: DataFrame, name: str) -> DataFrame:
        return df.select("symbol", "element", F.col("value").cast("long").alias("value"), F.lit(name).alias("kind"))

    banks = underwriters.select("symbol", "element").distinct().withColumn("value", F.lit(1))
    parts = [kind(df, name) for df, name in zip((keywords, people, banks), KINDS)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def suffix_duplicates(features: DataFrame) -> DataFrame:
    """An element of several kinds gets `.1`, `.2` behind its name from the second kind on.

    Feature rows hold an element at most once per kind, so a group has at most three rows.
    """
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    nth = F.row_number().over(W.partitionBy("symbol", "element").orderBy(rank)) - 1
    return features.withColumn("__nth", nth).withColumn(
        "element", F.when(F.col("__nth") == 0, F.col("element")).otherwise(F.concat_ws(".", "element", "__nth"))
    ).drop("__nth")
