"""Amounts, money tokens and ratios."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingforge import vocabulary as V


def is_plain_number(text: Column) -> Column:
    """True for `12`, `-5`, `1.5e3`; false for `1,234`, `$5`, `(6)`; null for null."""
    return text.rlike(V.PLAIN_NUMBER)


def parse_amount(text: Column) -> Column:
    """First of `$(n)`, `$n`, or the whole text as `(n)` or `n`; a bracket pair anywhere negates."""
    digits = F.translate(F.regexp_extract(text, V.AMOUNT_PATTERN, 0), "$(),", "")
    size = digits.try_cast("double")
    return F.when(text.contains("(") & text.contains(")"), -size).otherwise(size)


def money_tokens(text: Column) -> Column:
    """Array of all money-like tokens of a cell."""
    return F.regexp_extract_all(text, F.lit(V.MONEY_TOKEN), F.lit(0))


def money_value(token: Column) -> Column:
    """Token to double: K/M/B suffix, `(` negates even when it is not closed."""
    suffix = F.lower(F.right(token, F.lit(1)))
    scale = F.when(suffix == "k", 1e3).when(suffix == "m", 1e6).when(suffix == "b", 1e9).otherwise(1.0)
    size = F.translate(token, "$,()KkMmBb", "").try_cast("double") * scale
    return F.when(token.contains("("), -size).otherwise(size)


def money_values(text: Column) -> Column:
    """Array of the values of all money tokens of a cell, unreadable ones left out."""
    values = F.transform(money_tokens(text), money_value)
    return F.filter(values, lambda v: v.isNotNull())


def ratio_values(text: Column) -> Column:
    """Array of the ratios of a cell: `2.5x`, then `15.5%` glued to a word, then `1.23`/`1.234`."""
    found = F.concat(
        *[F.regexp_extract_all(text, F.lit("(?iU)" + p), F.lit(0)) for p in V.RATIO_TOKENS]
    )
    values = F.transform(found, lambda m: F.translate(m, "x%", "").try_cast("double"))
    return F.filter(values, lambda v: v.isNotNull())


def humanize_money(value: Column) -> Column:
    """`$1.2B`, `$3.4M`, `$5.6K` or `$7.89`, sign in front; null and NaN give `N/A`."""
    size = F.abs(value)

    def scaled(by: float, unit: str) -> Column:
        return F.concat(F.replace(F.format_number(size / by, 1), F.lit(","), F.lit("")), F.lit(unit))

    body = (
        F.when(size >= 1e9, scaled(1e9, "B"))
        .when(size >= 1e6, scaled(1e6, "M"))
        .when(size >= 1e3, scaled(1e3, "K"))
        .otherwise(F.format_number(size, 2))
    )
    sign = F.when(value < 0, "-$").otherwise("$")
    return F.when(value.isNull() | F.isnan(value), "N/A").otherwise(F.concat(sign, body))
