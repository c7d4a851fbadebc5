"""Line-item labels and names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingforge import vocabulary as V


def clean_label(label: Column) -> Column:
    """Lowercase, punctuation removed (bracket contents stay), blanks collapsed and trimmed."""
    bare = F.regexp_replace(F.lower(label), V.LABEL_PUNCTUATION, "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def snake_case(label: Column) -> Column:
    """Bracketed parts and straight apostrophes removed, blanks and hyphens to `_`, lowercase."""
    text = F.regexp_replace(label, r"\([^)]*\)", "")
    text = F.regexp_replace(text, "'", "")
    text = F.regexp_replace(text, r"(?U)[-\s]+", "_")
    text = F.regexp_replace(text, "([a-z])([A-Z])", "$1_$2")
    text = F.regexp_replace(F.lower(text), "_+", "_")
    return F.btrim(text, F.lit("_"))


def metric_name(label: Column, first_generation: bool = False) -> Column:
    """Metric name of a line item. The first generation only lowercases before snake-casing,
    so bracket contents vanish there, while by default they stay."""
    return snake_case(F.lower(label) if first_generation else clean_label(label))


def title_case(text: Column) -> Column:
    """Every run of letters capitalised: `e-commerce` gives `E-Commerce`."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def url_basename(url: Column) -> Column:
    """Last path segment."""
    return F.substring_index(url, "/", -1)
