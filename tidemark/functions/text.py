"""Text and code expressions used to turn raw labels into flags, families and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, list(conditions))


def starts_with_any(col, prefixes) -> Column:
    return any_of([_c(col).startswith(p) for p in prefixes])


def contains_any(col, words, ignore_case: bool = True) -> Column:
    target = F.lower(_c(col)) if ignore_case else _c(col)
    return any_of([target.contains(w.lower() if ignore_case else w) for w in words])


def contains_but_not(col, wanted, unwanted) -> Column:
    """Case-insensitive substring filter with negation."""
    return contains_any(col, wanted) & ~contains_any(col, unwanted)


def first_match(col, pairs, default=None, ignore_case: bool = True) -> Column:
    """First (pattern, tag) whose pattern occurs in the text wins."""
    target = F.lower(_c(col)) if ignore_case else _c(col)
    branches = [F.when(target.contains(p.lower() if ignore_case else p), F.lit(tag)) for p, tag in pairs]
    return F.coalesce(*branches, F.lit(default))


def every_match(col, pairs, ignore_case: bool = True) -> Column:
    """All tags whose pattern occurs in the text, as an array (a row may belong to several classes)."""
    target = F.lower(_c(col)) if ignore_case else _c(col)
    hits = [F.when(target.contains(p.lower() if ignore_case else p), F.lit(tag)) for p, tag in pairs]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def code_stem(col) -> Column:
    """Leading letter and the digits after it; a dot or any other character ends the stem."""
    return F.regexp_extract(F.upper(F.trim(_c(col))), r"^([A-Z][0-9]*)", 1)


def plain_code(col) -> Column:
    """Code without blanks and dots."""
    return F.replace(F.trim(_c(col)), F.lit("."), F.lit(""))


def split_cell(col, separator: str = ",") -> Column:
    """Comma list inside one cell as an array; a missing cell gives one empty item."""
    return F.split(F.coalesce(_c(col), F.lit("")), separator)


def age_years(col, cap_label: str = "> 89", cap_value: int = 90) -> Column:
    """Age text with a top-coded label; sources disagree on the replacement, so it is a parameter."""
    return F.replace(_c(col), F.lit(cap_label), F.lit(str(cap_value))).try_cast("double")


def ordinal_score(col, table: dict, pattern: str = r"^([1-6])-->", lo: float = 1, hi: float = 6) -> Column:
    """Score of an ordinal text: exact table first, then a leading digit pattern, then a plain number in range."""
    text = F.trim(_c(col))
    known = F.when(F.lit(False), F.lit(None).cast("double"))
    for label, score in table.items():
        known = known.when(text == F.lit(label), F.lit(None if score is None else float(score)).cast("double"))
    digits = F.regexp_extract(text, pattern, 1)
    plain = text.try_cast("double")
    known = known.when(digits != "", digits.try_cast("double"))
    return known.when(plain.between(lo, hi), plain)


def ordinal_unmapped(col, table: dict, pattern: str = r"^([1-6])-->") -> Column:
    """True for text that is neither in the table, nor matches the pattern, nor is a number."""
    text = F.trim(_c(col))
    known = text.isin(list(table)) if table else F.lit(False)
    return text.isNotNull() & ~known & (F.regexp_extract(text, pattern, 1) == "") & text.try_cast("double").isNull()


def says_yes(col, word: str = "expired") -> Column:
    """Boolean outcome text: 1 when it starts with the word, whatever its case."""
    return F.when(F.startswith(F.lower(F.trim(_c(col))), F.lit(word)), 1).otherwise(0)


def year_range(col) -> tuple[Column, Column]:
    """First and last year of a text like '2008 - 2010'."""
    pattern = r"(\d{4})\D+(\d{4})"
    return (F.regexp_extract(_c(col), pattern, 1).try_cast("int"),
            F.regexp_extract(_c(col), pattern, 2).try_cast("int"))


def calendar_year(range_text, admit_year, anchor_year) -> Column:
    """Calendar year rebuilt from a shifted date: middle of the year group plus the shift, half-even rounded."""
    lo, hi = year_range(range_text)
    return F.bround((lo + hi) / F.lit(2.0) + (_c(admit_year) - _c(anchor_year)), 0).cast("int")


def name_domain(col, prefixes, exact=(), default: str = "other") -> Column:
    """Domain of a feature name: the first matching prefix or exact name decides."""
    column = _c(col)
    branches = [F.when(column.startswith(p), F.lit(tag)) for p, tag in prefixes]
    branches += [F.when(column == F.lit(n), F.lit(tag)) for n, tag in exact]
    return F.coalesce(*branches, F.lit(default))
