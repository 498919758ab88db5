"""Cleaning applied to a freshly read table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import keywords as K
from sightline.functions.types import kind, null_nan, quoted

# Date layouts tried in this order, month before day.
DATE_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
    "yyyyMMdd",
    "M/d/yyyy HH:mm:ss",
    "M/d/yyyy HH:mm",
    "M/d/yyyy",
    "M/d/yy",
    "M-d-yyyy",
    "d-MMM-yyyy",
    "d-MMM-yy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "MMM yyyy",
    "MMMM yyyy",
    "yyyy-MM",
)
MONEY_MARKS = r"[$,€£¥\s%]"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
PROMOTE_SHARE = 0.8
PARSE_SHARE = 0.5
# End of fixed values.

TOKEN_PATTERNS = {
    "yyyy": r"\d{4}", "yy": r"\d{2}", "MMMM": "[A-Za-z]{3,9}", "MMM": "[A-Za-z]{3}", "MM": r"\d{2}",
    "M": r"\d{1,2}", "dd": r"\d{2}", "d": r"\d{1,2}", "HH": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}",
    "SSSSSS": r"\d{6}", "SSS": r"\d{3}", "XXX": r"(Z|[+-]\d{2}:\d{2})", "'T'": "T", "[": "(", "]": ")?",
}
LAYOUT_TOKEN = re.compile(r"y+|M+|d+|H+|m+|s+|S+|X+|'T'|.")
SHORT_YEAR = re.compile(r"(?<!y)yy(?!y)")


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if kind(f.dataType) == "string"]


def replace_columns(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
    return df.select(*[(changed[c] if c in changed else quoted(c)).alias(c) for c in df.columns])


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop rows, then columns, that are null throughout."""
    clean = null_nan(df)
    rows = clean.na.drop("all")
    counts = rows.agg(*[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(rows.columns)]).first()
    kept = [c for i, c in enumerate(rows.columns) if counts[i] > 0]
    if not kept:
        raise ValueError("All data is null")
    return rows.select(*[quoted(c) for c in kept])


def trim_strings(df: DataFrame) -> DataFrame:
    """Strip leading and trailing white space of any kind in string columns."""
    return replace_columns(
        df,
        {c: F.regexp_replace(F.regexp_replace(quoted(c), r"^\s+", ""), r"\s+$", "") for c in text_columns(df)},
    )


def parsed_date(c: Column) -> Column:
    """First layout that fits; null if none does.

    A year of two digits lies less than fifty years ahead.
    """
    horizon = F.year(F.current_date()) + 50
    found = []
    for layout in DATE_FORMATS:
        # A parser that fails is slow; the pattern lets only likely texts reach it.
        t = F.when(c.rlike(layout_pattern(layout)), F.try_to_timestamp(c, F.lit(layout)))
        if SHORT_YEAR.search(layout):
            t = F.when(F.year(t) >= horizon, t - F.expr("interval 100 years")).otherwise(t)
        found.append(t)
    return F.coalesce(*found)


def layout_pattern(layout: str) -> str:
    """Regular expression of the texts a date layout can describe."""
    return "^" + LAYOUT_TOKEN.sub(lambda m: TOKEN_PATTERNS.get(m.group(), re.escape(m.group())), layout) + "$"


def parse_dates(df: DataFrame) -> DataFrame:
    """Turn date-named string columns into timestamps if half of all rows parse."""
    named = [c for c in text_columns(df) if K.name_contains(c, K.DATE_PARSED)]
    if not named:
        return df
    hits = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(parsed_date(quoted(c))).alias(f"n{i}") for i, c in enumerate(named)],
    ).first()
    good = [c for i, c in enumerate(named) if hits[f"n{i}"] >= hits["n"] * PARSE_SHARE]
    return replace_columns(df, {c: parsed_date(quoted(c)) for c in good})


def parsed_number(c: Column) -> Column:
    """Number in a text with currency, percent and grouping marks removed, else null."""
    bare = F.regexp_replace(c, MONEY_MARKS, "")
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def promote_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn string columns into numbers if 80 % of their values are numeric."""
    named = list(columns) if columns is not None else text_columns(df)
    if not named:
        return df
    hits = df.agg(
        *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(named)],
        *[F.count(parsed_number(quoted(c))).alias(f"k{i}") for i, c in enumerate(named)],
    ).first()
    good = [
        c
        for i, c in enumerate(named)
        if hits[f"n{i}"] >= 2 and hits[f"k{i}"] / hits[f"n{i}"] >= PROMOTE_SHARE
    ]
    return replace_columns(df, {c: parsed_number(quoted(c)) for c in good})


def clean(df: DataFrame) -> DataFrame:
    """All steps in load order: empty rows and columns, blanks, dates, numbers.

    Only texts that mean a category or free text become numbers; identifiers and
    codes named as dates stay as they are.
    """
    from sightline.operators.profile import column_profile, semantic_types

    dated = parse_dates(trim_strings(drop_empty(df)))
    meaning = {r["column_name"]: r["semantic_type"] for r in semantic_types(column_profile(dated)).collect()}
    return promote_numeric(dated, [c for c in text_columns(dated) if meaning.get(c) in ("categorical", "text")])
