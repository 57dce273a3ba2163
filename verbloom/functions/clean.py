"""Canonical forms of keys, labels and questions, and the choice of the rows that count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLANKS = " \t\r\n\x0b\x0c\u00a0"


def norm_id(c: Column | str) -> Column:
    """Lower case, without white space at both ends."""
    return F.btrim(F.lower(_col(c)), F.lit(_BLANKS))


def norm_label(c: Column | str) -> Column:
    """Upper case, without white space at both ends."""
    return F.btrim(F.upper(_col(c)), F.lit(_BLANKS))


def norm_question(c: Column | str) -> Column:
    """Lower case, runs of white space as one blank, none in front, no question marks and blanks at the end."""
    raw = _col(c)
    odd = raw.contains("  ")
    for blank in _BLANKS[1:]:
        odd = odd | raw.contains(blank)
    one = F.when(odd, F.regexp_replace(F.lower(raw), r"[\s\u00a0]+", " ")).otherwise(F.lower(raw))  # the pattern is costly and rarely needed
    return F.ltrim(F.rtrim(one, F.lit("? ")), F.lit(" "))


def usable(weight: Column) -> Column:
    """True for weights that count: finite and above 0; null otherwise counts as false."""
    return F.coalesce((weight > 0) & (weight < float("inf")) & ~F.isnan(weight), F.lit(False))


def latest(df: DataFrame, keys: list[str], order: str = "produced_at", ties: tuple[str, ...] = ()) -> DataFrame:
    """The newest row of each key (a missing time is the oldest); of rows equal in key and time one stays, that with the
    largest `ties`, missing ones last.

    Ask for it after the projection: whole rows of `df` are shuffled by the keys.
    """
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in (order, *ties)))
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
