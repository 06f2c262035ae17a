"""Key joins with fills and lookups, pivots and set operations on flagged rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsflow.session import broadcast_if_small


def join_on_feature(first: DataFrame, *others: DataFrame, on: str = "feature") -> DataFrame:
    """Inner join of several tables on one key."""
    for other in others:
        first = first.join(other, on)
    return first


def left_join_fill(left: DataFrame, right: DataFrame, on: Sequence[str], fill: dict[str, object]) -> DataFrame:
    """Left join; columns without a partner get their fill value."""
    joined = left.join(right, list(on), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def lookup(df: DataFrame, table: DataFrame, on: Sequence[str], *, keep_missing: bool = True) -> DataFrame:
    """Adds the columns of a lookup table; rows without an entry keep nulls or are dropped."""
    return df.join(broadcast_if_small(table), list(on), "left" if keep_missing else "inner")


def without_part(df: DataFrame, cols: Sequence[str], part: str) -> DataFrame:
    """Texts of ``cols`` without ``part``, wherever it stands (the common prefix of column names in a table of pairs); nulls stay."""
    return df.withColumns({c: F.replace(F.col(c), F.lit(part), F.lit("")) for c in cols}) if part else df


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """``df`` with other column names. An unknown column, or a name that would then stand twice, is an error."""
    unknown = [c for c in names if c not in df.columns]
    after = [names.get(c, c) for c in df.columns]
    if unknown or len(set(after)) < len(after):
        raise ValueError(f"cannot rename to {after}: unknown columns {unknown}" if unknown else f"names stand twice in {after}")
    return df.withColumnsRenamed(names)


def pivot_series(long: DataFrame, series: str, value: str, names: Sequence[str], *, row: str = "ds") -> DataFrame:
    """One column per named series, one row per date; the names are given, so no extra job looks for them."""
    return long.groupBy(row).pivot(series, list(names)).agg(F.avg(value))


def stacked_parts(**parts: DataFrame) -> DataFrame:
    """Union of tables by column name, the name of the part in ``part``."""
    out = None
    for name, df in parts.items():
        tagged = df.withColumn("part", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def union_dates(*tables: DataFrame, col: str = "ds") -> DataFrame:
    """Sorted distinct dates of several tables; each is reduced to its own dates first."""
    out = None
    for df in tables:
        dates = df.select(col).distinct()
        out = dates if out is None else out.union(dates)
    return out.distinct().orderBy(col)


def flagged_sets(a: DataFrame, b: DataFrame, everything: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(key..., segment)`` from two tables of flagged keys and the table of all keys.

    Intersection, both differences and the rest come out of one grouping of the tagged union.
    """
    no, yes = F.lit(False), F.lit(True)
    tagged = (
        a.select(*key, yes.alias("in_a"), no.alias("in_b"))
        .union(b.select(*key, no, yes))
        .union(everything.select(*key, no, no))
    )
    flags = tagged.groupBy(*key).agg(F.bool_or("in_a").alias("in_a"), F.bool_or("in_b").alias("in_b"))
    x, y = F.col("in_a"), F.col("in_b")
    segment = F.when(x & y, "both").when(x, "zscore_only").when(y, "if_only").otherwise("neither")
    return flags.select(*key, segment.alias("segment"))
