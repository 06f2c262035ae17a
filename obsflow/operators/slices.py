"""Ordered work over range slices of counted rows.

Rows are dealt by ranges of their order into slices of about equal size and stored with the number of their slice. A window per
``(slice, key)`` then never holds more than a slice, whatever a key or a moment holds, and what a slice needs of the ones before it
comes from the table of edges: one row per slice and key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsflow.session import checkpointed

SLICE = "_slice"
#: Rows of a slice, about, once a table has more of them than the shuffle partitions hold at this size.
SLICE_ROWS = 250_000


def in_slices(df: DataFrame, order: Sequence[str | Column], slices: int | None = None) -> DataFrame:
    """``df`` with ``_slice``, stored: the numbers rise with ``order`` (unknown values first).

    Rows with the same values in ``order`` are told apart by their content and, where whole rows are equal, by the partition they come from,
    so neither a hot key nor a hot moment nor copies of one row make a slice large. There are as many slices as shuffle partitions, and more of them
    for a table that would make them larger than ``SLICE_ROWS``.
    """
    n = slices or max(_shuffle_partitions(df), -(-df.count() // SLICE_ROWS))
    plain = [c for c, t in df.dtypes if "map<" not in t and t != "variant"]
    rows = df.withColumn("_from", F.spark_partition_id())
    dealt = rows.repartitionByRange(n, *order, F.xxhash64(*plain), "_from").drop("_from")
    return checkpointed(dealt.withColumn(SLICE, F.spark_partition_id()))


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def side_by_side(rows: DataFrame) -> DataFrame:
    """Sliced rows laid out for windows per slice: where the slices outnumber the shuffle partitions, over as many partitions as slices."""
    n = rows.rdd.getNumPartitions()
    return rows.repartition(n, SLICE) if n > _shuffle_partitions(rows) else rows


def per_slice(by: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    return W.partitionBy(SLICE, *by).orderBy(*order)


def slices_before(by: Sequence[str]) -> WindowSpec:
    """Over edges: the slices of the same key in front. A key has one edge in every slice that it touches."""
    return W.partitionBy(*by).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)


def slices_after(by: Sequence[str]) -> WindowSpec:
    return W.partitionBy(*by).orderBy(F.desc(SLICE)).rowsBetween(W.unboundedPreceding, -1)


def join_edges(rows: DataFrame, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the columns of their edge; unknown keys meet theirs too. Both sides are laid out like the windows."""
    renamed = edges.select(*[F.col(k).alias(f"_edge_{k}") for k in (SLICE, *by)], *[c for c in edges.columns if c not in (SLICE, *by)])
    on = F.lit(True)
    for k in (SLICE, *by):
        on = on & rows[k].eqNullSafe(renamed[f"_edge_{k}"])
    return rows.join(renamed, on, "left").drop(*[f"_edge_{k}" for k in (SLICE, *by)])


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """Sliced rows with their 1-based position inside their key."""
    counts = rows.groupBy(SLICE, *by).agg(F.count("*").alias("_n"))
    carried = counts.select(SLICE, *by, F.coalesce(F.sum("_n").over(slices_before(by)), F.lit(0)).alias("_before"))
    inner = side_by_side(rows).withColumn(name, F.row_number().over(per_slice(by, order)).cast("long"))
    return join_edges(inner, carried, by).withColumn(name, F.col(name) + F.col("_before")).drop("_before")
