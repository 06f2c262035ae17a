"""Weighted rendezvous hashing of record keys, and gapless slots inside shards. DataFrame functions only.

Every shard draws ``-ln(u) / weight`` with ``u`` from the MD5 of ``key:shard``; the smallest draw wins. The draw depends on nothing but
the key, the shard and its weight, so a further shard only takes rows into itself, and a changed weight moves rows only from or to
that shard. A null key hashes as the empty string. Rows with one key share a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLICE_ROWS = 100_000  # rows of one window group, on average
FIXED_BYTES = 16


def key_text(key: str = "doc_id") -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def draw(key: Column, shard: Column, weight: Column) -> Column:
    """Exponential draw with rate ``weight``; infinite for a weight of zero."""
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string"))), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / float(1 << 52)
    return F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf")))


def winner(key: Column, weights: list[float]) -> Column:
    """``struct(cost, shard)`` of the smallest draw; ties go to the lower shard."""
    if not any(w > 0 for w in weights):
        raise ValueError("a shard needs a positive weight")
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    return F.array_min(F.transform(shards, lambda s: F.struct(draw(key, s["shard"], s["weight"]).alias("cost"), s["shard"].alias("shard"))))


def assign_shards(docs: DataFrame, weights: list[float], grown: list[float] = (), key: str = "doc_id") -> DataFrame:
    """The columns of ``docs`` with ``shard``, and ``grown_shard`` once shards of the weights ``grown`` are added.

    Columns of these names are replaced. An empty table stays empty.
    """
    k = key_text(key)
    won = docs.withColumn("_won", winner(k, weights))
    best = F.col("_won")
    if grown:
        more = [F.struct(draw(k, F.lit(i), F.lit(float(w))).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(grown, len(weights))]
        best = F.least(F.col("_won"), *more)
    return won.withColumns({"shard": F.col("_won.shard"), "grown_shard": best["shard"]}).drop("_won")


def number_slots(sharded: DataFrame, shards: int, order: list[str], key: str = "doc_id", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``slot``: gapless numbers from 0 in every ``shard``, by slices of the keys' hashes and then by ``order``.

    A window group is one slice of one shard; the number of slices follows the counted rows, so that no task gets a whole shard.
    Slices are shifted by the counts of those before them. Equal rows are numbered in any order.
    """
    total = sharded.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    slices = max(1, -(-total // (slice_rows * shards)))
    part = F.conv(F.substring(F.md5(key_text(key)), 1, 13), 16, 10).cast("long") % F.lit(slices)
    sliced = sharded.drop("slot").withColumn("_slice", part)
    counts = sliced.groupBy("shard", "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select("shard", "_slice", before.alias("_before"))
    inside = Window.partitionBy("shard", "_slice").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = sliced.withColumn("_at", F.row_number().over(inside) - 1)
    return numbered.join(shift, ["shard", "_slice"]).withColumn("slot", F.col("_at") + F.col("_before")).drop("_at", "_before", "_slice")


def document_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Digest of the documents in equal shards: id, size, checksum, law, shard, slot and the shard with one more."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + FIXED_BYTES).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law")
    )
    return number_slots(assign_shards(narrow, [1.0] * shards, [1.0]), shards, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
