"""Exact order statistics without sorting or shuffling the rows.

The built-in exact ``percentile`` keeps every distinct value of a group in the memory of one task. Here one pass of mergeable sketches
brackets every wanted rank between two values that occur, the next pass counts the rows around the bracket, which proves it, and takes what lies
strictly inside: the values themselves where they are few, and otherwise a sketch of them that makes a closer bracket for one more pass. Values are only compared,
never subtracted, so infinite values and any range are fine, and a value shared by a third of all rows is an end of a bracket and not inside one. Each pass is one aggregate
over the pruned columns; two passes do up to some 10**8 rows a group, three up to 10**12. Recomputing a lost task gives the same counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsflow.functions.scalar import number
from obsflow.session import broadcast_if_small, checkpointed

RankFn = Callable[[Column], Column]

#: Values of a sketch, its accuracy (rank error of one in so many rows; a fraction of a grid step), and how many values may be inside at the end.
GRID, ACCURACY, HOLD = 2000, 20_000, 200_000
#: A bracket spans at most so many grid steps.
STEPS = 6


def long_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., feature, value)`` with missing values left out."""
    if len(cols) == 1:
        long = df.select(*by, F.lit(cols[0]).alias("feature"), number(F.col(f"`{cols[0]}`")).alias("value"))
    else:
        fields = [F.struct(F.lit(c).alias("feature"), number(F.col(f"`{c}`")).alias("value")) for c in cols]
        long = df.select(*by, F.inline(F.array(*fields)))
    return long.where(F.col("value").isNotNull())


def _sketch(values: Column, grid: int, accuracy: int) -> Column:
    shares = F.split(F.lit(",".join(repr(i / grid) for i in range(grid + 1))), ",").cast("array<double>")
    return F.percentile_approx(values, shares, accuracy)


def _bracket(k: Column, w: Column, n: Column, sketch: Column, lo: Column, hi: Column, grid: int) -> tuple[Column, Column]:
    """Ends that hold the ranks k to k + w of n rows, one grid step apart from them on either side; ``lo`` and ``hi`` beyond the sketch."""
    some = F.nullif(n, F.lit(0))
    first = F.floor(k / some * grid).cast("int") - 1
    last = F.ceil((k + 1 + w) / some * grid).cast("int") + 1
    below = F.when((n > 0) & (first >= 0) & (first <= grid), F.get(sketch, first)).otherwise(lo)
    above = F.when((n > 0) & (last >= 0) & (last <= grid), F.get(sketch, last)).otherwise(hi)
    return below.alias("lo"), above.alias("hi")


def _ends(targets: DataFrame, pairs: Sequence[tuple[str, str, str]], by: Sequence[str]) -> DataFrame:
    """The ends of all targets side by side, one row per group, and the largest ``room``."""
    ends = [F.max("room").alias("room")]
    for name, f, s in pairs:
        mine = (F.col("feature") == f) & (F.col("stat") == s)
        ends += [F.max(F.when(mine, F.col("lo"))).alias(f"lo{name}"), F.max(F.when(mine, F.col("hi"))).alias(f"hi{name}")]
    return targets.groupBy(*by).agg(*ends)


def _count(rows: DataFrame, end: Callable[[str], Column], features: dict[str, str], pairs: Sequence[tuple[str, str, str]], by: Sequence[str],
           inside: Callable[[Column], Column]) -> DataFrame:
    """One pass: for every target the rows below and up to its ends, and ``inside`` of the values between them."""
    items = []
    for name, f, s in pairs:
        v, lo, hi = F.col(features[f]), end(f"lo{name}"), end(f"hi{name}")
        between = (v > lo) & (v < hi)
        items.append(
            F.struct(
                F.lit(f).alias("feature"), F.lit(s).alias("stat"), F.count_if(v < lo).alias("c_below"), F.count_if(v <= lo).alias("c_lo"),
                F.count_if(between).alias("c_in"), F.count_if(v <= hi).alias("c_hi"), inside(F.when(between, v)).alias("inside"),
            )
        )
    return rows.groupBy(*by).agg(F.array(*items).alias("_all")).select(*by, F.inline("_all"))


def _located(
    df: DataFrame, cols: Sequence[str], ranks: dict[str, RankFn], by: Sequence[str], pairs: bool, grid: int = GRID, accuracy: int = ACCURACY, hold: int = HOLD
) -> DataFrame:
    """``(by..., feature, stat, rows, n, min, max, value, following)``, stored; ``following`` is the next value with ``pairs`` (the last has none)."""
    features = {c: f"_v{i}" for i, c in enumerate(cols)}
    rows = df.dropna(subset=[*by]) if by else df
    rows = rows.select(*by, *[number(F.col(f"`{c}`")).alias(v) for c, v in features.items()])
    first = [
        F.struct(
            F.lit(c).alias("feature"), F.count("*").alias("rows"), F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"),
            _sketch(F.col(v), grid, accuracy).alias("sketch"),
        )
        for c, v in features.items()
    ]
    known = rows.groupBy(*by).agg(F.array(*first).alias("_all")).select(*by, F.inline("_all")).where("n > 0")
    wanted = F.array(*[F.struct(F.lit(s).alias("stat"), f(F.col("n")).cast("long").alias("k")) for s, f in ranks.items()])
    one = F.least(F.lit(int(pairs)), F.col("n") - 1 - F.col("k"))
    targets = known.select("*", F.inline(wanted)).where((F.col("k") >= 0) & (F.col("k") < F.col("n"))).withColumn("w", one)
    ends = _bracket(F.col("k"), F.col("w"), F.col("n"), F.col("sketch"), F.col("min"), F.col("max"), grid)
    kept = [*by, "feature", "stat", "rows", "n", "min", "max", "k", "w"]
    # ``above`` and ``under`` are ends that counts have proven; they only ever move closer.
    proven = [F.col("min").alias("above"), F.col("max").alias("under")]
    targets = checkpointed(targets.select(*kept, *proven, *ends, (F.col("n") * (STEPS / grid)).alias("room")))
    key = [*by, "feature", "stat"]
    pairs_of = [(f"{i}_{j}", f, s) for i, f in enumerate(features) for j, s in enumerate(ranks)]
    done: list[DataFrame] = []
    while True:
        wide = _ends(targets, pairs_of, by)
        if by:
            wide = broadcast_if_small(wide)
            room, beside, end = wide.agg(F.max("room")).first()[0], rows.join(wide, [*by]), F.col
        else:
            found = wide.first().asDict()  # one row: two numbers per column and rank
            room, beside, end = found["room"], rows, lambda c, found=found: F.lit(found[c]).cast("double")
        finish = room is None or room <= hold

        def inside(v: Column, finish: bool = finish) -> Column:
            return F.sort_array(F.collect_list(v)) if finish else _sketch(v, grid, accuracy)

        found = targets.join(_count(beside, end, features, pairs_of, by, inside), key)
        low = F.col("k") < F.col("c_below")
        high = F.col("k") + F.col("w") >= F.col("c_hi")
        at = F.col("k") - F.col("c_lo")
        if finish:

            def value(place: Column) -> Column:
                return F.when(place < 0, F.col("lo")).when(place < F.col("c_in"), F.get("inside", place.cast("int"))).otherwise(F.col("hi"))

            following = F.when(F.col("w") > 0, value(at + 1))
            found = checkpointed(found.withColumns({"value": value(at), "following": following, "proven": ~(low | high)}).drop("inside"))
            done.append(found.where("proven").select(*kept, "value", "following"))
            found = found.where("not proven")
            if found.isEmpty():
                break
            inner, room = (F.col("lo"), F.col("hi")), F.col("n")
        else:
            inner = _bracket(at, F.col("w"), F.col("c_in"), F.col("inside"), F.col("lo"), F.col("hi"), grid)
            room = F.when(low | high, F.col("n")).otherwise(F.col("c_in") * (STEPS / grid))
        # What the counts refute is an end of its own: the next bracket reaches from there to the last proven end.
        found = found.withColumns({"_lo": inner[0], "_hi": inner[1], "room": room.cast("double"), "low": low, "high": high})
        found = found.withColumns({
            "above": F.when(F.col("low"), F.col("above")).when(F.col("high"), F.col("hi")).otherwise(F.col("lo")),
            "under": F.when(F.col("low"), F.col("lo")).when(F.col("high"), F.col("under")).otherwise(F.col("hi")),
        })
        refuted = F.col("low") | F.col("high")
        ends = F.when(refuted, F.col("above")).otherwise(F.col("_lo")).alias("lo"), F.when(refuted, F.col("under")).otherwise(F.col("_hi")).alias("hi")
        targets = checkpointed(found.select(*kept, "above", "under", *ends, "room"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("k", "w")


def order_statistics(df: DataFrame, cols: Sequence[str], ranks: dict[str, RankFn], *, by: Sequence[str] = (), **sketch: int) -> DataFrame:
    """The values at given 0-based ranks: ``(by..., feature, stat, rows, n, min, max, value)``.

    ``ranks`` maps a name to a function from the group's count of known values to the wanted rank; it may also use the column ``rows``, the
    count with missing ones. A rank outside the group has no row.
    """
    return _located(df, cols, ranks, by, False, **sketch).drop("following")


def between(value: Column, following: Column, share: Column) -> Column:
    """Linear interpolation; a null where it would lie between minus and plus infinity."""
    plain = value + (following - value) * share
    wide = value * (1 - share) + following * share  # where the difference is beyond the largest number
    inner = F.when(F.abs(following - value) < float("inf"), plain).otherwise(F.nanvl(wide, F.lit(None).cast("double")))
    return F.when((share == 0) | following.isNull() | (value == following), value).otherwise(inner)


def quantiles(
    df: DataFrame, cols: Sequence[str], probs: dict[str, float], *, by: Sequence[str] = (), exact: bool = True, accuracy: int = 10_000, **sketch: int
) -> DataFrame:
    """Linearly interpolated quantiles: ``(by..., feature, n, <one column per probability>)``.

    ``exact=False`` takes one pass with mergeable sketches instead (not interpolated). Rows whose group is unknown belong to no group.
    """
    group = [*by, "feature"]
    if not exact:
        df = df.dropna(subset=[*by]) if by else df
        return long_values(df, cols, by).groupBy(*group).agg(
            F.count("*").alias("n"),
            *[F.percentile_approx("value", p, accuracy).alias(name) for name, p in probs.items()],
        )

    def position(p: float, n: Column) -> Column:
        return (n - 1) * F.lit(float(p))

    ranks = {name: (lambda n, p=p: F.floor(position(p, n))) for name, p in probs.items()}
    found = _located(df, cols, ranks, by, True, **sketch)
    out = []
    for name, p in probs.items():
        place = position(p, F.col("n"))
        value = between(F.col("value"), F.col("following"), place - F.floor(place))
        out.append(F.max(F.when(F.col("stat") == name, value)).alias(name))
    return found.groupBy(*group).agg(F.max("n").alias("n"), *out)


def medians(df: DataFrame, cols: Sequence[str], *, by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    return quantiles(df, cols, {"median": 0.5}, by=by, exact=exact)
