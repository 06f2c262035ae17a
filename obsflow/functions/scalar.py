"""Column expressions; all of them stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Euler-Mascheroni constant of the expected path length, the temperature and
# z-score bands of the qualitative phrase (checked in this order) and the label texts.
EULER_GAMMA = 0.5772156649015329
HOT_BANDS = [(38.0, "scorching, extreme heat"), (30.0, "very hot"), (22.0, "warm")]
COLD_BANDS = [(-12.0, "freezing, extreme cold"), (0.0, "very cold"), (10.0, "cold")]
MILD, NO_TEMPERATURE = "mild", "anomalous"
STRENGTH_BANDS = [(3.0, "a severe"), (2.0, "a notable")]
NO_STRENGTH = "an"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    """Double with NaN turned into NULL, so that one kind of missing value is left."""
    return F.nanvl(as_column(c).cast("double"), F.lit(None).cast("double"))


def day_of(ts: Column | str) -> Column:
    return F.to_date(as_column(ts))


def year_month(ts: Column | str) -> Column:
    return F.date_format(as_column(ts), "yyyy-MM")


def calendar_fields(ds: Column | str) -> dict[str, Column]:
    """Monday-based weekday, month, day of year and ISO week."""
    ds = as_column(ds)
    return {
        "dayofweek": F.weekday(ds),
        "month": F.month(ds),
        "dayofyear": F.dayofyear(ds),
        "weekofyear": F.weekofyear(ds),
    }


def cyclical_fields(ds: Column | str) -> dict[str, Column]:
    """Month and weekday as points on a circle."""
    ds = as_column(ds)
    month = F.month(ds) * (2 * math.pi / 12)
    weekday = F.weekday(ds) * (2 * math.pi / 7)
    return {
        "month_sin": F.sin(month),
        "month_cos": F.cos(month),
        "dow_sin": F.sin(weekday),
        "dow_cos": F.cos(weekday),
    }


def clip(c: Column | str, lower=None, upper=None) -> Column:
    """Limit a value on one or both sides; NULL stays NULL (bare ``greatest`` would lose it)."""
    value = as_column(c)
    out = value
    if upper is not None:
        out = F.least(out, upper if isinstance(upper, Column) else F.lit(upper))
    if lower is not None:
        out = F.greatest(out, lower if isinstance(lower, Column) else F.lit(lower))
    return F.when(value.isNotNull(), out)


def text_before(c: Column | str, separator: str) -> Column:
    return F.substring_index(as_column(c), separator, 1)


def region(continent: Column | None, zone: Column | None) -> Column:
    """Continent where known, else the area of the time zone name, else ``Unknown``."""
    parts = []
    if continent is not None:
        parts.append(continent)
    if zone is not None:
        parts.append(text_before(zone, "/"))
    return F.coalesce(*parts, F.lit("Unknown"))


def iso_utc(ts: Column | str) -> Column:
    """ISO text with a ``Z`` suffix; a missing time becomes the epoch."""
    return F.coalesce(
        F.date_format(as_column(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("1970-01-01T00:00:00Z")
    )


def short_sha(sha: Column | str) -> Column:
    sha = as_column(sha)
    return F.when(F.length(sha) > 0, F.substring(sha, 1, 7)).otherwise("unknown")


def short_date(text: Column | str) -> Column:
    """``yyyy-MM-dd`` of a parseable time text, otherwise the text as it is."""
    text = as_column(text)
    return F.coalesce(F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd"), text)


def anomaly_label(by_zscore: Column, by_forest: Column) -> Column:
    return (
        F.when(by_zscore & by_forest, "both")
        .when(by_zscore, "zscore_only")
        .when(by_forest, "if_only")
        .otherwise("normal")
    )


def detected_by(by_zscore: Column, by_forest: Column) -> Column:
    """Contract spelling of the label for a flagged row."""
    return (
        F.when(by_zscore & by_forest, "both")
        .when(by_zscore, "zscore")
        .otherwise("isolation_forest")
    )


def temperature_phrase(temperature: Column, z: Column) -> Column:
    magnitude = F.when(temperature.isNull(), NO_TEMPERATURE)
    for bound, words in HOT_BANDS:
        magnitude = magnitude.when(temperature >= bound, words)
    for bound, words in COLD_BANDS:
        magnitude = magnitude.when(temperature <= bound, words)
    strength = None
    for bound, words in STRENGTH_BANDS:
        hit = F.abs(z) >= bound
        strength = F.when(hit, words) if strength is None else strength.when(hit, words)
    return F.concat_ws(
        " ", strength.otherwise(NO_STRENGTH), magnitude.otherwise(MILD), F.lit("temperature anomaly")
    )


def render_record(ts: Column, country: Column, temp_c: Column, z: Column, method: Column) -> Column:
    """One searchable sentence per flagged record."""

    def text(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("None"))

    return F.concat(
        F.lit("On "), F.substring(F.coalesce(ts.cast("string"), F.lit("")), 1, 10),
        F.lit(", "), text(country), F.lit(" experienced "), temperature_phrase(temp_c, z),
        F.lit(": temperature "), text(temp_c), F.lit("C, z-score "), text(z),
        F.lit(", detected by "), text(method), F.lit("."),
    )


def average_path_length(n: Column) -> Column:
    """Expected depth of an unsuccessful search in a random binary tree over ``n`` points."""
    grown = 2 * (F.log(n - 1) + EULER_GAMMA) - 2 * (n - 1) / n
    return F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(grown)


def forest_score(mean_depth: Column, max_samples: Column | int) -> Column:
    """Isolation score in (-1, 0); lower is more anomalous."""
    size = max_samples if isinstance(max_samples, Column) else F.lit(max_samples)
    return -F.pow(F.lit(2.0), -mean_depth / average_path_length(size))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(query: Column, doc: Column) -> Column:
    """Cosine with the guards of the search: a zero query counts as length 1, a document as 1e-12."""
    query_norm = norm(query)
    query_norm = F.when(query_norm == 0, 1.0).otherwise(query_norm)
    return dot(query, doc) / (query_norm * F.greatest(norm(doc), F.lit(1e-12)))


def round_vector(v: Column, digits: int = 6) -> Column:
    return F.transform(v, lambda x: F.bround(x.cast("double"), digits))


def standardize(c: Column, median: Column, mean: Column, scale: Column) -> Column:
    """Median in place of a value that is missing or not finite, then centre and scale."""
    known = number(c)
    return (F.when(F.abs(known) < float("inf"), known).otherwise(median) - mean) / scale
