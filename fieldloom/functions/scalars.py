"""Dates, numbers, arrays and configuration values as Column builders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def months_back(ts: Column, months: int) -> Column:
    """The same day of an earlier month and time of day; a day that month lacks runs over into the next."""
    at = ts.cast("timestamp_ntz")
    first = F.add_months(F.trunc(at, "MM"), -months)
    return F.date_add(first, F.dayofmonth(at) - 1).cast("timestamp_ntz") + (at - at.cast("date").cast("timestamp_ntz"))


def time_ago(ts: Column, now: Column) -> Column:
    """Age in words: just now, minutes, hours, days, and from a week on the date."""
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    s = F.floor((micros(now) - micros(ts)) / 1_000_000)
    ago = lambda unit, mark: F.concat(F.floor(s / unit).cast("string"), F.lit(f"{mark} ago"))
    return F.when(s < 60, "just now").when(s < 3600, ago(60, "m")).when(s < 86400, ago(3600, "h")).when(s < 604800, ago(86400, "d")).otherwise(F.date_format(ts, "yyyy-MM-dd"))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio0(a: Column, b: Column) -> Column:
    """a / b, zero where b is zero."""
    return F.coalesce(ratio(a, b), F.lit(0.0))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def argmax(values: Column) -> Column:
    """Place of the first greatest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_k(values: Column, k: int) -> Column:
    """``(index, value)`` of the greatest values; ties by index; k is kept between 1 and the size."""
    pairs = F.transform(values, lambda x, i: F.struct((-x).alias("minus"), i.cast("int").alias("index")))
    first = F.slice(F.array_sort(pairs), 1, F.least(F.greatest(F.lit(k), F.lit(1)), F.size(values)))
    return F.transform(first, lambda p: F.struct(p["index"].alias("index"), (-p["minus"]).alias("value")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def sign_bits(values: Column) -> Column:
    """The signs of up to 64 numbers as bits, first number highest."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("long")))


def bin_right(x: Column, bins: int) -> Column:
    """Bin of x in [0, 1] cut in equal parts that include their right edge; what lies outside goes to the ends."""
    edges = [F.lit(k / bins) for k in range(1, bins)]
    return reduce(lambda a, e: a + F.when(x > e, 1).otherwise(0), edges, F.lit(0)).cast("int")


def last_n(items: Column, n: int) -> Column:
    """The last n elements, or all of fewer."""
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), n)


def toggled(items: Column, x: Column) -> Column:
    """Without x if it is there, else with x at the end."""
    return F.when(F.array_contains(items, x), F.array_remove(items, x)).otherwise(F.array_append(items, x))


def inverted(m: Column) -> Column:
    """A map from values to keys."""
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["value"], e["key"])))


def flag(x: Column, default: bool) -> Column:
    """true, 1 and yes in any case; the default for null and blank."""
    t = F.lower(F.trim(x))
    return F.when(t.isNull() | (t == ""), F.lit(default)).otherwise(t.isin("true", "1", "yes"))


def leading_int(x: Column) -> Column:
    """The number a text begins with; null if none."""
    return F.nullif(F.regexp_extract(x, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("int")


def listed(x: Column) -> Column:
    """A list from a JSON array or from parts between commas."""
    parts = F.filter(F.transform(F.split(x, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.startswith(F.ltrim(x), F.lit("[")), F.from_json(x, "array<string>")).otherwise(parts)


def service_url(x: Column, default: str) -> Column:
    """A service's address without trailing slashes; the default for null and blank, null if it is no http address."""
    given = F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit(default))
    return F.when(given.rlike(r"(?i)^https?://[^/\s?#]+"), F.regexp_replace(given, "/+$", ""))


def timeout_ms(x: Column, default: int, low: int = 1000, high: int = 120_000) -> Column:
    """Milliseconds within bounds; the default for null and blank, null if it is none."""
    n = F.trim(x).try_cast("double")
    return F.when(F.coalesce(F.trim(x), F.lit("")) == "", F.lit(float(default))).when(n.between(low, high), n)
