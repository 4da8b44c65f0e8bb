"""Column functions over nanosecond times, edges and node attributes."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKETCH_BINS = 32
HOUR_NS = 3_600_000_000_000


def bucket(ts: Column, width: int) -> Column:
    """Start of the tumbling bucket that holds ts; integers only, floors below zero."""
    return ts - F.pmod(ts, F.lit(width))


def iso_from_ns(ns: Column) -> Column:
    """ISO text of the second that holds ns, in UTC (the session's time zone must be UTC)."""
    return F.date_format(F.timestamp_seconds(F.floor((ns - F.pmod(ns, F.lit(1_000_000_000))) / 1_000_000_000)), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def to_ns(text: Column) -> Column:
    """Nanoseconds from a number of them, from a fractional number (seconds up to 1e12) or from ISO text in UTC; else null."""
    s = F.trim(text)
    fractional = s.rlike(r"^[+-]?\d+(\.\d*([eE][+-]?\d+)?|[eE][+-]?\d+)$") & ~s.rlike(r"^[+-]?\d+$")
    number = s.try_cast("double")
    iso = F.unix_micros(F.coalesce(
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm[:ss][.SSSSSS][XXX]")), F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm[:ss][.SSSSSS][XXX]")), F.try_to_timestamp(s, F.lit("yyyy-MM-dd")),
    )) * 1000
    return F.coalesce(
        s.try_cast("bigint"),
        F.when(fractional, F.when(number > 1e12, number).otherwise(number * 1e9).try_cast("bigint")),
        iso,
    )


def file_stem(name: Column) -> Column:
    """File name without `.json` or `.json.<n>`, with anything but letters, digits, dot, underscore and dash as underscore."""
    return F.regexp_replace(F.regexp_replace(name, r"\.json(\.\d+)?$", ""), r"[^A-Za-z0-9._-]+", "_")


def relative_position(ts: Column, start: Column, end: Column) -> Column:
    """Place of ts in the closed window, 0 to 1; 0 outside it and for null."""
    inside = ts.between(start, end)
    return F.when(inside, (ts - start) / F.greatest(end - start, F.lit(1))).otherwise(F.lit(0.0))


def clipped_share(part: Column, whole: Column) -> Column:
    return F.least(F.greatest(part / F.greatest(whole, F.lit(1)), F.lit(0.0)), F.lit(1.0))


def edge_score(count: Column, size_sum: Column, span: Column) -> Column:
    """0.6 ln(1+count) + 0.3 ln(1+size) + 0.1 count/span; null where size is below -1, which sorts last."""
    size = F.when(size_sum > -1, F.log1p(size_sum.cast("double")))
    return 0.6 * F.log1p(count.cast("double")) + 0.3 * size + 0.1 * (count / F.greatest(span, F.lit(1)))


def ipv4_code(address: Column) -> Column:
    """The address as a number where it is four decimal parts up to 255, else null."""
    parts = F.split(address, r"\.")
    numbers = F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), p.try_cast("int")))
    valid = (F.size(parts) == 4) & F.forall(numbers, lambda p: F.coalesce(p.between(0, 255), F.lit(False)))
    return F.when(valid, F.aggregate(numbers, F.lit(0).cast("long"), lambda a, p: a * 256 + p))


@F.pandas_udf(T.LongType())
def _name_code(names: pd.Series) -> pd.Series:
    return names.map(lambda s: int.from_bytes(hashlib.blake2b(s.encode(), digest_size=4, person=b"ip").digest(), "big"))


def address_code(address: Column) -> Column:
    """Number of an IPv4 address, hash of any other name; null counts as the empty name."""
    text = F.coalesce(address, F.lit(""))
    return F.coalesce(ipv4_code(text), _name_code(text))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _token_sketch(token_lists: pd.Series) -> pd.Series:
    known: dict[str, int] = {}

    def bin_of(token: str) -> int:
        if token not in known:
            known[token] = hashlib.blake2b(token.encode(), digest_size=8, person=b"cmd").digest()[-1] % SKETCH_BINS
        return known[token]

    def sketch(tokens) -> list[float]:
        counts = [0.0] * SKETCH_BINS
        for t in tokens:
            counts[bin_of(t)] += 1.0
        return counts

    return token_lists.map(sketch)


def token_sketch(text: Column) -> Column:
    """Counts of a command line's tokens (two characters or more) in 32 hash bins."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-zA-Z0-9_]+"), lambda t: F.length(t) >= 2)
    return _token_sketch(tokens)


def as_flag(value: Column, default: int = 1) -> Column:
    return F.coalesce((value.try_cast("int") != 0).cast("int"), value.try_cast("boolean").cast("int"), F.lit(default))
