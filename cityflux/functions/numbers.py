"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import EARTH_RADIUS_KM


def as_long(df: DataFrame, name: str) -> Column:
    """Cast to bigint, rounding fractions half to even; integers are passed through."""
    kind = dict(df.dtypes)[name]
    col = F.col(name)
    if kind in ("bigint", "int", "smallint", "tinyint", "string"):
        return col.cast("long")
    return F.rint(col.cast("double")).cast("long")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 when the whole is 0 or unknown."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat = F.radians(lat2) - F.radians(lat1)
    dlon = F.radians(lon2) - F.radians(lon1)
    half_lat, half_lon = F.sin(dlat / 2.0), F.sin(dlon / 2.0)
    chord = (
        half_lat * half_lat
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    )
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(clamp(chord, 0.0, 1.0)))


# Draws are a pure function of (seed, key), so any partitioning, retry or lost
# executor gives the same rows. MD5 keeps them reproducible in other SQL engines.
_DRAW_BITS = 52


def uniform(seed: int, *key) -> Column:
    """A draw in [0, 1) for this key."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k) if isinstance(k, str) else k for k in key])
    head = F.conv(F.substring(F.md5(text), 1, _DRAW_BITS // 4), 16, 10).cast("long")
    return head.cast("double") / F.lit(float(2**_DRAW_BITS))


# Replicated draws: one hash per key, then cheap arithmetic per replicate.
REPLICA_PRIME = 2**31 - 1


def replica_words(seed: int, *key) -> tuple[Column, Column]:
    """Two words of one hash, uniform below ``REPLICA_PRIME``; the second is not 0."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k) if isinstance(k, str) else k for k in key])
    digest = F.md5(text)
    word = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return word(1) % REPLICA_PRIME, word(9) % (REPLICA_PRIME - 1) + 1


def replica_draw(word1: Column, word2: Column, replica: Column) -> Column:
    """An integer in [0, REPLICA_PRIME); independent between any two replicates."""
    return (word1 + word2 * replica) % REPLICA_PRIME
