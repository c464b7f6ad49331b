"""Number column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column | str, places: int) -> Column:
    """A double to so many places as DuckDB rounds it: the scaled double's nearest whole number, halves away from zero.

    Spark's own ``round`` goes by the shortest decimal of the double: 41/640, a
    little under 0.0640625, is 0.064063 there and 0.064062 here. Negative values
    that come to nothing keep their sign. What is too large to have places, or no
    number, stays as it is.
    """
    x = F.col(value) if isinstance(value, str) else value
    scaled = F.abs(x) * F.lit(float(10**places))
    whole = F.floor(scaled).cast("double")
    near = (whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)) / F.lit(float(10**places))
    return F.when(scaled < float(2**52), F.signum(x) * near).otherwise(x)
