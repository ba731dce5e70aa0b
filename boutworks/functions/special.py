"""Error function and normal distribution as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TERMS = 200


def erf(x: Column) -> Column:
    """The all-positive series of erf; beyond 6 it is the sign.

    ``x`` is bound once for each row, as the value of a lambda: the series would work it out anew for each term.
    """

    def series(v: Column) -> Column:
        step = lambda acc, n: F.struct((acc["t"] * 2 * v * v / (2 * n + 1)).alias("t"), (acc["s"] + acc["t"] * 2 * v * v / (2 * n + 1)).alias("s"))
        first = F.struct(v.alias("t"), v.alias("s"))
        total = F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), first, step, lambda acc: acc["s"])
        return F.when(F.abs(v) >= 6, F.signum(v)).otherwise(F.lit(2 / math.sqrt(math.pi)) * F.exp(-v * v) * total)

    return F.get(F.transform(F.array(x.cast("double")), series), F.lit(0))


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1 + erf(z / math.sqrt(2)))
