"""Guarded scalar arithmetic. ANSI mode is on, so every ratio is guarded."""

from pyspark.sql import Column, functions as F

# Absolute floor under which a standard deviation counts as zero.
SD_FLOOR = 1e-12
ANNUAL = 252.0


def c(x):
    return F.col(x) if isinstance(x, str) else x


def rnd(x, digits=6, name=None) -> Column:
    """Round a double; adding 0.0 turns -0.0 into 0.0."""
    out = F.round(c(x).cast("double"), digits) + F.lit(0.0)
    return out.alias(name) if name else (out.alias(x) if isinstance(x, str) else out)


def rounded(df, digits=6, special=None, keep=()):
    """Round all double columns of ``df`` (per-column digits in ``special``)."""
    special = special or {}
    cols = []
    for name, dtype in df.dtypes:
        if dtype == "double" and name not in keep:
            cols.append(rnd(F.col(name), special.get(name, digits), name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def positive(x) -> Column:
    """x where x > 0, else NULL."""
    return F.when(c(x) > 0, c(x))


def nonzero_sd(x) -> Column:
    return F.when(c(x) > SD_FLOOR, c(x))


def div(a, b) -> Column:
    """a / b with NULL on a zero denominator."""
    return F.try_divide(c(a).cast("double"), c(b).cast("double"))


def log_pos(x) -> Column:
    return F.ln(positive(x))


def xlogx(p) -> Column:
    """p * ln p with the limit 0 at p = 0."""
    return F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0))


def no_nan(x) -> Column:
    """IEEE NaN to NULL; used once per source column."""
    return F.nanvl(c(x).cast("double"), F.lit(None).cast("double"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where inner lambdas use it.

    A column would not do: a filter pushed below its projection copies the expression to
    every place that reads it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digest_draw(digest: Column, d, modulus) -> Column:
    """The d-th 6-hex-digit number of a SHA-256 digest, reduced by ``modulus``."""
    start = F.lit(1) + F.lit(6) * d
    return F.conv(F.substring(digest, start, F.lit(6)), 16, 10).cast("bigint") % modulus
