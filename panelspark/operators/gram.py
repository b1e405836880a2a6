"""Masked co-moments: joint counts, means and products of every column pair in one scan.

A pair's moments are those of the rows that have both columns, each column less its mean over
exactly these rows. A task takes its Arrow batches by mask: the columns that are present in
the same rows share one centred block, whose products with their own columns are one matrix
product. Batches and then tasks are merged by the differences of their means, so a column that
is constant where another is present has a variance of exactly zero there, whatever it is
elsewhere, and no earlier scan for means is needed. The shuffle is p * p / 2 cells a task,
whatever the number of rows.
"""

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

BY = "_by"
CELL = "n double, mx double, my double, sxx double, syy double, sxy double"


def moments(raw):
    """(n, m, s, c) of p columns, absent values as NaN.

    ``m[i, j]`` and ``s[i, j]`` are mean and sum of squares of column i over the rows that have
    i and j, ``c[i, j]`` the sum of products of i and j there, all about these means.
    """
    p, mask = raw.shape[1], ~np.isnan(raw)
    n, m, s, c = np.zeros((4, p, p))
    kinds, kind_of = np.unique(mask, axis=1, return_inverse=True)
    for k in range(kinds.shape[1]):
        own, rows = np.flatnonzero(kind_of.ravel() == k), kinds[:, k]
        if not rows.any():
            continue
        x, has = raw[rows], mask[rows]
        count = has.sum(axis=0)
        first = np.where(count > 0, x[has.argmax(axis=0), np.arange(p)], 0.0)
        d = np.where(has, x - first, 0.0)
        shift = d.sum(axis=0) / np.maximum(count, 1)
        d = np.where(has, d - shift, 0.0)
        n[:, own], m[:, own], s[:, own] = count[:, None], (first + shift)[:, None], (d * d).sum(axis=0)[:, None]
        c[:, own] = d.T @ d[:, own]
    return n, m, s, c


def merged(a, b):
    """Moments of the rows of both."""
    (na, ma, sa, ca), (nb, mb, sb, cb) = a, b
    n = na + nb
    share = nb / np.maximum(n, 1.0)
    d, weight = mb - ma, na * share
    return n, ma + d * share, sa + sb + d * d * weight, ca + cb + d * d.T * weight


def cells(df: DataFrame, cols, by=None) -> DataFrame:
    """(_by, i, j, n, sxx, syy, sxy) of the column numbers i <= j over rows with both.

    Sums are about the means of these rows.
    """
    p = len(cols)

    def run(batches):
        import pyarrow as pa
        found = {}
        for b in batches:
            if not b.num_rows:
                continue
            groups = np.array(b.column(BY).to_pylist(), dtype=object)
            raw = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in cols])
            for g in set(groups.tolist()):
                add = moments(raw[groups == g])
                found[g] = merged(found[g], add) if g in found else add
        i, j = np.triu_indices(p)
        for g, (n, m, s, c) in found.items():
            data = {BY: pa.array([g] * len(i), pa.string()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()),
                    "n": n[i, j], "mx": m[i, j], "my": m[j, i], "sxx": s[i, j], "syy": s[j, i], "sxy": c[i, j]}
            yield pa.RecordBatch.from_pydict(data)

    x = df.select((F.lit("") if by is None else F.col(by)).alias(BY), *[F.col(c).cast("double").alias(c) for c in cols])
    if by is not None:
        x = x.filter(F.col(BY).isNotNull())
    parts = x.mapInArrow(run, f"{BY} string, i int, j int, {CELL}")
    # tasks' means are told from the least of them, which is all of them where a column is constant
    key, some = [BY, "i", "j"], F.col("n") > 0
    least = {c: F.min(F.when(some, F.col(c))).over(Window.partitionBy(*key)) for c in ("mx", "my")}
    parts = parts.withColumns({f"d{c[1]}": F.when(some, F.col(c) - v).otherwise(0.0) for c, v in least.items()})
    n, dx, dy = F.col("n"), F.col("dx"), F.col("dy")
    sums = parts.groupBy(*key).agg(
        F.sum("n").alias("n"), F.sum(n * dx).alias("ax"), F.sum(n * dy).alias("ay"),
        F.sum(F.col("sxx") + n * dx * dx).alias("sxx"), F.sum(F.col("syy") + n * dy * dy).alias("syy"),
        F.sum(F.col("sxy") + n * dx * dy).alias("sxy"))
    rows = F.nullif(F.col("n"), F.lit(0.0))
    return sums.select(*key, "n", *[(F.col(s) - F.col(a) * F.col(b) / rows).alias(s) for s, a, b in (
        ("sxx", "ax", "ax"), ("syy", "ay", "ay"), ("sxy", "ax", "ay"))])


def correlation(df: DataFrame, cols, min_periods=252) -> DataFrame:
    """(a, b, corr, n_pairs) of every column pair on the rows that have both."""
    names = F.array(*[F.lit(c) for c in cols])
    c = cells(df, cols).filter("i < j")
    n, vx, vy = F.nullif(F.col("n"), F.lit(0.0)), F.col("sxx"), F.col("syy")
    ok = (F.col("n") >= min_periods) & (F.sqrt(F.greatest(vx, F.lit(0.0)) / n) > 1e-12) & (F.sqrt(F.greatest(vy, F.lit(0.0)) / n) > 1e-12)
    corr = F.when(ok, F.col("sxy") / (F.sqrt(vx) * F.sqrt(vy)))
    return c.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), corr.alias("corr"), F.col("n").cast("bigint").alias("n_pairs"))


def covariance(df: DataFrame, cols, by) -> DataFrame:
    """(by, c): population covariances of complete rows, the upper triangle in row order.

    One row per group with p * (p + 1) / 2 numbers.
    """
    c = cells(df, cols, by)
    cov = F.col("sxy") / F.nullif(F.col("n"), F.lit(0.0))
    rows = c.groupBy(F.col(BY).alias(by)).agg(F.array_sort(F.collect_list(F.struct("i", "j", cov.alias("v")))).alias("c"))
    return rows.select(by, F.transform("c", lambda x: x["v"]).alias("c"))
