"""Means over all partners of an instrument, without a row per pair and date.

Every instrument's series is one row of arrays (at most one value per calendar day).
Instruments are dealt into tiles, and a task takes the series of two tiles: it goes over
the dates once with matrices of (instruments of one tile) x (instruments of the other) and
emits, per instrument and date, the sum and number of its partners' values. So what is
shuffled grows with instruments x tiles x dates, and a task holds two tiles of series.
"""

from pyspark.sql import DataFrame, functions as F

from ..functions.windows import KEY

SIZE = 64           # instruments of a tile
LEAST = 8           # tiles of a small universe, so that it uses 36 tasks
MOST = 4096         # partitions that the pairs of tiles are dealt into


def partner_sums(rets: DataFrame, sums, group=None) -> DataFrame:
    """(instrument, pos, total, n) from rows (instrument, pos, ret, group column).

    ``sums(left, right)`` takes two lists of (positions, values) and returns for either list
    (totals, counts) of shape (series, last position + 1), the pairs being all of left x right;
    right is None for the pairs inside left. Partners are those of the same group. An
    instrument without partners has no rows.
    """
    group = F.lit("") if group is None else F.col(group)
    series = (rets.filter("ret IS NOT NULL").groupBy(KEY, group.alias("_g"))
              .agg(F.array_sort(F.collect_list(F.struct("pos", "ret"))).alias("_s"))
              .select(KEY, "_g", F.col("_s.pos").alias("_p"), F.col("_s.ret").alias("_v")))
    n = max(LEAST, -(-rets.select(KEY).distinct().count() // SIZE))
    own = F.pmod(F.xxhash64(KEY), F.lit(n)).cast("int")
    tiles = series.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    tiles = tiles.withColumns({"_lo": F.least("_own", "_other"), "_hi": F.greatest("_own", "_other")}).drop("_other")

    def run(key, table):
        import numpy as np
        import pyarrow as pa
        names, own = table.column(KEY).to_pylist(), table.column("_own").to_pylist()
        at, value = (table.column(c).combine_chunks() for c in ("_p", "_v"))
        rows = [(at[i].values.to_numpy(), value[i].values.to_numpy()) for i in range(len(names))]
        lo, hi = key[1].as_py(), key[2].as_py()
        sides = [[i for i, t in enumerate(own) if t == side] for side in dict.fromkeys((lo, hi))]
        out = []
        if len(sides) == 1 and len(sides[0]) > 1:
            out = zip(sides, sums([rows[i] for i in sides[0]], None))
        elif len(sides) == 2 and all(sides):
            out = zip(sides, sums(*[[rows[i] for i in side] for side in sides]))
        found = [(names[i], totals[k], counts[k]) for side, (totals, counts) in out for k, i in enumerate(side)]
        return pa.table({KEY: pa.array([f[0] for f in found], pa.string()),
                         "t": pa.array([np.asarray(f[1], dtype=float) for f in found], pa.list_(pa.float64())),
                         "c": pa.array([np.asarray(f[2], dtype=np.int32) for f in found], pa.list_(pa.int32()))})

    # few bytes and much work: without a number AQE would put all tiles into a task or two
    tiles = tiles.repartition(min(n * (n + 1) // 2, MOST), "_g", "_lo", "_hi")
    parts = tiles.groupBy("_g", "_lo", "_hi").applyInArrow(run, f"{KEY} string, t array<double>, c array<int>")
    cells = parts.select(KEY, F.posexplode(F.arrays_zip("t", "c")).alias("pos", "e"))
    return cells.groupBy(KEY, "pos").agg(F.sum("e.t").alias("total"), F.sum("e.c").alias("n"))


def dense(series, length: int):
    """Values at positions 0 .. length - 1, NaN where a series has none."""
    import numpy as np
    out = np.full((len(series), length), np.nan)
    for k, (at, value) in enumerate(series):
        out[k, at] = value
    return out


def ewm_corr(alpha: float, last: int):
    """Sums of pairwise EWM correlations; weights decay over missing dates, values stay."""
    def sums(left, right):
        import numpy as np
        a = dense(left, last + 1).T.copy()
        b = a if right is None else dense(right, last + 1).T.copy()
        shape, inside = (a.shape[1], b.shape[1]), right is None
        weight, m = np.zeros(shape), np.zeros((5, *shape))
        corr, known = np.zeros(shape), np.zeros(shape, dtype=bool)
        # [totals, counts] of the rows and of the columns
        rows, cols = np.zeros((2, last + 1, shape[0])), np.zeros((2, last + 1, shape[1]))
        for t in range(last + 1):
            weight *= 1.0 - alpha
            x, y = np.broadcast_arrays(a[t][:, None], b[t][None, :])
            both = ~np.isnan(x) & ~np.isnan(y)
            if both.any():
                old = np.where(both, weight / (weight + alpha), 1.0)    # a first value has no old weight
                x, y = np.where(both, x, 0.0), np.where(both, y, 0.0)
                m = old * m + (1.0 - old) * np.stack([x, y, x * x, y * y, x * y])
                weight[both] = 1.0
                vx, vy = m[2] - m[0] * m[0], m[3] - m[1] * m[1]
                known = (vx > 1e-18) & (vy > 1e-18)
                if inside:
                    np.fill_diagonal(known, False)
                corr = np.where(known, (m[4] - m[0] * m[1]) / np.sqrt(np.where(known, vx * vy, 1.0)), 0.0)
            rows[:, t] = corr.sum(1), known.sum(1)
            cols[:, t] = corr.sum(0), known.sum(0)
        found = [(rows[0].T, rows[1].T)]
        return found if inside else found + [(cols[0].T, cols[1].T)]
    return sums


def rolling_corr(n: int, last: int):
    """Sums of pairwise correlations over the last ``n`` dates that both have, on those dates."""
    def sums(left, right):
        import numpy as np
        a = dense(left, last + 1)
        b = a if right is None else dense(right, last + 1)
        out = [(np.zeros(s.shape), np.zeros(s.shape)) for s in ((a,) if right is None else (a, b))]
        for i in range(len(a)):
            for j in range(i + 1 if right is None else 0, len(b)):
                at = np.flatnonzero(~np.isnan(a[i]) & ~np.isnan(b[j]))
                if len(at) < n:
                    continue
                x, y = a[i, at], b[j, at]
                moving = steps(x, n) & steps(y, n)      # a constant window has no correlation
                x, y = x - x.mean(), y - y.mean()
                sx, sy, sxx, syy, sxy = (window_sum(v, n) for v in (x, y, x * x, y * y, x * y))
                var = (sxx - sx * sx / n) * (syy - sy * sy / n)
                ok = moving & (var > 0)
                c, where = ((sxy - sx * sy / n)[ok] / np.sqrt(var[ok])), at[n - 1:][ok]
                for (totals, counts), k in ((out[0], i), (out[-1], j)):
                    totals[k, where] += c
                    counts[k, where] += 1
        return out
    return sums


def window_sum(v, n: int):
    import numpy as np
    s = np.concatenate([[0.0], np.cumsum(v)])
    return s[n:] - s[:-n]


def steps(v, n: int):
    """Whether each window of ``n`` values has two different ones."""
    import numpy as np
    changed = np.concatenate([[0], np.cumsum(v[1:] != v[:-1])])
    return changed[n - 1:] > changed[:len(v) - n + 1]
