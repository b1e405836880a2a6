"""Families that look at a whole trailing window: Hurst, wavelet energy, first
passage, mutual information and transfer entropy.

Rows are first spread over (instrument, block) partitions with a halo, because
each row costs hundreds of operations and there are few instruments.
"""

import hashlib
import math
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.windows import KEY, ORDER, halo_blocks, lag, log_return, rsum, sma, trailing

BLK = (KEY, "blk")


def blocked_returns(bars: DataFrame, lookback: int, extra=()) -> DataFrame:
    df = bars.select(KEY, ORDER, *extra, log_return().alias("r"))
    return halo_blocks(df, lookback)


# ---- Hurst ---------------------------------------------------------------------

def chunk_sizes(n: int, k=5, least=8) -> list:
    """k window lengths from ``least`` to n // 2 in equal ratios, in whole numbers.

    Length i is the largest whole s with s^(k-1) <= least^(k-1-i) * (n // 2)^i; equal
    ones are listed once.
    """
    most, sizes = n // 2, []
    for i in range(k if most >= least else 0):
        bound, s = least ** (k - 1 - i) * most ** i, least
        while (s + 1) ** (k - 1) <= bound:
            s += 1
        if s not in sizes:
            sizes.append(s)
    return sizes


def rescaled_range(x: np.ndarray, sizes) -> np.ndarray:
    """Slope of ln(mean R/S) on ln(size) for each row of a batch of windows."""
    n = x.shape[1]
    ys = []
    for s in sizes:
        seg = x[:, : n // s * s].reshape(len(x), n // s, s)
        z = np.cumsum(seg - seg.mean(axis=2, keepdims=True), axis=2)
        sd = seg.std(axis=2, ddof=1)
        rs = np.where(sd > 1e-12, (z.max(axis=2) - z.min(axis=2)) / np.where(sd > 1e-12, sd, 1), np.nan)
        k = (~np.isnan(rs)).sum(axis=1)
        ys.append(np.log(np.where(k > 0, np.nansum(rs, axis=1) / np.maximum(k, 1), np.nan)))
    y, lx = np.column_stack(ys), np.log(np.array(sizes, float))
    ok = ~np.isnan(y)
    m = ok.sum(axis=1)
    sx, sy = (ok * lx).sum(axis=1), np.nansum(y, axis=1)
    sxy, sxx = np.nansum(y * lx, axis=1), (ok * lx * lx).sum(axis=1)
    den = m * sxx - sx * sx
    return np.where((m >= 2) & (den > 0), (m * sxy - sx * sy) / np.where(den > 0, den, 1), np.nan)


def window_udf(fn, dtype="double"):
    """Arrow-batched UDF over an array column; NULL arrays stay NULL.

    Array expressions with nested lambdas would recompute window-wide terms for
    every element, so these statistics use one numpy call per batch or row.
    """
    @F.pandas_udf(dtype)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for arrs in batches:
            out = np.full(len(arrs), np.nan)
            have = arrs.notna().to_numpy()
            if have.any():
                out[have] = fn(arrs[have].to_numpy())
            yield pd.Series(out, index=arrs.index)
    return apply


def null_if_nan(x):
    return F.nanvl(x, F.lit(None).cast("double"))


def hurst(bars: DataFrame, n=100) -> DataFrame:
    """F12e: slope of ln(mean R/S) on ln(chunk size) over a trailing window."""
    sizes = chunk_sizes(n)
    df = blocked_returns(bars, n)
    w = trailing(n, BLK, "pos")
    df = df.withColumn("arr", F.when(F.count("r").over(w) == n, F.collect_list("r").over(w)))
    slope = window_udf(lambda arrs: rescaled_range(np.vstack(arrs), sizes))
    return df.filter("own").select(KEY, ORDER, null_if_nan(slope("arr")).alias(f"f12_hurst_{n}"))


# ---- wavelet energy ----------------------------------------------------------------

# Daubechies-4 decomposition low-pass taps.
DB4_LOW = (-0.010597401784997278, 0.032883011666982945, 0.030841381835986965,
           -0.18703481171888114, -0.02798376941698385, 0.6308807679295904,
           0.7148465705525415, 0.23037781330885523)
DB4_HIGH = tuple((-1.0) ** (k + 1) * DB4_LOW[7 - k] for k in range(8))


def analysis_matrix(n: int, levels=5):
    """Rows of the periodised detail filters, level by level, as one matrix.

    Convention: output o of a stage is sum_j f[j] * x[(4 + 2o - j) mod m]; an
    odd-length stage input first repeats its last value.
    """
    basis, bands = np.eye(n), []
    for _ in range(levels):
        if len(basis) % 2:
            basis = np.vstack([basis, basis[-1:]])
        m = len(basis)
        idx = (4 + 2 * np.arange(m // 2)[:, None] - np.arange(8)[None, :]) % m
        low, high = (np.einsum("j,ojn->on", np.array(f), basis[idx]) for f in (DB4_LOW, DB4_HIGH))
        bands.append(high)
        basis = low
    return np.vstack(bands), np.cumsum([0] + [len(b) for b in bands])


def wavelet_energy(bars: DataFrame, n=252, levels=5) -> DataFrame:
    """share of squared variation in each detail band of a trailing window.

    The transform is linear, so a batch of windows is one matrix product.
    """
    df = blocked_returns(bars, n)
    w = trailing(n, BLK, "pos")
    df = df.withColumn("arr", F.when(F.count("r").over(w) == n, F.collect_list("r").over(w)))
    df = df.filter("own").select(KEY, ORDER, "arr")

    @F.pandas_udf("array<double>")
    def energies(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        mat, cut = analysis_matrix(n, levels)
        for arrs in batches:
            x = np.vstack(arrs.to_numpy())
            sq = np.square(x @ mat.T)
            tot = np.square(x).sum(axis=1)
            share = np.add.reduceat(sq, cut[:-1], axis=1) / np.where(tot > 0, tot, np.nan)[:, None]
            yield pd.Series([None if np.isnan(v).any() else v for v in share], index=arrs.index)

    done = df.filter("arr IS NOT NULL").select(KEY, ORDER, energies("arr").alias("e"))
    out = done.unionByName(df.filter("arr IS NULL").select(
        KEY, ORDER, F.lit(None).cast("array<double>").alias("e")))
    return out.select(KEY, ORDER, *[F.get("e", F.lit(i)).alias(f"f13_mra_energy_d{i + 1}")
                                    for i in range(levels)])


# ---- first passage -------------------------------------------------------------------

def first_passage(bars: DataFrame, pt=1.0, sl=1.0, h=10, n=252, n_sims=200, seed=42,
                  vol_window=20) -> DataFrame:
    """Resampled paths of h steps against +-mult * sigma * sqrt(h).

    Step d of path i draws index (6 hex digits of SHA-256(key|date|i|seed)) mod n
    from the window ending the day before, so a row's value depends on its own
    past only.
    """
    df = blocked_returns(bars, n + 1)
    prior = Window.partitionBy(*BLK).orderBy("pos").rowsBetween(-n, -1)
    vw = trailing(vol_window, BLK, "pos")
    df = df.withColumns({
        "arr": F.when(F.count("r").over(prior) == n, F.collect_list("r").over(prior)),
        "sigma": F.when(F.count("r").over(vw) == vol_window, F.stddev_samp("r").over(vw))})
    df = df.filter("own").withColumn("tag", F.concat_ws("|", KEY, F.col(ORDER).cast("string")))

    @F.pandas_udf("hit double, timeout double")
    def simulate(arr: pd.Series, sigma: pd.Series, tag: pd.Series) -> pd.DataFrame:
        out = np.empty((len(arr), 2))
        for k, (past, s, t) in enumerate(zip(arr, sigma, tag)):
            raw = b"".join(hashlib.sha256(f"{t}|{i}|{seed}".encode()).digest()[:3 * h]
                           for i in range(n_sims))
            b = np.frombuffer(raw, np.uint8).reshape(n_sims, h, 3).astype(np.int64)
            draw = (b[..., 0] << 16) | (b[..., 1] << 8) | b[..., 2]
            path = np.round(np.cumsum(past[draw % n], axis=1), 12)
            touch = (path >= round(pt * s * math.sqrt(h), 12)) | (path <= -round(sl * s * math.sqrt(h), 12))
            any_ = touch.any(axis=1)
            out[k, 0] = np.median(touch.argmax(axis=1)[any_] + 1) if any_.any() else h + 1
            out[k, 1] = 1.0 - any_.mean()
        return pd.DataFrame(out, columns=["hit", "timeout"])

    ok = df.filter("arr IS NOT NULL AND sigma > 1e-12")
    sim = ok.select(KEY, ORDER, simulate("arr", "sigma", "tag").alias("x")).select(
        KEY, ORDER, F.col("x.hit").alias("f15_expected_hit_time"),
        F.col("x.timeout").alias("f15_prob_timeout"))
    rest = df.filter("arr IS NULL OR sigma IS NULL OR sigma <= 1e-12").select(
        KEY, ORDER, F.lit(None).cast("double").alias("f15_expected_hit_time"),
        F.lit(None).cast("double").alias("f15_prob_timeout"))
    return sim.unionByName(rest)


def path_shape(bars: DataFrame, n=20) -> DataFrame:
    """Tortuosity and up/down semi-volatility ratio (NULL return = 0)."""
    df = bars.withColumn("r", log_return())
    up = F.when(F.col("r") > 0, F.col("r") * F.col("r")).otherwise(0.0)
    dn = F.when(F.col("r") < 0, F.col("r") * F.col("r")).otherwise(0.0)
    return df.select(
        KEY, ORDER, (rsum(F.abs("r"), n) / (F.abs(rsum("r", n)) + 1e-12)).alias(f"f15_path_tortuosity_{n}"),
        (F.sqrt(sma(up, n)) / (F.sqrt(sma(dn, n)) + 1e-12)).alias(f"f15_realized_semi_vol_ratio_{n}"))


# ---- information measures -----------------------------------------------------------

def quantile_bins(v: np.ndarray, k: int) -> np.ndarray:
    """Right-closed bins at the distinct linear-interpolation k-quantiles."""
    s, last = np.sort(v), len(v) - 1
    edges = []
    for i in range(k + 1):
        lo, frac = (last * i) // k, ((last * i) % k) / k
        edges.append(s[lo] + frac * (s[min(lo + 1, last)] - s[lo]))
    return np.maximum(np.searchsorted(np.unique(edges), v, side="left") - 1, 0)


def entropy(*codes: np.ndarray) -> float:
    """Entropy (nats) of the joint distribution of integer codes from 0."""
    joint = codes[0]
    for c in codes[1:]:
        joint = joint * (int(c.max()) + 1) + c
    p = np.bincount(joint.astype(np.int64))
    p = p[p > 0] / len(joint)
    return float(-(p * np.log(p)).sum())


def mutual_information(bars: DataFrame, x: str, n=252, bins=5) -> DataFrame:
    """H1: rolling MI (nats) between a column and the return, quantile-binned."""
    df = blocked_returns(bars, n, extra=(x,))
    w = trailing(n, BLK, "pos")
    both = F.col(x).isNotNull() & F.col("r").isNotNull()
    df = df.withColumn("prs", F.flatten(F.collect_list(
        F.when(both, F.array(F.col(x).cast("double"), "r"))).over(w)))
    full = (F.col("pos") >= n) & (F.size("prs") >= 2 * max(2 * bins, 10))

    def one(flat):
        v = flat.reshape(-1, 2)
        a, b = quantile_bins(v[:, 0], bins), quantile_bins(v[:, 1], bins)
        return entropy(a) + entropy(b) - entropy(a, b)

    mi = window_udf(lambda arrs: [one(a) for a in arrs])
    df = df.filter("own").withColumn("prs", F.when(full, F.col("prs")))
    return df.select(KEY, ORDER, null_if_nan(mi("prs")).alias("mutual_information"))


def transfer_entropy(bars: DataFrame, n=126, bins=3, vol_window=20) -> DataFrame:
    """H2: transfer entropy from volatility to signal accuracy at lag one."""
    df = bars.select(KEY, ORDER, "s", log_return().alias("r"))
    vw = trailing(vol_window)
    df = df.withColumn("vol", F.when(F.count("r").over(vw) == vol_window, F.stddev_samp("r").over(vw)))
    ok = F.col("s").isNotNull() & F.col("r").isNotNull()
    df = df.withColumn("acc", F.when(ok, (F.col("s") * F.col("r") > 0).cast("double")))
    df = df.withColumns({"ap": lag("acc"), "vp": lag("vol")})
    df = halo_blocks(df, n)
    w = trailing(n, BLK, "pos")
    valid = F.col("acc").isNotNull() & F.col("ap").isNotNull() & F.col("vp").isNotNull()
    df = df.withColumn("tr", F.flatten(F.collect_list(
        F.when(valid, F.array("acc", "ap", "vp"))).over(w)))
    full = (F.col("pos") > n) & (F.size("tr") >= 3 * max(2 * bins * 4, 20))

    def one(flat):
        t = flat.reshape(-1, 3)
        now, was = t[:, 0].astype(int), t[:, 1].astype(int)
        v = quantile_bins(t[:, 2], bins)
        return max(entropy(now, was) - entropy(was) - entropy(now, was, v) + entropy(was, v), 0.0)

    te = window_udf(lambda arrs: [one(a) for a in arrs])
    df = df.filter("own").withColumn("tr", F.when(full, F.col("tr")))
    return df.select(KEY, ORDER, null_if_nan(te("tr")).alias("transfer_entropy"))
