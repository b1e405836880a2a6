"""Price families on the native grid: F1, F2, F6, F10 and return kernels E1-E7."""

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.joins import asof
from ..functions.numeric import ANNUAL, div, nonzero_sd, positive
from ..functions.windows import (KEY, ORDER, expanding_z, lag, log_return, ordered,
                                 percentile_rank, rsd, rsum, sma, strict, strict_chain, trailing,
                                 with_ewm, zscore)

WILDER = 1.0 / 14.0


def native_returns(bars: DataFrame, kind="log") -> DataFrame:
    """Per-instrument returns between consecutive own bars; first row dropped."""
    if kind == "log":
        ret = log_return()
    else:
        ret = div(F.col("close"), lag("close")) - 1.0
    return bars.withColumn("ret", ret).filter(F.col("ret").isNotNull()).select(KEY, ORDER, "ret")


def rolling_stats(rets: DataFrame, n=20) -> DataFrame:
    """Annualised rolling volatility and rolling mean of returns."""
    return rets.withColumns({"rolling_vol": rsd("ret", n) * math.sqrt(ANNUAL),
                             "rolling_mean": sma("ret", n)})


def gap_suspicion(simple_rets: DataFrame, missing: DataFrame, n=20, limit=2.0) -> DataFrame:
    """Extreme trailing z-score on the last bar before a missing session."""
    z = simple_rets.withColumn("z", zscore("ret", n))
    # the bar before each gap, by an as-of join (no range condition)
    prior = asof(missing.select(KEY, F.col("date").alias("gap")),
                 z.select(KEY, ORDER), KEY, "gap", ORDER, ORDER, "bar", block="year")
    gaps = prior.groupBy(KEY, F.col("bar").alias(ORDER)).agg(F.count("*").alias("n_missing"))
    return z.filter(F.abs("z") > limit).join(gaps, [KEY, ORDER]).select(KEY, ORDER, "z", "n_missing")


def counter_trend(bars: DataFrame) -> DataFrame:
    """F1: mean-reversion scores, RSI and Bollinger columns."""
    wins = (10, 20, 40)
    logc = F.ln(positive("close"))
    base, gap, out = {}, {}, {}
    base["_logc"] = logc
    base["_d"] = F.col("close") - lag("close")
    for n in wins:
        base[f"_sma{n}"] = sma("close", n)
        base[f"_lo{n}"] = strict(F.min, "close", n)
        base[f"_hi{n}"] = strict(F.max, "close", n)
    base["_sd20"] = rsd("close", 20)
    for n in wins:
        gap[f"_gap{n}"] = F.col("close") - F.col(f"_sma{n}")
    gap["_up"] = F.greatest(F.col("_d"), F.lit(0.0))
    gap["_dn"] = F.greatest(-F.col("_d"), F.lit(0.0))
    # greatest() skips NULL: keep the first row NULL
    gap["_up"] = F.when(F.col("_d").isNotNull(), gap["_up"])
    gap["_dn"] = F.when(F.col("_d").isNotNull(), gap["_dn"])
    df = strict_chain(bars, base, gap)
    for n in wins:
        out[f"f1_mr_score_{n}"] = -zscore(f"_gap{n}", n)
        out[f"f1_dist_ma_sigma_{n}"] = F.col(f"_gap{n}") / nonzero_sd(rsd(f"_gap{n}", n))
        out[f"f1_ret_reversal_{n}"] = lag("_logc", n) - F.col("_logc")
        out[f"f1_hilo_pos_{n}"] = ((F.col("close") - F.col(f"_lo{n}"))
                                   / positive(F.col(f"_hi{n}") - F.col(f"_lo{n}")))
    band = positive(4.0 * F.col("_sd20"))
    out["f1_bb_pctb_20"] = (F.col("close") - (F.col("_sma20") - 2.0 * F.col("_sd20"))) / band
    out["f1_bb_bandwidth_20"] = div(band, "_sma20")
    df = df.withColumns(out)
    # the RSI needs two exponential means; they share the instrument partitioning
    ew = with_ewm(df.withColumnsRenamed({"_up": "up_", "_dn": "dn_"}),
                  [("au", "up_", WILDER, 14), ("al", "dn_", WILDER, 14)], mask="up_")
    rsi = (F.when((F.col("al") == 0) & (F.col("au") > 0), F.lit(100.0))
           .otherwise(100.0 - 100.0 / (1.0 + F.col("au") / positive("al"))))
    names = [f"f1_{k}_{n}" for k in ("mr_score", "dist_ma_sigma", "ret_reversal", "hilo_pos")
             for n in wins]
    return ew.select(KEY, ORDER, *names, rsi.alias("f1_rsi_14"), "f1_bb_pctb_20",
                     "f1_bb_bandwidth_20")


def true_range():
    """max of h-l, |h-c1|, |l-c1|; greatest() skips the NULLs of the first bar."""
    pc = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc),
                      F.abs(F.col("low") - pc))


def corrected_skew(x, n, **kw):
    g1 = strict(F.skewness, x, n, **kw)
    return g1 * (math.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurt(x, n, **kw):
    g2 = strict(F.kurtosis, x, n, **kw)
    return (g2 * (n + 1) + 6.0) * ((n - 1) / ((n - 2) * (n - 3)))


def volatility(bars: DataFrame) -> DataFrame:
    """close-to-close and range volatility estimators."""
    ann = math.sqrt(ANNUAL)
    ok = F.least("open", "high", "low", "close") > 0
    hl = F.when((F.col("high") > 0) & (F.col("low") > 0), F.ln(F.col("high") / F.col("low")))
    co = F.when((F.col("close") > 0) & (F.col("open") > 0), F.ln(F.col("close") / F.col("open")))
    rs = F.when(ok, F.ln(F.col("high") / F.col("close")) * F.ln(F.col("high") / F.col("open"))
                + F.ln(F.col("low") / F.col("close")) * F.ln(F.col("low") / F.col("open")))
    df = strict_chain(
        bars,
        {"_r": log_return(), "_hl2": hl * hl, "_co2": co * co, "_rs": rs, "tr_": true_range()},
        {"_gk": 0.5 * F.col("_hl2") - (2.0 * math.log(2.0) - 1.0) * F.col("_co2"),
         "f2_vol_10": rsd("_r", 10) * ann, "f2_vol_20": rsd("_r", 20) * ann,
         "f2_vol_60": rsd("_r", 60) * ann,
         "f2_ret_skew_60": corrected_skew("_r", 60), "f2_ret_kurt_60": corrected_kurt("_r", 60)},
        {"f2_vol_ratio_20_60": F.col("f2_vol_20") / positive("f2_vol_60"),
         "f2_vol_pctile_20": percentile_rank("f2_vol_20", 252),
         "f2_vol_of_vol_20": rsd("f2_vol_20", 60),
         "f2_parkinson_20": F.sqrt(sma("_hl2", 20) / (4.0 * math.log(2.0)) * ANNUAL),
         "f2_garman_klass_20": F.sqrt(floor0(sma("_gk", 20)) * ANNUAL),
         "f2_rogers_satchell_20": F.sqrt(floor0(sma("_rs", 20))) * ann})
    df = with_ewm(df, [("f2_atr_14", "tr_", WILDER, 14)])
    return df.select(KEY, ORDER, *[c for c in df.columns if c.startswith("f2_")])


def floor0(x):
    """max(x, 0) that keeps NULL (greatest() would turn NULL into 0)."""
    return F.when(x < 0, 0.0).otherwise(x)


def momentum(bars: DataFrame) -> DataFrame:
    """momentum, MACD, ADX and Donchian position."""
    up, dn = F.col("high") - lag("high"), lag("low") - F.col("low")
    df = strict_chain(
        bars, {"_lc": F.ln(positive("close")), "_up": up, "_dn": dn, "tr_": true_range()},
        {"_r": F.col("_lc") - lag("_lc"),
         "pdm_": F.when((F.col("_up") > F.col("_dn")) & (F.col("_up") > 0), F.col("_up"))
         .otherwise(0.0),
         "mdm_": F.when((F.col("_dn") > F.col("_up")) & (F.col("_dn") > 0), F.col("_dn"))
         .otherwise(0.0),
         "_s20": sma("close", 20), "_s60": sma("close", 60)})
    prior = ordered().rowsBetween(-20, -1)
    hi, lo = (strict(f, "close", 20, frame=prior) for f in (F.max, F.min))
    df = df.withColumns({
        **{f"f6_ts_momentum_{n}": (F.col("_lc") - lag("_lc", n))
           / nonzero_sd(rsd("_r", n) * math.sqrt(n)) for n in (20, 60)},
        "f6_ma_cross_20_60": div(F.col("_s20") - F.col("_s60"), "_s60"),
        "_hi": hi, "_lo": lo})
    df = df.withColumn("f6_donchian_pos_20", 2.0 * (F.col("close") - F.col("_lo"))
                       / positive(F.col("_hi") - F.col("_lo")) - 1.0)
    df = with_ewm(df, [("e12", "close", 2.0 / 13.0, 12), ("e26", "close", 2.0 / 27.0, 26),
                       ("atr", "tr_", WILDER, 14), ("pe", "pdm_", WILDER, 14),
                       ("me", "mdm_", WILDER, 14)], mask="close")
    atr = positive("atr")
    df = strict_chain(
        df, {"f6_macd_12_26": F.col("e12") - F.col("e26"),
             "pdi": 100.0 * F.col("pe") / atr, "mdi": 100.0 * F.col("me") / atr},
        {"dx": 100.0 * F.abs(F.col("pdi") - F.col("mdi")) / positive(F.col("pdi") + F.col("mdi"))})
    df = with_ewm(df, [("sig", "f6_macd_12_26", 0.2, 9), ("f6_adx_14", "dx", WILDER, 14)])
    df = df.withColumn("f6_macd_hist_12_26_9", F.col("f6_macd_12_26") - F.col("sig"))
    return df.select(KEY, ORDER, *[c for c in df.columns if c.startswith("f6_")])


def price_action(bars: DataFrame) -> DataFrame:
    """intraday range and open-to-open returns."""
    po = lag("open")
    df = bars.withColumns({
        "f10_hl_range": F.when((F.col("high") > 0) & (F.col("low") > 0),
                               F.ln(F.col("high") / F.col("low"))),
        "f10_oto_ret": F.when((F.col("open") > 0) & (po > 0), F.ln(F.col("open") / po))})
    return df.select(KEY, ORDER, "f10_hl_range", sma("f10_hl_range", 20).alias("f10_hl_range_mean_20"),
                     "f10_oto_ret", sma("f10_oto_ret", 20).alias("f10_oto_ret_mean_20"))


def microstructure(bars: DataFrame) -> DataFrame:
    """volume, open interest and illiquidity."""
    df = strict_chain(
        bars, {"_r": log_return(), "_dp": F.col("close") - lag("close"),
               "_v": F.when(F.col("volume") > 0, F.col("volume")), "_pc": lag("close"),
               "f7_oi_level": F.col("open_interest"),
               "f7_oi_change": F.col("open_interest") - lag("open_interest"),
               "_doi": F.col("open_interest") - lag("open_interest", 20),
               "_dc": F.col("close") - lag("close", 20)},
        {"_dpl": lag("_dp"), "_am": F.abs("_r") / F.col("_v"),
         "_ky": F.abs("_r") / F.sqrt("_v")},
        {"_pp": F.col("_dp") * F.col("_dpl")})
    cov = sma("_pp", 20) - sma("_dp", 20) * sma("_dpl", 20)
    df = df.withColumns({
        "f7_volume_z_20": zscore("volume", 20),
        "f7_volume_trend_20": F.col("volume") / positive(sma("volume", 20)) - 1.0,
        "f7_oi_z_20": zscore("open_interest", 20),
        "f7_oi_price_div_20": F.signum("_doi") * F.signum("_dc"),
        "f7_amihud_20": F.avg("_am").over(trailing(20)),
        "amihud_illiquidity": sma("_am", 20),
        "f7_rolls_spread_20": 2.0 * F.sqrt(floor0(-cov)),
        "f7_kyles_lambda_20": sma("_ky", 20),
        "f7_overnight_gap": F.when((F.col("open") > 0) & (F.col("_pc") > 0),
                                   F.ln(F.col("open") / F.col("_pc")))})
    return df.select(KEY, ORDER, *[c for c in df.columns if c.startswith("f7_")],
                     "amihud_illiquidity")


def calendar_cycle(df: DataFrame) -> DataFrame:
    """F8: sine/cosine of weekday (Monday = 0) and month."""
    d = F.weekday("date").cast("double") * (2.0 * math.pi / 7.0)
    m = (F.month("date") - 1).cast("double") * (2.0 * math.pi / 12.0)
    return df.select(KEY, ORDER, F.sin(d).alias("f8_dow_sin"), F.cos(d).alias("f8_dow_cos"),
                     F.sin(m).alias("f8_month_sin"), F.cos(m).alias("f8_month_cos"))


def path_structure(bars: DataFrame) -> DataFrame:
    """F12 without Hurst: path shape and trend quality from window sums."""
    df = strict_chain(
        bars, {"_lc": F.ln(positive("close")), "_rn": F.row_number().over(ordered()).cast("double")},
        {"_r": F.col("_lc") - lag("_lc"), "_ma": sma("close", 21)},
        {"_rl": lag("_r"), "_ar": F.abs("_r"), "_s5": rsum("_r", 5), "_mal": lag("_ma")})
    inner = trailing(20)
    n21 = F.count("_r").over(trailing(21)) == 21
    s5 = trailing(17)
    out = {
        "f12_autocorr_21": F.when(n21 & (F.stddev_samp("_r").over(inner) > 0),
                                  F.corr("_r", "_rl").over(inner)),
        "f12_efficiency_ratio_21": F.abs(rsum("_r", 21)) / positive(rsum("_ar", 21)),
        "f12_variance_ratio_5_21": F.when(n21, F.var_samp("_s5").over(s5))
        / positive(5.0 * strict(F.var_samp, "_r", 21)),
        "f12_ma21_slope": F.ln(F.col("_ma") / F.col("_mal")) / nonzero_sd(rsd("_r", 21))}
    for n in (10, 21, 42):
        w = trailing(n)
        rho = F.when(
            F.count("_lc").over(w) == n, F.corr("_lc", "_rn").over(w))
        # slope t-statistic of a simple regression: r*sqrt(n-2)/sqrt(1-r^2)
        out[f"f12_trend_tval_{n}"] = rho * math.sqrt(n - 2) / F.sqrt(positive(1.0 - rho * rho))
    df = df.withColumns(out)
    return df.select(KEY, ORDER, *[c for c in df.columns if c.startswith("f12_")])


# The scale-dependent columns that get an expanding z-score twin.
Z_TWIN_COLUMNS = (
    "f2_vol_10", "f2_vol_20", "f2_vol_60", "f2_vol_of_vol_20", "f2_parkinson_20",
    "f2_garman_klass_20", "f2_atr_14", "f2_rogers_satchell_20", "f6_macd_12_26",
    "f6_macd_hist_12_26_9", "f7_amihud_20", "f7_oi_level", "f7_oi_change",
    "f7_kyles_lambda_20", "f7_rolls_spread_20", "f7_overnight_gap", "f10_hl_range",
    "f10_hl_range_mean_20", "f10_oto_ret", "f10_oto_ret_mean_20", "f12_ma21_slope",
    "f15_expected_hit_time", "f15_path_tortuosity_20", "f15_realized_semi_vol_ratio_20",
)


def z_twins(df: DataFrame, min_count=60) -> DataFrame:
    """Add ``z_<column>`` for every listed column present in ``df``."""
    return df.withColumns({f"z_{c}": expanding_z(c, min_count)
                           for c in Z_TWIN_COLUMNS if c in df.columns})
