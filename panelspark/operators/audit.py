"""Signal audit: lag correlations, PnL, bootstrap intervals, stability, tags."""

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.joins import with_scalars
from ..functions.numeric import digest_draw, positive
from ..functions.windows import KEY, ORDER, log_return, ordered, running

# Lags, horizon and tag threshold of the audit.
LAGS = (-5, -3, -1, 0, 1, 3, 5, 10, 20)
HORIZON = 10
THRESHOLD = 0.05
STATS = ("mean_pnl_next_day", "mean_pnl_h", "hit_rate_h")
STABILITY = ("corr_trail_1", "corr_trail_5", "corr_trail_10", "corr_trail_20", "corr_fwd_1",
             "mean_pnl_next_day", "mean_pnl_h", "hit_rate_h")


def corr_name(k):
    return f"corr_trail_{k}" if k > 0 else f"corr_fwd_{-k}" if k < 0 else "corr_contemp_0"


def aligned_frame(panel: DataFrame, signals: DataFrame, keys=(KEY,), lags=LAGS,
                  h=HORIZON) -> DataFrame:
    """C1 + W1: inner-join signals to returns, then take lags on the joined rows.

    One row per (keys, date) with the signal, its lagged returns and its PnL.
    ``signals`` may carry further key columns (such as the stability window).
    """
    rets = panel.select(KEY, ORDER, log_return().alias("r"))
    df = signals.join(rets, [KEY, ORDER])
    w = Window.partitionBy(*keys).orderBy(ORDER)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    r = F.col("r")
    csum = F.when(r.isNotNull(), F.sum("r").over(run))
    df = df.withColumn("_c", csum)
    cols = {f"r_lag_{k}".replace("-", "m"): (F.lag(r, k).over(w) if k >= 0
                                             else F.lead(r, -k).over(w)) for k in lags}
    s = F.col("s").cast("double")
    cols["pnl_next_day"] = s * F.lead(r, 1).over(w)
    cols["pnl_h"] = s * (F.lead("_c", h).over(w) - F.col("_c"))
    df = df.withColumns(cols).filter("s IS NOT NULL").drop("_c")
    return df.withColumns({"bet": (F.col("s") != 0).cast("int"),
                           "hit_h": (F.coalesce(F.col("pnl_h") > 0, F.lit(False)) & (F.col("s") != 0)).cast("int")})


def safe_corr(x, y):
    """Pearson correlation; NULL below 3 pairs or for a constant side."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = (F.when(both, F.col(c).cast("double")) for c in (x, y))
    ok = (F.count(a) >= 3) & (F.stddev_pop(a) > 1e-12) & (F.stddev_pop(b) > 1e-12)
    return F.when(ok, F.corr(a, b))


def point_stats(lags=LAGS):
    """Aggregates of D18 and D19 over an aligned (or resampled) frame."""
    out = [safe_corr("s", f"r_lag_{k}".replace("-", "m")).alias(corr_name(k)) for k in lags]
    out += [F.avg("pnl_next_day").alias("mean_pnl_next_day"), F.avg("pnl_h").alias("mean_pnl_h"),
            F.avg(F.when((F.col("bet") == 1) & F.col("pnl_h").isNotNull(), F.col("hit_h")))
            .alias("hit_rate_h")]
    return out


def tag(x, threshold=THRESHOLD):
    return (F.when(x.isNull(), "n/a").when(x > threshold, "trend")
            .when(x < -threshold, "mean_reverting").otherwise("mixed"))


def with_tags(df: DataFrame) -> DataFrame:
    """Tag the mean of the non-null trailing correlations and two single lags."""
    trail = F.filter(F.array(*[F.col(corr_name(k)) for k in (1, 5, 10, 20)]),
                     lambda v: v.isNotNull())
    mean = F.when(F.size(trail) > 0,
                  F.aggregate(trail, F.lit(0.0), lambda a, v: a + v) / F.size(trail))
    return df.withColumns({"mean_trail_corr": mean}).withColumns(
        {"tag": tag(F.col("mean_trail_corr")), "tag_trail_1": tag(F.col("corr_trail_1")),
         "tag_trail_h10": tag(F.col("corr_trail_10"))})


def signal_audit(frame: DataFrame, keys=(KEY,)) -> DataFrame:
    """All instruments in one grouped aggregate."""
    return with_tags(frame.groupBy(*keys).agg(
        F.count("s").alias("n_signal_dates"), F.sum("bet").alias("n_bets"), *point_stats()))


def moments(lags=LAGS) -> dict:
    """Per-row terms whose sums give every point statistic: name -> column."""
    s, out = F.col("s").cast("double"), {}
    for k in lags:
        y = F.col(f"r_lag_{k}".replace("-", "m"))
        have, c = y.isNotNull(), corr_name(k)
        for name, x in (("n", F.lit(1.0)), ("x", s), ("y", y), ("xx", s * s), ("yy", y * y), ("xy", s * y)):
            out[f"{c}__{name}"] = F.when(have, x).otherwise(0.0)
    ph = F.col("pnl_h").isNotNull()
    for c, x, cond in (("mean_pnl_next_day", F.col("pnl_next_day"), F.col("pnl_next_day").isNotNull()),
                       ("mean_pnl_h", F.col("pnl_h"), ph),
                       ("hit_rate_h", F.col("hit_h").cast("double"), (F.col("bet") == 1) & ph)):
        out[f"{c}__n"], out[f"{c}__x"] = F.when(cond, 1.0).otherwise(0.0), F.when(cond, x).otherwise(0.0)
    return out


def from_moments(lags=LAGS):
    """The point statistics from sums of ``moments``."""
    out = []
    for k in lags:
        n, x, y, xx, yy, xy = (F.col(f"{corr_name(k)}__{m}") for m in ("n", "x", "y", "xx", "yy", "xy"))
        n1 = F.when(n >= 3, n)
        vx, vy = xx - x * x / n1, yy - y * y / n1
        ok = (vx / n1 > 1e-15) & (vy / n1 > 1e-15)
        out.append(F.when(ok, (xy - x * y / n1) / F.sqrt(F.when(ok, vx * vy))).alias(corr_name(k)))
    return out + [F.try_divide(F.col(f"{c}__x"), F.col(f"{c}__n")).alias(c) for c in STATS]


def block_bootstrap(frame: DataFrame, keys=(KEY,), n_boot=1000, block=20, lags=LAGS,
                    seed=42, lo=0.025, hi=0.975) -> DataFrame:
    """Moving-block bootstrap intervals for all keys and replicates at once.

    Every statistic is a ratio of sums, so a block is the difference of two running sums
    of its key: a replicate reads two rows per block and not ``block`` rows. Starts are
    hash draws per (keys, replicate, block); the picked sums are partially aggregated.
    """
    w = Window.partitionBy(*keys).orderBy(ORDER)
    terms = moments(lags)
    sums = frame.select(*keys, (F.row_number().over(w) - 1).alias("_pos"), *[
        F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c, x in terms.items()])
    # sums up to and including a position; the one before the first is zero and is left out
    sizes = frame.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n >= 2")
    boots = sizes.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    size = F.least(F.lit(block), F.col("_n"))
    boots = boots.withColumn("_j", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / size))))
    # ten draws per digest
    digest = F.sha2(F.concat_ws("|", *keys, F.lit(seed), F.col("_b"), F.floor(F.col("_j") / 10)), 256)
    start = digest_draw(digest, (F.col("_j") % 10).cast("int"), F.col("_n") - size + 1)
    take = F.least(size, F.col("_n") - F.col("_j") * size)
    ends = F.array(F.struct((start + take - 1).alias("p"), F.lit(1.0).alias("sign")),
                   F.struct((start - 1).alias("p"), F.lit(-1.0).alias("sign")))
    picks = boots.select(*keys, "_b", F.explode(ends).alias("e")).select(
        *keys, "_b", F.col("e.p").alias("_pos"), F.col("e.sign").alias("_sign")).filter("_pos >= 0")
    reps = picks.join(sums, [*keys, "_pos"]).groupBy(*keys, "_b").agg(*[
        F.sum(F.col("_sign") * F.col(c)).alias(c) for c in terms])
    reps = reps.select(*keys, "_b", *from_moments(lags))
    names = [corr_name(k) for k in lags] + list(STATS)
    q = []
    for c in names:
        q += [F.percentile(c, F.lit(lo)).alias(f"{c}_lo"), F.percentile(c, F.lit(hi)).alias(f"{c}_hi")]
    return reps.groupBy(*keys).agg(*q)


def split_halves(signals: DataFrame) -> DataFrame:
    """Tag dates before / from the median signal date (one row per date)."""
    days = signals.select(ORDER).distinct().agg(F.percentile(
        F.datediff(ORDER, F.lit("1970-01-01").cast("date")), F.lit(0.5)).alias("_med"))
    cut = days.select(F.date_add(F.lit("1970-01-01").cast("date"),
                                 F.floor("_med").cast("int")).alias("split_date"))
    df = with_scalars(signals, cut)
    return df.withColumn("half", F.when(F.col(ORDER) < F.col("split_date"), "first")
                         .otherwise("second"))


def stability(panel: DataFrame, n_boot=1000) -> DataFrame:
    """Statistics on the full window and both halves; flag = opposite signs
    with both intervals away from zero. The three copies run as one audit."""
    sig = split_halves(panel.select(KEY, ORDER, "s"))
    sig = sig.withColumn("part", F.explode(F.array(F.lit("full"), F.col("half"))))
    sig = sig.select(KEY, "part", ORDER, "s")
    keys = (KEY, "part")
    frame = aligned_frame(panel, sig, keys)
    audit = frame.groupBy(*keys).agg(*point_stats())
    ci = block_bootstrap(frame, keys, n_boot)
    df = audit.join(ci, list(keys))
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("v"), F.col(f"{m}_lo").alias("lo"),
                 F.col(f"{m}_hi").alias("hi")) for m in STABILITY])).alias("x")).select(*keys, "x.*")

    def pick(part, c):
        return F.max(F.when(F.col("part") == part, F.col(c)))

    wide = long.groupBy(KEY, "metric").agg(
        *[pick(p, "v").alias(n) for p, n in (("full", "full_window"), ("first", "first_half"),
                                             ("second", "second_half"))],
        *[pick(p, c).alias(f"{p}_{c}") for p in ("first", "second") for c in ("lo", "hi")])
    away = [(F.col(f"{p}_lo") > 0) | (F.col(f"{p}_hi") < 0) for p in ("first", "second")]
    flip = ((F.col("first_half") > 0) != (F.col("second_half") > 0)) & away[0] & away[1]
    return wide.select(KEY, "metric", "full_window", "first_half", "second_half",
                       F.coalesce(flip, F.lit(False)).alias("sign_flip_flag"))


# ---- exploratory tables -------------------------------------------------------

def forward_by_label(panel: DataFrame, h: int) -> DataFrame:
    """Mean forward return by label, hit rate and PnL Sharpe at horizon h."""
    df = panel.withColumn("r", log_return())
    w = ordered().rowsBetween(1, h)
    df = df.withColumn("f", F.when(F.count("r").over(w) == h, F.sum("r").over(w)))
    df = df.filter("s IS NOT NULL AND f IS NOT NULL").withColumn("pnl", F.col("s") * F.col("f"))
    s, f = F.col("s"), F.col("f")
    return df.groupBy(KEY).agg(
        *[(F.avg(F.when(s == v, f)) * 1e4).alias(f"mean_r_{n}_bp")
          for n, v in (("short", -1), ("flat", 0), ("long", 1))],
        F.avg(F.when(s != 0, (F.signum("f") == F.signum(s.cast("double"))).cast("int")))
        .alias("hit_rate"),
        (F.avg("pnl") / F.when(F.stddev_samp("pnl") > 1e-12, F.stddev_samp("pnl"))
         * math.sqrt(252.0)).alias("pnl_sharpe"))


def pnl_rows(panel: DataFrame) -> DataFrame:
    """Signal times next-day return."""
    df = panel.withColumn("r", log_return())
    return (df.withColumn("pnl", F.col("s") * F.lead("r").over(ordered()))
            .filter("pnl IS NOT NULL").select(KEY, ORDER, "s", "pnl"))


def equity_curves(panel: DataFrame) -> DataFrame:
    """Cumulative PnL per instrument."""
    return pnl_rows(panel).select(KEY, ORDER, "pnl", F.sum("pnl").over(running()).alias("cum_pnl"))


def portfolio(panel: DataFrame) -> DataFrame:
    """Equal-weight daily PnL and its cumulative sum (one row per date)."""
    day = pnl_rows(panel).groupBy(ORDER).agg(F.avg("pnl").alias("pnl")).withColumn("_one", F.lit(1))
    return day.withColumn("cum_pnl", F.sum("pnl").over(running(key="_one"))).drop("_one")


def portfolio_summary(panel: DataFrame) -> DataFrame:
    p = pnl_rows(panel).groupBy(ORDER).agg(F.avg("pnl").alias("pnl"))
    return p.agg((F.avg("pnl") * 252).alias("ann_mean"),
                 (F.stddev_samp("pnl") * math.sqrt(252.0)).alias("ann_vol"),
                 (F.avg("pnl") / F.stddev_samp("pnl") * math.sqrt(252.0)).alias("sharpe"))


def lead_lag_grid(panel: DataFrame, grid: DataFrame, ks=range(-5, 6)) -> DataFrame:
    """corr(s_t, r_{t+k}) with the shift on the union grid of panel dates."""
    df = grid.join(panel.select(KEY, ORDER, "s"), [KEY, ORDER], "left")
    w = ordered()
    cols = {f"k{i}": (F.lead("ret", k).over(w) if k >= 0 else F.lag("ret", -k).over(w))
            for i, k in enumerate(ks)}
    df = df.withColumns(cols).filter("s IS NOT NULL")
    aggs = []
    for i, k in enumerate(ks):
        both = F.col(f"k{i}").isNotNull()
        s, y = F.when(both, F.col("s").cast("double")), F.col(f"k{i}")
        ok = (F.count(y) > 30) & (F.stddev_pop(s) > 1e-12) & (F.stddev_pop(y) > 1e-12)
        aggs.append(F.struct(F.lit(k).alias("k"), F.when(ok, F.corr(s, y)).alias("corr")))
    return (df.groupBy(KEY).agg(F.array(*aggs).alias("a"))
            .select(KEY, F.explode("a").alias("x")).select(KEY, "x.k", "x.corr"))


def conditional_vol(panel: DataFrame) -> DataFrame:
    """Annualised volatility of the next-day return, active versus flat."""
    df = panel.withColumn("r", log_return())
    df = df.withColumn("f", F.lead("r").over(ordered())).filter("s IS NOT NULL AND f IS NOT NULL")
    ann = math.sqrt(252.0)
    out = df.groupBy(KEY).agg(
        (F.stddev_samp(F.when(F.col("s") != 0, F.col("f"))) * ann).alias("vol_active"),
        (F.stddev_samp(F.when(F.col("s") == 0, F.col("f"))) * ann).alias("vol_flat"))
    return out.withColumn("ratio", F.col("vol_active") / positive("vol_flat"))


def max_drawdown(panel: DataFrame) -> DataFrame:
    """Worst drop of the cumulative log return below its running maximum."""
    df = panel.withColumn("r", log_return()).filter("r IS NOT NULL")
    df = df.withColumn("cum", F.sum("r").over(running()))
    df = df.withColumn("dd", F.round(F.col("cum") - F.max("cum").over(running()), 9))
    return df.groupBy(KEY).agg(
        (F.exp(F.min("dd")) - 1.0).alias("max_drawdown"),
        F.min(F.struct("dd", ORDER))[ORDER].alias("mdd_date"))


def backtest_metrics(panel: DataFrame) -> DataFrame:
    """CAGR, volatility, Sharpe, Sortino, drawdown, holding, turnover."""
    df = pnl_rows(panel)
    w = ordered()
    df = df.withColumns({"cum": F.sum("pnl").over(running()),
                         "turn": F.abs(F.col("s") - F.lag("s").over(w)),
                         "chg": F.when(F.col("s") == F.lag("s").over(w), 0).otherwise(1)})
    df = df.withColumns({"dd": F.col("cum") - F.max("cum").over(running()),
                         "run": F.sum("chg").over(running())})
    ann = math.sqrt(252.0)
    neg = F.when(F.col("pnl") < 0, F.col("pnl") * F.col("pnl")).otherwise(0.0)
    active_runs = F.count_distinct(F.when(F.col("s") != 0, F.col("run")))
    return df.groupBy(KEY).agg(
        F.count("*").alias("n_days"), (F.avg("pnl") * 252.0).alias("ann_log_return"),
        (F.stddev_samp("pnl") * ann).alias("ann_vol"),
        (F.avg("pnl") / F.stddev_samp("pnl") * ann).alias("sharpe"),
        (F.avg("pnl") / F.sqrt(F.avg(neg)) * ann).alias("sortino"),
        F.min("dd").alias("max_drawdown_log"),
        F.try_divide(F.count_if(F.col("s") != 0), active_runs).alias("avg_holding"),
        F.avg("turn").alias("turnover"))
