"""Event labels: triple barrier, uniqueness, trend scanning, CUSUM sampling."""

import math

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import let, positive
from ..functions.windows import KEY, ORDER, lag, ordered, running, with_ewm


def ewm_std(df: DataFrame, x: str, out: str, span: int, adjust=False, key=KEY, order=ORDER):
    """Bias-corrected exponentially weighted standard deviation of a column
    without interior NULLs. With n values and b = 1 - alpha the weights are
    alpha*b^i with b^(n-1) on the first (adjust=False) or b^i (adjust=True)."""
    a = 2.0 / (span + 1.0)
    b = 1.0 - a
    df = df.withColumns({"sq_x": c2(x), "n_x": F.count(x).over(running(key, order)),
                         "x0_x": F.first(x, True).over(running(key, order))})
    df = with_ewm(df, [("m1_x", x, a, 1), ("m2_x", "sq_x", a, 1)], key, order, mask=x)
    n = F.col("n_x")
    if adjust:
        tail = F.pow(F.lit(b), n)
        sw = (1.0 - tail) / a
        sw2 = (1.0 - F.pow(F.lit(b * b), n)) / (1.0 - b * b)
        m1 = (F.col("m1_x") - tail * F.col("x0_x")) / a / sw
        m2 = (F.col("m2_x") - tail * F.col("x0_x") * F.col("x0_x")) / a / sw
        keep = 1.0 - sw2 / (sw * sw)
    else:
        tail = F.pow(F.lit(b * b), n - 1)
        sw2 = tail + a * a * (1.0 - tail) / (1.0 - b * b)
        m1, m2 = F.col("m1_x"), F.col("m2_x")
        keep = 1.0 - sw2
    var = F.greatest(m2 - m1 * m1, F.lit(0.0)) / keep
    return df.withColumn(out, F.when(n >= 2, F.sqrt(var))).drop(
        "sq_x", "n_x", "x0_x", "m1_x", "m2_x")


def c2(x):
    return F.col(x) * F.col(x)


def label_vol(bars: DataFrame, span=100) -> DataFrame:
    """EWM daily volatility of log returns, the label's sigma."""
    lc = F.ln(positive("close"))
    df = bars.withColumn("r_x", lc - F.lag(lc).over(ordered()))
    return ewm_std(df, "r_x", "sigma", span).drop("r_x")


def triple_barrier(df: DataFrame, h=10, pt_mult=1.0, sl_mult=1.0, keys=(KEY,),
                   uniqueness=True) -> DataFrame:
    """L1 + L4. ``df``: keys, date, close, s, sigma; one row per bar.

    Entry is the bar after the signal; the barrier path is the next h bars after
    entry, held as an array of at most h+1 structs. Uniqueness uses the same
    sort: the bars' concurrency counts events through a trailing array of end
    positions, and the mean of 1/concurrency is a difference of prefix sums.
    """
    w = Window.partitionBy(*keys).orderBy(ORDER)
    ahead = w.rowsBetween(1, h + 1)
    df = df.withColumns({"pos": F.row_number().over(w), "lc": F.ln(positive("close"))})
    path = F.collect_list(F.struct(ORDER, "lc")).over(ahead)
    live = (F.coalesce(F.col("s"), F.lit(0)) != 0) & (F.col("sigma") > 0)
    df = df.withColumn("path", F.when(live, path))
    df = df.withColumn("path", F.when(F.size("path") == h + 1, F.col("path")))
    side = F.signum(F.col("s").cast("double"))
    dist = F.transform("path", lambda p: F.round((p["lc"] - F.col("path")[0]["lc"]) * side, 12))
    df = df.withColumn("dist", dist)
    # barrier multiples may be columns, one configuration per row
    pt, sl = (m if hasattr(m, "alias") else F.lit(m) for m in (pt_mult, sl_mult))
    up, dn = (F.round(m * F.col("sigma") * math.sqrt(h), 12) for m in (pt, sl))
    touch = F.filter(F.sequence(F.lit(1), F.lit(h)),
                     lambda i: (F.col("dist")[i] >= up) | (F.col("dist")[i] <= -dn))
    df = df.withColumn("off", F.when(F.col("path").isNotNull(),
                                     F.coalesce(F.get(touch, F.lit(0)), F.lit(h))))
    df = df.withColumns({
        "t_start": F.col("path")[0][ORDER], "t_end": F.col("path")[F.col("off")][ORDER],
        "ret": F.col("dist")[F.col("off")], "side": side.cast("int"),
        "end_pos": F.col("pos") + 1 + F.col("off")})
    cols = [*keys, F.col(ORDER).alias("t_signal"), "t_start", "t_end", "side", "ret",
            (F.col("ret") > 0).cast("int").alias("label"), "sigma"]
    if uniqueness:
        # events covering bar u were signalled on bars u-1-h .. u-1 and end at u or later
        back = w.rowsBetween(-(h + 1), -1)
        ends = F.collect_list("end_pos").over(back)
        df = df.withColumn("conc", F.size(F.filter(ends, lambda e: e >= F.col("pos"))))
        inv = F.when(F.col("conc") > 0, 1.0 / F.col("conc")).otherwise(0.0)
        df = df.withColumn("cum", F.sum(inv).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        df = df.withColumn("cums", F.collect_list("cum").over(ahead))
        df = df.withColumn("uniqueness_weight", (F.col("cums")[F.col("off")] - F.col("cum"))
                           / (F.col("off") + 1))
        cols.insert(-1, "uniqueness_weight")
    return df.filter("off IS NOT NULL").select(*cols)


def barrier_sweep(df: DataFrame, configs) -> DataFrame:
    """Every (pt, sl) configuration at once; the grid is exploded per bar."""
    grid = F.array(*[F.struct(F.lit(i).alias("cfg"), F.lit(p).alias("pt"), F.lit(s).alias("sl"))
                     for i, (p, s) in enumerate(configs)])
    x = df.withColumn("g", F.explode(grid)).select("*", "g.cfg", "g.pt", "g.sl")
    ev = triple_barrier(x, pt_mult=F.col("pt"), sl_mult=F.col("sl"), keys=(KEY, "cfg"),
                        uniqueness=False)
    return ev.groupBy("cfg").agg(
        F.count("*").alias("n_events"), F.avg("label").alias("label_share"),
        F.avg("ret").alias("mean_ret"),
        F.avg(F.datediff("t_end", "t_start")).alias("mean_days"))


def cusum_events(bars: DataFrame, x: str, h: float, key=KEY, order="bar_ts") -> DataFrame:
    """Symmetric CUSUM filter, reset on breach.

    The reset makes the recursion non-associative, so this is a keyed state
    machine. It runs on bars: unique (key, time unit), hence at most one row per
    hour of history in a group. The streaming twin keeps the state instead.
    """
    diffs = bars.select(key, order, (F.col(x) - F.lag(x).over(
        Window.partitionBy(key).orderBy(order))).alias("d")).filter("d IS NOT NULL")

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        pos = neg = 0.0
        hit = []
        for d in pdf["d"].to_numpy():
            pos, neg = max(0.0, pos + d), min(0.0, neg + d)
            side = -1 if neg < -h else (1 if pos > h else 0)
            if side < 0:
                neg = 0.0
            elif side > 0:
                pos = 0.0
            hit.append(side)
        pdf["side"] = hit
        return pdf.loc[pdf["side"] != 0, [key, order, "side"]]

    t = dict(diffs.dtypes)
    return diffs.groupBy(key).applyInPandas(scan, f"{key} {t[key]}, {order} {t[order]}, side int")


def day_target(bars: DataFrame, span=100, time="bar_ts", price="close") -> DataFrame:
    """EWM sd (adjust=True) of the return against the bar over a day earlier."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(KEY).orderBy("us")
    df = bars.withColumn("us", us)
    day = 86_400_000_000
    old = w.rangeBetween(Window.unboundedPreceding, -day - 1)
    df = df.withColumn("ret", F.try_divide(F.col(price), F.last(price).over(old)) - 1.0)
    return ewm_std(df, "ret", "trgt", span, adjust=True, order=time).drop("us")


def generic_barriers(df: DataFrame, pt: float, sl: float, num_days=1, min_ret=0.0,
                     time="bar_ts", price="close", zero_vertical=False) -> DataFrame:
    """Events (rows with side and target) against pt/sl/vertical barriers.

    ``df`` holds every bar; rows with ``trgt`` and ``side`` set are events. A
    factor of 0 disables that barrier. The path is a range frame of num_days,
    plus the first bar at or after the vertical barrier.
    """
    day = 86_400_000_000 * num_days
    df = df.withColumn("us", F.unix_micros(F.col(time).cast("timestamp")))
    w = Window.partitionBy(KEY).orderBy("us")
    inside = w.rangeBetween(0, day - 1)
    # newest first, so "first bar at or after t + days" is a running scan
    after = Window.partitionBy(KEY).orderBy(-F.col("us")).rangeBetween(
        Window.unboundedPreceding, -day)
    df = df.withColumns({
        "p_in": F.collect_list(F.struct(F.col(time).alias("t"), F.col(price).alias("px"))).over(inside),
        "v_t": F.last(time).over(after), "v_px": F.last(price).over(after)})
    ev = df.filter(F.col("side").isNotNull() & (F.col("trgt") > min_ret))
    v = F.struct(F.col("v_t").alias("t"), F.col("v_px").alias("px"))
    ev = ev.withColumn("p_all", F.when(F.col("v_t").isNotNull(), F.array_append("p_in", v))
                       .otherwise(F.col("p_in")))

    def first_touch(cond):
        return F.get(F.filter("p_all", cond), F.lit(0))

    def gain(p):
        return F.round((p["px"] / F.col(price) - 1.0) * F.col("side"), 12)

    none = F.lit(None).cast(ev.select("v_t").schema[0].dataType)
    up = first_touch(lambda p: gain(p) > F.round(pt * F.col("trgt"), 12))["t"] if pt > 0 else none
    dn = first_touch(lambda p: gain(p) < F.round(-sl * F.col("trgt"), 12))["t"] if sl > 0 else none
    ev = ev.withColumns({"t_pt": up, "t_sl": dn})
    ev = ev.withColumn("t1", F.least("t_pt", "t_sl", "v_t"))
    end = F.filter("p_all", lambda p: p["t"] == F.col("t1"))
    ev = ev.withColumn("ret", (F.get(end, F.lit(0))["px"] / F.col(price) - 1.0) * F.col("side"))
    vertical = (F.col("t1") == F.col("v_t")) & F.col("t_pt").isNull() & F.col("t_sl").isNull()
    sign = F.signum(F.round("ret", 12)).cast("int")
    if zero_vertical:
        sign = F.when(vertical, 0).otherwise(sign)
    return ev.filter("t1 IS NOT NULL").select(
        KEY, F.col(time).alias("t0"), "t1", "side", "trgt", "ret", sign.alias("bin"),
        F.when(F.round("ret", 12) > 0, 1).otherwise(0).alias("meta_bin"),
        vertical.alias("vertical"))


def trend_scan(bars: DataFrame, a=5, b=20, forward=True, price="close") -> DataFrame:
    """The horizon in [a, b) with the largest |slope t-value|, first on ties.

    Running sums over one window of b rows, centred on its own first price, give the fits
    of all its horizons. An exact straight line has an unbounded t-value, which the final
    clip turns into +-20; a flat line has none.
    """
    w = ordered()
    rows = w.rowsBetween(0, b - 1) if forward else w.rowsBetween(-b, 0)
    seen = F.collect_list(F.struct(F.col(ORDER).alias("d"), F.col(price).cast("double").alias("y"))).over(rows)
    pos, n_all = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy(KEY))
    df = bars.withColumns({"arr": seen if forward else F.reverse(seen),
                           "ok": pos <= n_all - b if forward else pos >= b}).filter("ok")
    zero = F.struct(F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2"), F.lit(0.0).alias("s3"), F.lit(0).alias("j"),
                    F.array().cast("array<struct<s1:double,s2:double,s3:double>>").alias("out"))

    def step(acc, e):
        v = e["y"] - F.get("arr", F.lit(0))["y"]
        s1, s2, s3 = acc["s1"] + v, acc["s2"] + acc["j"] * v, acc["s3"] + v * v
        return F.struct(s1.alias("s1"), s2.alias("s2"), s3.alias("s3"), (acc["j"] + 1).alias("j"),
                        F.array_append(acc["out"], F.struct(s1.alias("s1"), s2.alias("s2"), s3.alias("s3"))).alias("out"))

    # at most b entries, so appending stays cheap
    sums = F.aggregate(F.slice("arr", 1, b), zero, step, lambda acc: acc["out"])

    def fit(e, h):
        m = (h + 1).cast("double")
        sxx = m * (m * m - 1.0) / 12.0
        sxy = (e["s2"] - h / 2.0 * e["s1"]) * (1.0 if forward else -1.0)
        syy = e["s3"] - e["s1"] * e["s1"] / m
        return let(F.struct(sxx.alias("sxx"), sxy.alias("sxy"), syy.alias("syy"), (syy - sxy * sxy / sxx).alias("sse")),
                   lambda f: F.when(e["s3"] > 0, F.when(f["sse"] <= 1e-12 * f["syy"], F.signum(f["sxy"]) * F.lit(float("inf")))
                                    .otherwise(f["sxy"] / f["sxx"] / F.sqrt(f["sse"] / (m - 2.0) / f["sxx"]))))

    def scored(all_sums):
        return F.transform(F.sequence(F.lit(a), F.lit(b - 1)), lambda h: let(fit(F.get(all_sums, h), h), lambda t: F.struct(
            F.abs(t).alias("at"), (-h).alias("nh"), t.alias("t"), F.get("arr", h)["d"].alias("t1"))))

    best = F.array_max(F.filter(let(sums, scored), lambda s: s["at"].isNotNull()))
    df = df.withColumn("best", best)
    t = F.col("best.t")
    return df.filter(t.isNotNull()).select(
        KEY, ORDER, F.col("best.t1").alias("t1"),
        F.greatest(F.least(t, F.lit(20.0)), F.lit(-20.0)).alias("t_val"),
        F.signum(t).cast("int").alias("bin"), (-F.col("best.nh")).alias("window_size"))


def events_meta(events: DataFrame) -> DataFrame:
    """Counts per instrument."""
    return events.groupBy(KEY).agg(
        F.count("*").alias("n_events"), F.count_if(F.col("side") > 0).alias("n_long"),
        F.count_if(F.col("side") < 0).alias("n_short"),
        F.count_if(F.col("label") == 1).alias("n_label_1"),
        F.count_if(F.col("label") == 0).alias("n_label_0"))
