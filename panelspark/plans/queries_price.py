"""Price, volatility, momentum, volume and calendar feature families."""

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..functions.windows import percentile_rank, zscore
from ..operators import price as P
from ..sources.store import panel
from .registry import query
from .sqltext import KEY, PANEL, ewm_sql, lag, over, pos, r, rs, sd, sma, strict

RET = f"""rets AS (SELECT * FROM (SELECT *, ln(close) - lag(ln(close)) OVER ({KEY}) AS ret
  FROM panel) WHERE ret IS NOT NULL)"""


@query("native_returns", "E1 A4", f"""WITH {PANEL}, {RET}
SELECT instrument, date, {r('ret', 9)} FROM rets""", causal=True)
def native_returns(spark, sf):
    return rounded(P.native_returns(panel(spark, sf)), 9)


@query("simple_returns", "E1", f"""WITH {PANEL}
SELECT instrument, date, {r('ret', 9)} FROM (
  SELECT instrument, date, close / lag(close) OVER ({KEY}) - 1 AS ret FROM panel)
WHERE ret IS NOT NULL""", causal=True)
def simple_returns(spark, sf):
    return rounded(P.native_returns(panel(spark, sf), "simple"), 9)


@query("rolling_vol_panel", "E2", f"""WITH {PANEL}, {RET}
SELECT instrument, date, {r('ret')}, {r(sd('ret', 20) + ' * sqrt(252.0)', 6, 'rolling_vol')},
  {r(sma('ret', 20), 6, 'rolling_mean')} FROM rets""", causal=True)
def rolling_vol_panel(spark, sf):
    return rounded(P.rolling_stats(P.native_returns(panel(spark, sf))))


@query("trailing_zscore", "E4", f"""WITH {PANEL}
SELECT instrument, date, {r(f"(close - {sma('close', 20)}) / {pos(sd('close', 20))}", 6, 'z')}
FROM panel""", causal=True)
def trailing_zscore(spark, sf):
    return rounded(panel(spark, sf).select("instrument", "date", zscore("close", 20).alias("z")))


@query("trailing_percentile", "E5", f"""WITH {PANEL}, l AS (
  SELECT instrument, date, close, count(close) OVER {over(60)} AS n,
    list(close) OVER {over(60)} AS v FROM panel)
SELECT instrument, date, CASE WHEN n = 60 THEN
  {r('len(list_filter(v, lambda x: x <= close)) / 60.0', 6, 'x')[:-5]} END AS pct_rank FROM l""", causal=True)
def trailing_percentile(spark, sf):
    return rounded(panel(spark, sf).select("instrument", "date",
                                           percentile_rank("close", 60).alias("pct_rank")))


def f1_sql():
    gaps = ", ".join(f"close - {sma('close', n)} AS gap{n}" for n in (10, 20, 40))
    cols = []
    for n in (10, 20, 40):
        g = f"gap{n}"
        cols += [r(f"-({g} - {sma(g, n)}) / {pos(sd(g, n))}", 6, f"f1_mr_score_{n}"),
                 r(f"{g} / {pos(sd(g, n))}", 6, f"f1_dist_ma_sigma_{n}"),
                 r(f"-(ln(close) - {lag('ln(close)', n)})", 6, f"f1_ret_reversal_{n}"),
                 r(f"(close - {strict('min', 'close', n)}) / "
                   f"{pos('(' + strict('max', 'close', n) + ') - (' + strict('min', 'close', n) + ')')}",
                   6, f"f1_hilo_pos_{n}")]
    s20, d20 = sma("close", 20), sd("close", 20)
    cols.append(r(f"(close - ({s20} - 2 * {d20})) / {pos('4 * ' + d20)}", 6, "f1_bb_pctb_20"))
    cols.append(r(f"{pos('4 * ' + d20)} / {s20}", 6, "f1_bb_bandwidth_20"))
    ew = ewm_sql("ew", "moves", [("au", "up", 1 / 14, 14), ("al", "dn", 1 / 14, 14)])
    return f"""WITH RECURSIVE {PANEL},
g AS (SELECT *, {gaps} FROM panel),
moves AS (SELECT instrument, date, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS up,
  CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS dn
  FROM (SELECT instrument, date, close - {lag('close')} AS d FROM panel)), {ew},
f AS (SELECT instrument, date, {', '.join(cols)} FROM g)
SELECT f.*, round(CASE WHEN al = 0 AND au > 0 THEN 100.0
  ELSE 100 - 100 / (1 + au / CASE WHEN al > 0 THEN al END) END, 6) + 0.0 AS f1_rsi_14
FROM f JOIN ew USING (instrument, date)"""


@query("f1_counter_trend", "F1a F1b F1c F1d F1e F1f", f1_sql(), causal=True)
def f1_counter_trend(spark, sf):
    return rounded(P.counter_trend(panel(spark, sf)))


TR = f"""CASE WHEN {lag('close')} IS NULL THEN high - low ELSE greatest(high - low,
  abs(high - {lag('close')}), abs(low - {lag('close')})) END"""


def moments_sql(x, n):
    """Bias-corrected skewness and excess kurtosis from raw central sums."""
    return (f"CASE WHEN count({x}) OVER {over(n)} = {n} THEN skewness({x}) OVER {over(n)} END",
            f"CASE WHEN count({x}) OVER {over(n)} = {n} THEN kurtosis({x}) OVER {over(n)} END")


def f2_sql():
    sk, ku = moments_sql("ret", 60)
    vr = "(CASE WHEN {0} < 0 THEN 0 ELSE {0} END)"
    return f"""WITH RECURSIVE {PANEL},
b AS (SELECT *, ln(close) - {lag('ln(close)')} AS ret, ln(high / low) ** 2 AS hl2,
  ln(close / open) ** 2 AS co2, ln(high/close)*ln(high/open) + ln(low/close)*ln(low/open) AS rsb,
  {TR} AS tr FROM panel),
v AS (SELECT *, {sd('ret', 10)} * sqrt(252.0) AS f2_vol_10, {sd('ret', 20)} * sqrt(252.0) AS f2_vol_20,
  {sd('ret', 60)} * sqrt(252.0) AS f2_vol_60, 0.5 * hl2 - (2 * ln(2) - 1) * co2 AS gk,
  {sk} AS f2_ret_skew_60, {ku} AS f2_ret_kurt_60 FROM b),
l AS (SELECT *, list(f2_vol_20) OVER {over(252)} AS vs, count(f2_vol_20) OVER {over(252)} AS nv,
  {sma('gk', 20)} AS mgk, {sma('rsb', 20)} AS mrs, {sma('hl2', 20)} AS mhl,
  {sd('f2_vol_20', 60)} AS vov FROM v),
{ewm_sql('ew', 'b', [('atr', 'tr', 1 / 14, 14)])}
SELECT instrument, date, {rs('f2_vol_10 f2_vol_20 f2_vol_60 f2_ret_skew_60 f2_ret_kurt_60')},
  {r('f2_vol_20 / CASE WHEN f2_vol_60 > 0 THEN f2_vol_60 END', 6, 'f2_vol_ratio_20_60')},
  CASE WHEN nv = 252 THEN round(len(list_filter(vs, lambda x: x <= f2_vol_20)) / 252.0, 6) + 0.0
    END AS f2_vol_pctile_20,
  {r('vov', 6, 'f2_vol_of_vol_20')},
  {r('sqrt(mhl / (4 * ln(2)) * 252)', 6, 'f2_parkinson_20')},
  {r(f"sqrt({vr.format('mgk')} * 252)", 6, 'f2_garman_klass_20')},
  {r(f"sqrt({vr.format('mrs')}) * sqrt(252.0)", 6, 'f2_rogers_satchell_20')},
  {r("atr", 4, "f2_atr_14")}
FROM l JOIN ew USING (instrument, date)"""


@query("f2_volatility", "F2a F2b F2c F2d F2e F2f F2g F2h", f2_sql(), causal=True)
def f2_volatility(spark, sf):
    return rounded(P.volatility(panel(spark, sf)), special={"f2_atr_14": 4})


def f6_sql():
    mom = ", ".join(r(f"(lc - {lag('lc', n)}) / {pos('(' + strict('stddev_samp', 'ret', n) + f') * sqrt({n}.0)')}",
                      6, f"f6_ts_momentum_{n}") for n in (20, 60))
    prior = f"({KEY} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
    return f"""WITH RECURSIVE {PANEL},
b0 AS (SELECT *, ln(close) AS lc, high - {lag('high')} AS up, {lag('low')} - low AS dn, {TR} AS tr
  FROM panel),
b AS (SELECT *, lc - {lag('lc')} AS ret, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm,
  CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm FROM b0),
{ewm_sql('ew', 'b', [('e12', 'close', 2 / 13, 12), ('e26', 'close', 2 / 27, 26), ('atr', 'tr', 1 / 14, 14),
                     ('pe', 'pdm', 1 / 14, 14), ('me', 'mdm', 1 / 14, 14)])},
d AS (SELECT instrument, date, e12 - e26 AS macd,
  100 * pe / CASE WHEN atr > 0 THEN atr END AS pdi, 100 * me / CASE WHEN atr > 0 THEN atr END AS mdi FROM ew),
d2 AS (SELECT *, 100 * abs(pdi - mdi) / CASE WHEN pdi + mdi > 0 THEN pdi + mdi END AS dx FROM d),
{ewm_sql('ew2', 'd2', [('sig', 'macd', 0.2, 9), ('adx', 'dx', 1 / 14, 14)])},
f AS (SELECT instrument, date, {mom},
  {r(f"({sma('close', 20)} - {sma('close', 60)}) / {sma('close', 60)}", 6, 'f6_ma_cross_20_60')},
  CASE WHEN count(close) OVER {prior} = 20 THEN max(close) OVER {prior} END AS hi,
  CASE WHEN count(close) OVER {prior} = 20 THEN min(close) OVER {prior} END AS lo, close FROM b)
SELECT f.* EXCLUDE (hi, lo, close),
  {r('2 * (close - lo) / CASE WHEN hi > lo THEN hi - lo END - 1', 6, 'f6_donchian_pos_20')},
  {r("macd", 2, "f6_macd_12_26")}, {r("macd - sig", 2, "f6_macd_hist_12_26_9")},
  {r('adx', 5, 'f6_adx_14')}
FROM f JOIN d2 USING (instrument, date) JOIN ew2 USING (instrument, date)"""


@query("f6_momentum", "F6a F6b F6c F6d F6e", f6_sql(), causal=True)
def f6_momentum(spark, sf):
    return rounded(P.momentum(panel(spark, sf)), special={
        "f6_macd_12_26": 2, "f6_macd_hist_12_26_9": 2, "f6_adx_14": 5})


def f7_sql():
    z = lambda x: r(f"({x} - {sma(x, 20)}) / {pos(sd(x, 20))}", 6, "zz")[:-6]
    return f"""WITH {PANEL},
b0 AS (SELECT *, ln(close) - {lag('ln(close)')} AS ret, close - {lag('close')} AS dp,
  {lag('close')} AS pc, CASE WHEN volume > 0 THEN volume END AS v,
  open_interest - {lag('open_interest', 20)} AS doi, close - {lag('close', 20)} AS dc,
  open_interest - {lag('open_interest')} AS f7_oi_change FROM panel),
b AS (SELECT *, {lag('dp')} AS dpl, abs(ret) / v AS am, abs(ret) / sqrt(v) AS ky FROM b0),
c AS (SELECT *, dp * dpl AS pp FROM b),
d AS (SELECT *, -(({sma('pp', 20)}) - ({sma('dp', 20)}) * ({sma('dpl', 20)})) AS ncov FROM c)
SELECT instrument, date, {z('volume')}f7_volume_z_20,
  {r(f"volume / {pos(sma('volume', 20))} - 1", 6, 'f7_volume_trend_20')},
  {r('open_interest', 6, 'f7_oi_level')}, {r('f7_oi_change')}, {z('open_interest')}f7_oi_z_20,
  {r('sign(doi) * sign(dc)', 6, 'f7_oi_price_div_20')},
  {r(f'avg(am) OVER {over(20)}', 6, 'f7_amihud_20')}, {r(sma('am', 20), 6, 'amihud_illiquidity')},
  {r('2 * sqrt(CASE WHEN ncov < 0 THEN 0 ELSE ncov END)', 3, 'f7_rolls_spread_20')},
  {r(sma('ky', 20), 6, 'f7_kyles_lambda_20')}, {r('ln(open / pc)', 6, 'f7_overnight_gap')}
FROM d"""


@query("f7_microstructure", "F7a F7b F7c F7d F7e F7f F7g F7h", f7_sql(), causal=True)
def f7_microstructure(spark, sf):
    return rounded(P.microstructure(panel(spark, sf)), special={"f7_rolls_spread_20": 3})


@query("f8_calendar", "F8", f"""WITH {PANEL}
SELECT instrument, date, {r('sin(2*pi()*(isodow(date)-1)/7)', 6, 'f8_dow_sin')},
  {r('cos(2*pi()*(isodow(date)-1)/7)', 6, 'f8_dow_cos')},
  {r('sin(2*pi()*(month(date)-1)/12)', 6, 'f8_month_sin')},
  {r('cos(2*pi()*(month(date)-1)/12)', 6, 'f8_month_cos')} FROM panel""", causal=True)
def f8_calendar(spark, sf):
    return rounded(P.calendar_cycle(panel(spark, sf)))


@query("f10_price_action", "F10", f"""WITH {PANEL}, b AS (
  SELECT *, ln(high / low) AS f10_hl_range, ln(open / {lag('open')}) AS f10_oto_ret FROM panel)
SELECT instrument, date, {rs('f10_hl_range f10_oto_ret')},
  {r(sma('f10_hl_range', 20), 6, 'f10_hl_range_mean_20')},
  {r(sma('f10_oto_ret', 20), 6, 'f10_oto_ret_mean_20')} FROM b""", causal=True)
def f10_price_action(spark, sf):
    return rounded(P.price_action(panel(spark, sf)))


def f12_sql():
    tv = []
    for n in (10, 21, 42):
        w = over(n)
        tv.append(f"CASE WHEN count(lc) OVER {w} = {n} THEN corr(lc, rn) OVER {w} END AS rho{n}")
    out = ", ".join(r(f"rho{n} * sqrt({n - 2}.0) / sqrt(CASE WHEN 1 - rho{n}*rho{n} > 0 "
                      f"THEN 1 - rho{n}*rho{n} END)", 6, f"f12_trend_tval_{n}") for n in (10, 21, 42))
    w20, w21, w17 = over(20), over(21), over(17)
    return f"""WITH {PANEL},
b0 AS (SELECT *, ln(close) AS lc, CAST(row_number() OVER ({KEY}) AS DOUBLE) AS rn,
  {sma('close', 21)} AS ma FROM panel),
b AS (SELECT *, lc - {lag('lc')} AS ret, {lag('ma')} AS mal FROM b0),
c AS (SELECT *, {lag('ret')} AS rl, abs(ret) AS ar, {strict('sum', 'ret', 5)} AS s5 FROM b),
d AS (SELECT *, count(ret) OVER {w21} = 21 AS full21, {', '.join(tv)} FROM c)
SELECT instrument, date,
  {r(f'CASE WHEN full21 THEN corr(ret, rl) OVER {w20} END', 6, 'f12_autocorr_21')},
  {r(f"abs({strict('sum', 'ret', 21)}) / ({strict('sum', 'ar', 21)})", 6, 'f12_efficiency_ratio_21')},
  {r(f"CASE WHEN full21 THEN var_samp(s5) OVER {w17} END / (5 * ({strict('var_samp', 'ret', 21)}))", 6,
     'f12_variance_ratio_5_21')},
  {r(f"ln(ma / mal) / {pos(sd('ret', 21))}", 6, 'f12_ma21_slope')}, {out}
FROM d"""


@query("f12_path_structure", "F12a F12b F12c F12d F12f", f12_sql(), causal=True)
def f12_path_structure(spark, sf):
    return rounded(P.path_structure(panel(spark, sf)))


Z_IN = ("f10_hl_range", "f10_hl_range_mean_20", "f10_oto_ret", "f10_oto_ret_mean_20")


def z_sql():
    w = f"({KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    zs = ", ".join(r(f"CASE WHEN count({x}) OVER {w} >= 60 THEN ({x} - avg({x}) OVER {w}) / "
                     f"{pos(f'stddev_samp({x}) OVER {w}')} END", 6, f"z_{x}") for x in Z_IN)
    return f"""WITH {PANEL}, b AS (
  SELECT *, ln(high / low) AS f10_hl_range, ln(open / {lag('open')}) AS f10_oto_ret FROM panel),
c AS (SELECT instrument, date, f10_hl_range, f10_oto_ret, {sma('f10_hl_range', 20)} AS f10_hl_range_mean_20,
  {sma('f10_oto_ret', 20)} AS f10_oto_ret_mean_20 FROM b)
SELECT instrument, date, {rs(' '.join(Z_IN))}, {zs} FROM c"""


@query("z_twins", "E6 B12", z_sql(), causal=True)
def z_twins(spark, sf):
    return rounded(P.z_twins(P.price_action(panel(spark, sf))))
