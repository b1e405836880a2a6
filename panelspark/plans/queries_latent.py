"""Latent components, clusters, drift and roll suspicion."""

from pyspark.sql import functions as F

from ..functions import calendars as C
from ..functions.numeric import rounded
from ..operators import latent as T, price as P, quality as Q
from ..sources.store import panel
from .queries_quality import CAL, MISS, base
from .queries_stats import BLK, block
from .registry import query
from .sqltext import KEY, PANEL, lag, pos, r, sd, sma

COLS = ("ret", "hl", "oto", "lv", "mom5", "sd10")
TRAIN_END = "2000-01-01"
ROUNDS = 4


def end():
    return F.lit(TRAIN_END).cast("date")


def latent_rows(spark, sf):
    p = panel(spark, sf).select("instrument", "asset_class", "date", "s")
    df = block(spark, sf).join(p, ["instrument", "date"]).filter("s <> 0")
    return df, df.filter(F.col("date") <= end())


@query("f4_latent_components", "K6 K8")
def f4_latent_components(spark, sf):
    return rounded(T.latent_components(*latent_rows(spark, sf), COLS), 5)


@query("latent_reconstruction_mse", "K8")
def latent_reconstruction_mse(spark, sf):
    scored = T.latent_components(*latent_rows(spark, sf), COLS)
    return rounded(T.reconstruction_mse(scored, end()))


LAT = f"""{BLK}, lt AS (SELECT b.*, p.asset_class FROM blk b JOIN panel p USING (instrument, date) WHERE p.s <> 0),
md AS (SELECT asset_class, {', '.join(f'coalesce(quantile_cont({c}, 0.5), 0) AS {c}_med' for c in COLS)} FROM lt WHERE date <= DATE '{TRAIN_END}' GROUP BY 1),
fi AS MATERIALIZED (SELECT instrument, asset_class, date, {', '.join(f'coalesce({c}, {c}_med) AS {c}' for c in COLS)} FROM lt JOIN md USING (asset_class)),
sx AS (SELECT asset_class, {', '.join(f'avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS {c}_s' for c in COLS)}
  FROM fi WHERE date <= DATE '{TRAIN_END}' GROUP BY 1),
zz AS MATERIALIZED (SELECT instrument, asset_class, date, {', '.join(f'({c} - {c}_m) / {c}_s AS z{i}' for i, c in enumerate(COLS))} FROM fi JOIN sx USING (asset_class))"""


@query("train_medians", "D36", f"""WITH {PANEL}, {LAT}
SELECT asset_class, {', '.join(r(f'{c}_med') for c in COLS)} FROM md""")
def train_medians(spark, sf):
    return rounded(T.medians(latent_rows(spark, sf)[1], COLS))


def lloyd_sql():
    avg = ", ".join(f"avg(z{i}) AS c{i}" for i in range(6))
    dist = " + ".join(f"(z.z{i} - c.c{i})**2" for i in range(6))
    out = [f"zt AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM zz WHERE date <= DATE '{TRAIN_END}')",
           "cu AS (SELECT asset_class, [quantile_cont(z0, 0.25), quantile_cont(z0, 0.5), quantile_cont(z0, 0.75)] AS cuts FROM zt GROUP BY 1)",
           f"c0 AS MATERIALIZED (SELECT asset_class, i, {avg} FROM (SELECT zt.*, len(list_filter(cuts, lambda c: c < z0)) AS i FROM zt JOIN cu USING (asset_class)) GROUP BY 1, 2)"]
    for k in range(1, ROUNDS + 1):
        out.append(f"n{k} AS (SELECT z.id, z.asset_class, arg_min(c.i, row({dist}, c.i)) AS i FROM zt z JOIN c{k - 1} c USING (asset_class) GROUP BY 1, 2)")
        out.append(f"c{k} AS MATERIALIZED (SELECT zt.asset_class, n{k}.i, {avg} FROM zt JOIN n{k} USING (id) GROUP BY 1, 2)")
    return ", ".join(out), dist


LL, DIST = lloyd_sql()


@query("f4_clusters", "K7", f"""WITH {PANEL}, {LAT}, {LL}
SELECT z.instrument, z.date, CAST(arg_min(c.i, row({DIST}, c.i)) AS INTEGER) AS f4_cluster_id, {r(f'sqrt(min({DIST}))', 5, 'f4_cluster_dist')}
FROM zz z JOIN c{ROUNDS} c USING (asset_class) GROUP BY 1, 2""")
def f4_clusters(spark, sf):
    return rounded(T.cluster_ids(*latent_rows(spark, sf), COLS, rounds=ROUNDS), 5)


DR = ("hl", "lv", "absr", "sd10")


def drift_sql():
    full = " AND ".join(f"{c} IS NOT NULL" for c in DR)
    mom = lambda t: ", ".join(f"avg({c}) AS {t}_{c}_m, var_pop({c}) AS {t}_{c}_v" for c in DR)
    nt = "least(t_n, 5 * r_n)"
    logit = f"ln(r_n / {nt})" + "".join(
        f" + ({c} - (t_{c}_m + r_{c}_m) / 2) * (r_{c}_m - t_{c}_m) / ((t_{c}_v * {nt} + r_{c}_v * r_n) / ({nt} + r_n) + 1e-12)" for c in DR)
    return f"""WITH {PANEL}, {BLK}, ps AS (SELECT *, row_number() OVER ({KEY}) - 1 AS pos, ({full}) AS ok,
  count(*) FILTER (date <= DATE '{TRAIN_END}') OVER (PARTITION BY instrument) AS cut, count(*) OVER (PARTITION BY instrument) AS n FROM blk),
tn AS (SELECT instrument, count(*) AS t_n, {mom('t')} FROM ps WHERE pos < cut AND ok GROUP BY 1 HAVING count(*) >= 20),
rf AS (SELECT DISTINCT instrument, cut + 63 + 21 * g AS rp, g FROM (SELECT DISTINCT instrument, cut, n, unnest(generate_series(0, greatest(n - cut, 0) // 21)) AS g FROM ps) WHERE cut + 63 + 21 * g < n),
rc AS (SELECT p.instrument, g, count(*) AS r_n, {mom('r')} FROM rf JOIN ps p ON p.instrument = rf.instrument AND p.pos >= rp - 63 AND p.pos < rp AND ok GROUP BY 1, 2 HAVING count(*) >= 20),
sc AS (SELECT p.instrument, p.date, 1 / (1 + exp(-({logit}))) AS v FROM ps p JOIN tn USING (instrument)
  JOIN rc ON rc.instrument = p.instrument AND rc.g = (p.pos - p.cut - 63) // 21 WHERE p.pos >= p.cut + 63 AND ok)
SELECT ps.instrument, ps.date, {r('v', 5, 'f16_regime_alignment_score')} FROM ps LEFT JOIN sc USING (instrument, date)"""


@query("f16_drift_score", "K13", drift_sql())
def f16_drift_score(spark, sf):
    return rounded(T.drift_score(block(spark, sf), DR, end()), 5)


@query("roll_gap_suspicion", "E7", f"""WITH {PANEL}, {CAL}, {MISS}, sr AS (SELECT instrument, date, close / {lag('close')} - 1 AS ret FROM cleanp),
zs AS (SELECT instrument, date, (ret - {sma('ret', 20)}) / {pos(sd('ret', 20))} AS z, lead(date) OVER ({KEY}) AS nd FROM sr WHERE ret IS NOT NULL)
SELECT z.instrument, z.date, {r('z')}, count(*) AS n_missing FROM zs z JOIN miss m ON m.instrument = z.instrument AND m.date > z.date AND m.date < z.nd
WHERE abs(z.z) > 2 GROUP BY z.instrument, z.date, z.z""")
def roll_gap_suspicion(spark, sf):
    clean, cal, dim = base(spark, sf)
    miss = Q.missing_sessions(clean, dim, C.expected_sessions(clean, cal), cal)
    return rounded(P.gap_suspicion(P.native_returns(clean, "simple"), miss))
