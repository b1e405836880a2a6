"""Whole-window families."""

import math

from ..functions.numeric import rounded
from ..operators import risk as K
from ..sources.store import panel
from .registry import query
from .sqltext import KEY, PANEL, lag, over, r, sma, strict

RR = f"rr AS (SELECT *, ln(close) - {lag('ln(close)')} AS ret FROM panel)"


def hurst_sql(n=100):
    sizes = K.chunk_sizes(n)
    w = over(n)
    return f"""WITH {PANEL}, {RR}, cu AS (SELECT *, coalesce(sum(ret) OVER ({KEY}), 0) AS c FROM rr),
a AS (SELECT instrument, date, CASE WHEN count(ret) OVER {w} = {n} THEN list(ret) OVER {w} END AS arr,
  list(c) OVER ({KEY} ROWS BETWEEN {n} PRECEDING AND CURRENT ROW) AS cs FROM cu),
seg AS (SELECT instrument, date, s, arr[k*s+1 : k*s+s] AS g, cs[k*s+1 : k*s+s+1] AS h FROM a,
  (VALUES {', '.join(f'({s}, {k})' for s in sizes for k in range(n // s))}) v(s, k) WHERE arr IS NOT NULL),
cm AS (SELECT instrument, date, s, list_stddev_samp(g) AS sdv, (h[s + 1] - h[1]) / s AS mu, h FROM seg),
z AS (SELECT instrument, date, s, sdv, list_transform(generate_series(1, s), lambda i: h[i + 1] - h[1] - i * mu) AS z FROM cm),
rsv AS (SELECT instrument, date, s, avg((list_max(z) - list_min(z)) / sdv) AS m FROM z WHERE sdv > 1e-12 GROUP BY 1, 2, 3),
fit AS (SELECT instrument, date, regr_slope(ln(m), ln(s)) AS hh FROM rsv GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT a.instrument, a.date, {r('hh', 5, 'f12_hurst_100')} FROM a LEFT JOIN fit USING (instrument, date)"""


@query("f12_hurst", "F12e", hurst_sql(), causal=True)
def f12_hurst(spark, sf):
    return rounded(K.hurst(panel(spark, sf)), 5)


def wavelet_sql(n=252):
    lo, hi = ("[" + ", ".join(repr(v) for v in f) + "]" for f in (K.DB4_LOW, K.DB4_HIGH))
    ctes, prev, m = [], "a0", n
    for lev in range(1, 6):
        pad = m % 2
        mp = m + pad
        x = f"list_append(lo, lo[{m}])" if pad else "lo"

        def conv(f):
            taps = " + ".join(f"{v!r} * x[(4 + 2*o - {j} + {2 * mp}) % {mp} + 1]" for j, v in enumerate(f))
            return f"list_transform(generate_series(0, {mp // 2 - 1}), lambda o: {taps})"
        ctes.append(f"p{lev} AS (SELECT * EXCLUDE (lo), {x} AS x FROM {prev})")
        ctes.append(f"a{lev} AS (SELECT * EXCLUDE (x), list_sum(list_transform({conv(K.DB4_HIGH)}, lambda v: v*v)) AS e{lev}, "
                    f"{conv(K.DB4_LOW)} AS lo FROM p{lev})")
        prev, m = f"a{lev}", mp // 2
    out = ", ".join(r(f"e{i} / CASE WHEN tot > 0 THEN tot END", 6, f"f13_mra_energy_d{i}") for i in range(1, 6))
    return f"""WITH {PANEL}, {RR}, a AS (SELECT instrument, date, CASE WHEN count(ret) OVER {over(n)} = {n}
  THEN list(ret) OVER {over(n)} END AS lo FROM rr),
a0 AS (SELECT *, list_sum(list_transform(lo, lambda v: v*v)) AS tot FROM a WHERE lo IS NOT NULL), {', '.join(ctes)}
SELECT a.instrument, a.date, {out} FROM a LEFT JOIN a5 USING (instrument, date)"""


@query("f13_wavelet_energy", "F13", wavelet_sql(), causal=True)
def f13_wavelet_energy(spark, sf):
    return rounded(K.wavelet_energy(panel(spark, sf)))


def passage_sql(n=252, sims=200, h=10):
    w = f"({KEY} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    steps = ["arr[1 + CAST('0x' || substr(hx, %d, 6) AS BIGINT) %% %d]" % (1 + 6 * d, n) for d in range(h)]
    cols = ", ".join(f"{s} AS s{d}" for d, s in enumerate(steps))
    cums = ", ".join(f"round({' + '.join(f's{i}' for i in range(d + 1))}, 12) AS c{d}" for d in range(h))
    first = "CASE " + " ".join(f"WHEN c{d} >= b OR c{d} <= -b THEN {d + 1}" for d in range(h)) + " END"
    return f"""WITH {PANEL}, {RR}, a AS (SELECT instrument, date, CASE WHEN count(ret) OVER {w} = {n} THEN list(ret) OVER {w} END AS arr,
  {strict('stddev_samp', 'ret', 20)} AS sigma FROM rr),
ok AS (SELECT *, round(sigma * sqrt({h}.0), 12) AS b FROM a WHERE arr IS NOT NULL AND sigma > 1e-12),
sm AS (SELECT instrument, date, b, arr, sha256(instrument || '|' || date || '|' || i || '|42') AS hx FROM ok, generate_series(0, {sims - 1}) g(i)),
dr AS (SELECT instrument, date, b, {cols} FROM sm), cu AS (SELECT instrument, date, b, {cums} FROM dr),
ft AS (SELECT instrument, date, {first} AS f FROM cu),
res AS (SELECT instrument, date, coalesce(median(f), {h + 1}) AS hit, 1 - count(f) / {sims}.0 AS pto FROM ft GROUP BY 1, 2)
SELECT a.instrument, a.date, CAST(hit AS DOUBLE) AS f15_expected_hit_time, {r('pto', 6, 'f15_prob_timeout')}
FROM a LEFT JOIN res USING (instrument, date)"""


@query("f15_first_passage", "F15a", passage_sql(), causal=True)
def f15_first_passage(spark, sf):
    return rounded(K.first_passage(panel(spark, sf)))


@query("f15_path_shape", "F15b F15c", f"""WITH {PANEL}, {RR}, b AS (SELECT *, CASE WHEN ret > 0 THEN ret*ret ELSE 0 END AS up,
  CASE WHEN ret < 0 THEN ret*ret ELSE 0 END AS dn, abs(ret) AS ar FROM rr)
SELECT instrument, date, {r(f"({strict('sum', 'ar', 20)}) / (abs({strict('sum', 'ret', 20)}) + 1e-12)", 4, 'f15_path_tortuosity_20')},
  {r(f"sqrt({sma('up', 20)}) / (sqrt({sma('dn', 20)}) + 1e-12)", 6, 'f15_realized_semi_vol_ratio_20')} FROM b""", causal=True)
def f15_path_shape(spark, sf):
    return rounded(K.path_shape(panel(spark, sf)), special={"f15_path_tortuosity_20": 4})


def edges_sql(x, k):
    def at(i):
        n1 = f"(len({x}) - 1)"
        lo = f"({n1} * {i} // {k})"
        return (f"list_sort({x})[{lo} + 1] + (({n1} * {i}) % {k}) / {float(k)} * "
                f"(list_sort({x})[least({lo} + 1, {n1}) + 1] - list_sort({x})[{lo} + 1])")
    return "list_distinct([" + ", ".join(at(i) for i in range(k + 1)) + "])"


def bins_sql(x, e):
    return f"list_transform({x}, lambda v: greatest(len(list_filter({e}, lambda q: q < v)) - 1, 0))"


def ent_sql(codes):
    return f"list_entropy({codes}) * ln(2)"


def mi_sql(n=252):
    w = over(n)
    return f"""WITH {PANEL}, {RR}, a AS (SELECT instrument, date, row_number() OVER ({KEY}) AS pos,
  list(CAST(s AS DOUBLE)) FILTER (s IS NOT NULL AND ret IS NOT NULL) OVER {w} AS xs,
  list(ret) FILTER (s IS NOT NULL AND ret IS NOT NULL) OVER {w} AS ys FROM rr),
f AS (SELECT *, {edges_sql('xs', 5)} AS ex, {edges_sql('ys', 5)} AS ey FROM a WHERE pos >= {n} AND len(xs) >= 10),
b AS (SELECT instrument, date, {bins_sql('xs', 'ex')} AS bx, {bins_sql('ys', 'ey')} AS by_ FROM f),
c AS (SELECT *, list_transform(list_zip(bx, by_), lambda z: z[1] * 5 + z[2]) AS bxy FROM b),
m AS (SELECT instrument, date, {ent_sql('bx')} + {ent_sql('by_')} - {ent_sql('bxy')} AS mi FROM c)
SELECT a.instrument, a.date, {r('mi', 6, 'mutual_information')} FROM a LEFT JOIN m USING (instrument, date)"""


@query("rolling_mutual_information", "H1", mi_sql(), causal=True)
def rolling_mutual_information(spark, sf):
    return rounded(K.mutual_information(panel(spark, sf), "s"))


def te_sql(n=126):
    w = over(n)
    f = "FILTER (acc IS NOT NULL AND ap IS NOT NULL AND vp IS NOT NULL)"
    return f"""WITH {PANEL}, {RR}, v AS (SELECT *, {strict('stddev_samp', 'ret', 20)} AS vol,
  CASE WHEN s IS NOT NULL AND ret IS NOT NULL THEN CASE WHEN s * ret > 0 THEN 1 ELSE 0 END END AS acc FROM rr),
l AS (SELECT *, {lag('acc')} AS ap, {lag('vol')} AS vp, row_number() OVER ({KEY}) AS pos FROM v),
a AS (SELECT instrument, date, pos, list(acc) {f} OVER {w} AS ac, list(ap) {f} OVER {w} AS al, list(vp) {f} OVER {w} AS vl FROM l),
g AS (SELECT *, {edges_sql('vl', 3)} AS ev FROM a WHERE pos > {n} AND len(vl) >= 24),
b AS (SELECT instrument, date, al, ac, {bins_sql('vl', 'ev')} AS bv FROM g),
c AS (SELECT *, list_transform(list_zip(ac, al), lambda z: z[1] * 2 + z[2]) AS aa, list_transform(list_zip(al, bv), lambda z: z[1] * 3 + z[2]) AS av,
  list_transform(list_zip(ac, al, bv), lambda z: (z[1] * 2 + z[2]) * 3 + z[3]) AS aav FROM b),
t AS (SELECT instrument, date, greatest(({ent_sql('aa')}) - ({ent_sql('al')}) - ({ent_sql('aav')}) + ({ent_sql('av')}), 0) AS te FROM c)
SELECT a.instrument, a.date, {r('te', 6, 'transfer_entropy')} FROM a LEFT JOIN t USING (instrument, date)"""


@query("transfer_entropy", "H2", te_sql(), causal=True)
def transfer_entropy(spark, sf):
    return rounded(K.transfer_entropy(panel(spark, sf)))
