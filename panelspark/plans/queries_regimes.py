"""Regime families. The twins unroll the same fixed number of EM rounds in SQL and
filter row by row with a recursive CTE."""

import math

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import regimes as G
from ..sources.store import panel
from .registry import query
from .sqltext import KEY, PANEL, lag, r, sd

TRAIN_END, ROUNDS = "2000-01-01", 5


def end():
    return F.lit(TRAIN_END).cast("date")


RV = f"""rv0 AS (SELECT instrument, date, ln(close) - {lag('ln(close)')} AS ret FROM panel),
rv AS MATERIALIZED (SELECT * FROM (SELECT instrument, date, ret, {sd('ret', 20)} * sqrt(252.0) AS vol FROM rv0) WHERE vol IS NOT NULL)"""


def em_sql(cols, k, order, by, min_rows):
    d = len(cols)
    pairs = G.cov_pairs(d)
    sc = ", ".join(f"avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS {c}_s" for c in cols)
    xs = ", ".join(f"({c} - {c}_m) / {c}_s AS x{i}" for i, c in enumerate(cols))

    def mstep(src):
        parts = []
        for j in range(k):
            s = f"(sum(g{j}) + 1e-12)"
            parts.append(f"{s} / count(*) AS w{j}")
            parts += [f"sum(g{j}*x{a}) / {s} AS m{j}_{a}" for a in range(d)]
            parts += [f"sum(g{j}*x{a}*x{b}) / {s} - (sum(g{j}*x{a})/{s})*(sum(g{j}*x{b})/{s})"
                      + (" + 1e-6" if a == b else "") + f" AS c{j}_{a}{b}" for a, b in pairs]
        return f"SELECT instrument, {', '.join(parts)} FROM {src} GROUP BY 1"

    def dens(j):
        if d == 1:
            return f"w{j} / (sqrt(c{j}_00) * sqrt(2*pi())) * exp(-0.5 * (x0 - m{j}_0)**2 / c{j}_00)"
        det = f"(c{j}_00*c{j}_11 - c{j}_01**2)"
        q = (f"(c{j}_11*(x0-m{j}_0)**2 - 2*c{j}_01*(x0-m{j}_0)*(x1-m{j}_1) + c{j}_00*(x1-m{j}_1)**2) / {det}")
        return f"w{j} / (sqrt{det} * 2*pi()) * exp(-0.5 * {q})"

    def gamma(src, params):
        ps = ", ".join(f"{dens(j)} AS p{j}" for j in range(k))
        tot = " + ".join(f"p{j}" for j in range(k)) + " + 1e-300"
        gs = ", ".join(f"p{j} / ({tot}) AS g{j}" for j in range(k))
        return f"SELECT *, {gs} FROM (SELECT x.*, {ps} FROM {src} x JOIN {params} USING (instrument))"

    edges = "[" + ", ".join(f"quantile_cont({order}, {i}/{float(k)})" for i in range(1, k)) + "]"
    out = [f"sc AS (SELECT instrument, count(*) AS n, {sc} FROM rv WHERE date <= DATE '{TRAIN_END}' GROUP BY 1 HAVING count(*) >= {min_rows})",
           f"xa AS MATERIALIZED (SELECT rv.instrument, date, {xs} FROM rv JOIN sc USING (instrument))",
           f"tr AS MATERIALIZED (SELECT * FROM xa WHERE date <= DATE '{TRAIN_END}')",
           f"ct AS (SELECT instrument, {edges} AS cuts FROM tr GROUP BY 1)",
           "g0 AS (SELECT *, " + ", ".join(f"CASE WHEN grp = {j} THEN 1.0 ELSE 0.0 END AS g{j}" for j in range(k))
           + f" FROM (SELECT tr.*, len(list_filter(cuts, lambda c: c < {order})) AS grp FROM tr JOIN ct USING (instrument)))",
           f"q0 AS MATERIALIZED ({mstep('g0')})"]
    for i in range(1, ROUNDS + 1):
        out.append(f"q{i} AS MATERIALIZED ({mstep('(' + gamma('tr', f'q{i - 1}') + ')')})")
    names = ["w{}"] + [f"m{{}}_{a}" for a in range(d)] + [f"c{{}}_{a}{b}" for a, b in pairs]
    out.append("un AS (" + " UNION ALL ".join(
        f"SELECT instrument, {by.format(j)} AS o, {j} AS j, " + ", ".join(f"{n.format(j)} AS f{i}" for i, n in enumerate(names))
        + f" FROM q{ROUNDS}" for j in range(k)) + ")")
    out.append("rk AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY o, j) - 1 AS rk FROM un)")
    out.append("pq AS MATERIALIZED (SELECT instrument, " + ", ".join(
        f"max(f{i}) FILTER (rk = {j}) AS {n.format(j)}" for j in range(k) for i, n in enumerate(names)) + " FROM rk GROUP BY 1)")
    return ", ".join(out), gamma, dens


EM2, gam2, _ = em_sql(("ret", "vol"), 2, "x1", "m{}_1", 30)


@query("f3_gmm_prob_highvol", "K3 K2", f"""WITH {PANEL}, {RV}, {EM2}, ga AS ({gam2('xa', 'pq')})
SELECT rv.instrument, rv.date, {r('ga.g1', 5, 'f3_gmm_prob_highvol')} FROM rv LEFT JOIN ga USING (instrument, date)""")
def f3_gmm_prob_highvol(spark, sf):
    return rounded(G.gmm_high_vol(panel(spark, sf), end(), rounds=ROUNDS), 5)


def filter_sql(cols, k, order, by, min_rows):
    em, gamma, dens = em_sql(cols, k, order, by, min_rows)
    tr = ", ".join(f"(t{i}{j} + 1e-4) / (" + " + ".join(f"t{i}{b} + 1e-4" for b in range(k)) + f") AS a{i}{j}"
                   for i in range(k) for j in range(k))
    ts = ", ".join(f"sum(g{i} * n{j}) AS t{i}{j}" for i in range(k) for j in range(k))
    es = ", ".join(f"({dens(j)}) / w{j} AS d{j}" for j in range(k))
    mx = "(greatest(" + ", ".join(f"d{j}" for j in range(k)) + ") + 1e-300)"
    esc = ", ".join(f"d{j} / {mx} + 1e-30 AS e{j}" for j in range(k))

    def norm(xs):
        tot = "(" + " + ".join(f"({x})" for x in xs) + ")"
        return ", ".join(f"({x}) / {tot} AS f{j}" for j, x in enumerate(xs))

    first = norm([f"q{j} * e{j}" for j in range(k)])
    nxt = norm(["(" + " + ".join(f"f.f{i} * b.a{i}{j}" for i in range(k)) + f") * b.e{j}" for j in range(k)])
    return f"""{em}, gt AS ({gamma('tr', 'pq')}),
ld AS (SELECT *, {', '.join(f'lead(g{j}) OVER ({KEY}) AS n{j}' for j in range(k))} FROM gt),
tt AS (SELECT instrument, {', '.join(f'avg(g{j}) AS q{j}' for j in range(k))}, {ts} FROM ld GROUP BY 1),
ta AS (SELECT instrument, {', '.join(f'q{j}' for j in range(k))}, {tr} FROM tt),
de AS (SELECT x.instrument, date, row_number() OVER ({KEY}) AS pos, {es} FROM xa x JOIN pq USING (instrument)),
em AS MATERIALIZED (SELECT de.instrument, date, pos, {esc}, ta.* EXCLUDE (instrument) FROM de JOIN ta USING (instrument)),
fl AS (SELECT instrument, date, pos, {first} FROM em WHERE pos = 1
  UNION ALL SELECT b.instrument, b.date, b.pos, {nxt} FROM fl f JOIN em b ON b.instrument = f.instrument AND b.pos = f.pos + 1)"""


@query("f3_markov_regime", "K4", f"""WITH RECURSIVE {PANEL}, {RV}, {filter_sql(('ret',), 2, 'abs(x0)', 'c{}_00', 30)},
st AS (SELECT *, CASE WHEN round(f1, 9) >= 0.5 THEN 1 ELSE 0 END AS st FROM fl),
cg AS (SELECT *, CASE WHEN {lag('st')} = st THEN 0 ELSE 1 END AS chg FROM st),
rn AS (SELECT *, sum(chg) OVER ({KEY}) AS run FROM cg)
SELECT instrument, date, {r('f1', 5, 'f3_markov_prob_highvol')}, {r(f'abs(f1 - {lag("f1")})', 5, 'f3_markov_switch_prob')},
  CAST(row_number() OVER (PARTITION BY instrument, run ORDER BY date) AS DOUBLE) AS f3_regime_dwell FROM rn""")
def f3_markov_regime(spark, sf):
    return rounded(G.markov_regime(panel(spark, sf), end(), rounds=ROUNDS), 5)


HMM = filter_sql(("ret", "vol"), 3, "x1", "m{}_1", 200)


@query("f17_hmm_states", "K5", f"""WITH RECURSIVE {PANEL}, {RV}, {HMM}
SELECT instrument, date, {r('f0', 5, 'f17_hmm_state_lo')}, {r('f1', 5, 'f17_hmm_state_mid')}, {r('f2', 5, 'f17_hmm_state_hi')},
  CASE WHEN round(f0,9) >= round(f1,9) AND round(f0,9) >= round(f2,9) THEN 0.0::DOUBLE
    WHEN round(f1,9) >= round(f2,9) THEN 1.0 ELSE 2.0 END AS f17_hmm_state_argmax FROM fl""")
def f17_hmm_states(spark, sf):
    return rounded(G.hmm_states(panel(spark, sf), end(), rounds=ROUNDS)[0], 5)


@query("hmm_next_state", "M9", f"""WITH RECURSIVE {PANEL}, {RV}, {HMM}, la AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY pos DESC) AS k FROM fl)
SELECT la.instrument, la.date, {r('f0*a00 + f1*a10 + f2*a20', 5, 'next_lo')}, {r('f0*a01 + f1*a11 + f2*a21', 5, 'next_mid')},
  {r('f0*a02 + f1*a12 + f2*a22', 5, 'next_hi')} FROM la JOIN ta USING (instrument) WHERE k = 1""")
def hmm_next_state(spark, sf):
    return rounded(G.next_state(panel(spark, sf), end(), ROUNDS), 5)


# ---- fits to the tolerance --------------------------------------------------------------

TOL, MAX_ROUNDS = 1e-6, 500


def em_to_tolerance_sql(min_rows=30):
    """The two-component fit on (ret, vol) as a recursion over rounds; a key stops by itself."""
    cols, k, d = ("ret", "vol"), 2, 2
    em, gamma, _ = em_sql(cols, k, "x1", "m{}_1", min_rows)
    start = em[:em.index(", q1 AS MATERIALIZED")]
    names = [f"w{j}" for j in range(k)] + [f"m{j}_{a}" for j in range(k) for a in range(d)] + [
        f"c{j}_{a}{b}" for j in range(k) for a, b in G.cov_pairs(d)]
    step = {}
    for j in range(k):
        s = f"(sum(g{j}) + 1e-12)"
        step[f"w{j}"] = f"{s} / count(*)"
        step |= {f"m{j}_{a}": f"sum(g{j}*x{a}) / {s}" for a in range(d)}
        step |= {f"c{j}_{a}{b}": f"sum(g{j}*x{a}*x{b}) / {s} - (sum(g{j}*x{a})/{s})*(sum(g{j}*x{b})/{s})"
                 + (" + 1e-6" if a == b else "") for a, b in G.cov_pairs(d)}
    det = "(e.c{0}_00*e.c{0}_11 - e.c{0}_01**2)"
    dens = ("e.w{0} / (sqrt(" + det + ") * 2*pi()) * exp(-0.5 * (e.c{0}_11*(x0-e.m{0}_0)**2 - 2*e.c{0}_01*(x0-e.m{0}_0)*(x1-e.m{0}_1)"
            " + e.c{0}_00*(x1-e.m{0}_1)**2) / " + det + ") AS p{0}")
    body = (f"SELECT t.instrument, e.i, e.ll, x0, x1, {', '.join(dens.format(j) for j in range(k))} "
            "FROM em e JOIN tr t USING (instrument) WHERE NOT e.done")
    return f"""{start}, em AS (SELECT instrument, 0 AS i, {', '.join(names)}, CAST('-inf' AS DOUBLE) AS ll, false AS done FROM q0
  UNION ALL SELECT instrument, i + 1, {', '.join(step[n] for n in names)}, avg(ln(p0 + p1)),
    abs(avg(ln(p0 + p1)) - any_value(ll)) < {TOL} OR i + 1 >= {MAX_ROUNDS}
    FROM (SELECT *, p0 / (p0 + p1) AS g0, p1 / (p0 + p1) AS g1 FROM ({body})) GROUP BY instrument, i),
un AS (SELECT instrument, m0_1 AS o, 0 AS j, w0 AS f0, m0_0 AS f1, m0_1 AS f2, c0_00 AS f3, c0_01 AS f4, c0_11 AS f5, i, ll FROM em WHERE done
  UNION ALL SELECT instrument, m1_1, 1, w1, m1_0, m1_1, c1_00, c1_01, c1_11, i, ll FROM em WHERE done),
rk AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY o, j) - 1 AS rk FROM un),
pq AS MATERIALIZED (SELECT instrument, any_value(i) AS rounds, any_value(ll) AS loglik, {', '.join(
        f"max(f{i}) FILTER (rk = {j}) AS {n.format(j)}" for j in range(k)
        for i, n in enumerate(("w{}", "m{}_0", "m{}_1", "c{}_00", "c{}_01", "c{}_11")))} FROM rk GROUP BY 1)""", gamma


EMT, gamt = em_to_tolerance_sql()


@query("f3_gmm_fitted", "K3 K2", f"""WITH RECURSIVE {PANEL}, {RV}, {EMT}, ga AS ({gamt('xa', 'pq')})
SELECT rv.instrument, rv.date, {r('ga.g1', 4, 'f3_gmm_prob_highvol')} FROM rv LEFT JOIN ga USING (instrument, date)""")
def f3_gmm_fitted(spark, sf):
    p = panel(spark, sf)
    return rounded(G.apply_gmm(p, G.fit_gmm(p, end(), tol=TOL, max_rounds=MAX_ROUNDS)), 4)


@query("gmm_parameters", "K3 K1", f"""WITH RECURSIVE {PANEL}, {RV}, {EMT}
SELECT instrument, sc.n AS n_train, {', '.join(r(c, 3) for c in ('w0', 'w1', 'm0_0', 'm0_1', 'm1_0', 'm1_1', 'loglik'))} FROM pq JOIN sc USING (instrument)""")
def gmm_parameters(spark, sf):
    t = G.fit_gmm(panel(spark, sf), end(), tol=TOL, max_rounds=MAX_ROUNDS)
    return rounded(t.select("instrument", "n_train", "w0", "w1", "m0_0", "m0_1", "m1_0", "m1_1", "loglik"), 3)


@query("f3_markov_fitted", "K4")
def f3_markov_fitted(spark, sf):
    p = panel(spark, sf)
    return rounded(G.apply_markov(p, G.fit_markov(p, end())), 5)


@query("f17_hmm_fitted", "K5")
def f17_hmm_fitted(spark, sf):
    p = panel(spark, sf)
    return rounded(G.apply_hmm(p, G.fit_hmm(p, end())), 5)


@query("hmm_next_observation", "M9")
def hmm_next_observation(spark, sf):
    p = panel(spark, sf)
    return rounded(G.next_observation(p, G.fit_hmm(p, end())), 5)
