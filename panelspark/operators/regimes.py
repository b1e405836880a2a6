"""Fitted regimes: keyed Gaussian mixtures, transition tables and the causal filter.

All keys are fitted in the same jobs. A fitted object is a small parameter table
with one row per key, written to the checkpoint folder after every round; rows
after the training boundary only ever see that frozen table.
"""

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import ANNUAL
from ..functions.windows import KEY, ORDER, log_return, ordered, rsd, running, whole
from ..sources.store import checkpointed
from . import em

REG = 1e-6
BROADCAST_ROWS = 100_000
CHUNK = 32
A_FLOOR = 1e-4


def ret_vol(panel: DataFrame) -> DataFrame:
    """K2: log return and annualised 20-bar volatility, both present."""
    df = panel.withColumn("ret", log_return())
    df = df.withColumn("vol", rsd("ret", 20) * math.sqrt(ANNUAL))
    return df.filter("ret IS NOT NULL AND vol IS NOT NULL").select(KEY, "asset_class", ORDER,
                                                                   "ret", "vol")


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a parameter table only below a checked row count."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def frozen_scaler(train: DataFrame, cols, key=KEY) -> DataFrame:
    """Per-key train mean and population sd (0 -> 1)."""
    aggs = [F.count("*").alias("n_train")]
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_m"),
                 F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0).alias(f"{c}_s")]
    return train.groupBy(key).agg(*aggs)


def scaled(df: DataFrame, scaler: DataFrame, cols) -> DataFrame:
    out = df.join(scaler, KEY)
    return out.withColumns({f"x{i}": (F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s")
                            for i, c in enumerate(cols)})


def cov_pairs(d):
    return [(a, b) for a in range(d) for b in range(a, d)]


def density(j: int, d: int):
    """Weighted Gaussian density of component j from the parameter columns."""
    dx = [F.col(f"x{a}") - F.col(f"m{j}_{a}") for a in range(d)]
    if d == 1:
        det = F.col(f"c{j}_00")
        quad = dx[0] * dx[0] / det
    else:
        s00, s01, s11 = (F.col(f"c{j}_{a}{b}") for a, b in cov_pairs(2))
        det = s00 * s11 - s01 * s01
        quad = (s11 * dx[0] * dx[0] - 2.0 * s01 * dx[0] * dx[1] + s00 * dx[1] * dx[1]) / det
    return F.col(f"w{j}") / (F.sqrt(det) * (2.0 * math.pi) ** (d / 2.0)) * F.exp(-0.5 * quad)


def with_gamma(df: DataFrame, params: DataFrame, k: int, d: int) -> DataFrame:
    """Responsibilities g0..g(k-1) of every row under its key's parameters."""
    df = df.join(params, KEY).withColumns({f"p{j}": density(j, d) for j in range(k)})
    tot = sum((F.col(f"p{j}") for j in range(1, k)), F.col("p0")) + 1e-300
    return df.withColumns({f"g{j}": F.col(f"p{j}") / tot for j in range(k)})


def m_step(df: DataFrame, k: int, d: int) -> DataFrame:
    """Weighted moments per key: one partially aggregated groupBy for all components."""
    aggs = []
    for j in range(k):
        g = F.col(f"g{j}")
        aggs.append(F.sum(g).alias(f"s{j}"))
        aggs += [F.sum(g * F.col(f"x{a}")).alias(f"s{j}_{a}") for a in range(d)]
        aggs += [F.sum(g * F.col(f"x{a}") * F.col(f"x{b}")).alias(f"s{j}_{a}{b}")
                 for a, b in cov_pairs(d)]
    t = df.groupBy(KEY).agg(F.count("*").cast("double").alias("n"), *aggs)
    cols = []
    for j in range(k):
        s = F.col(f"s{j}") + 1e-12
        cols.append(((F.col(f"s{j}") + 1e-12) / F.col("n")).alias(f"w{j}"))
        mean = [F.col(f"s{j}_{a}") / s for a in range(d)]
        cols += [mean[a].alias(f"m{j}_{a}") for a in range(d)]
        cols += [(F.col(f"s{j}_{a}{b}") / s - mean[a] * mean[b]
                  + (REG if a == b else 0.0)).alias(f"c{j}_{a}{b}") for a, b in cov_pairs(d)]
    return t.select(KEY, *cols)


def fit_mixture(train: DataFrame, order_by, k: int, d: int, rounds=8) -> DataFrame:
    """Keyed EM. ``train`` has KEY and x0..x(d-1); rows start in the k quantile
    groups of ``order_by`` within their key."""
    cuts = train.groupBy(KEY).agg(F.percentile(order_by, F.array(
        *[F.lit(i / k) for i in range(1, k)])).alias("cuts"))
    cuts = checkpointed(cuts)
    rows = cuts.count()
    start = train.withColumn("_o", order_by).join(small(cuts, rows), KEY)
    grp = F.size(F.filter("cuts", lambda c: c < F.col("_o")))
    start = start.withColumns({f"g{j}": (grp == j).cast("double") for j in range(k)})
    params = checkpointed(m_step(start, k, d))
    for _ in range(rounds):
        params = checkpointed(m_step(with_gamma(train, small(params, rows), k, d), k, d))
    return small(params, rows)


def sort_components(params: DataFrame, k: int, d: int, by) -> DataFrame:
    """Renumber components by ascending ``by(j)`` (a parameter column)."""
    names = [f"w{{}}"] + [f"m{{}}_{a}" for a in range(d)] + [f"c{{}}_{a}{b}" for a, b in cov_pairs(d)]
    comp = F.array_sort(F.array(*[F.struct(by(j).alias("k"), F.lit(j).alias("j"), *[
        F.col(n.format(j)).alias(f"f{i}") for i, n in enumerate(names)]) for j in range(k)]))
    p = params.withColumn("_c", comp)
    return p.select(KEY, *[F.col("_c")[j][f"f{i}"].alias(n.format(j))
                           for j in range(k) for i, n in enumerate(names)])


def gmm_high_vol(panel: DataFrame, train_end, min_rows=30, rounds=8) -> DataFrame:
    """K3: posterior of the high-volatility component; NULL below ``min_rows``."""
    obs = ret_vol(panel)
    train = checkpointed(obs.filter(F.col(ORDER) <= train_end))
    scaler = checkpointed(frozen_scaler(train, ("ret", "vol")).filter(F.col("n_train") >= min_rows))
    xs = scaled(train, scaler, ("ret", "vol")).select(KEY, "x0", "x1")
    params = sort_components(fit_mixture(xs, F.col("x1"), 2, 2, rounds), 2, 2,
                             lambda j: F.col(f"m{j}_1"))
    post = with_gamma(scaled(obs, scaler, ("ret", "vol")), params, 2, 2)
    return obs.select(KEY, ORDER).join(
        post.select(KEY, ORDER, F.col("g1").alias("f3_gmm_prob_highvol")), [KEY, ORDER], "left")


def transitions(train: DataFrame, params: DataFrame, k: int, d: int) -> DataFrame:
    """Start and transition tables from adjacent responsibilities (not full EM)."""
    g = with_gamma(train, params, k, d)
    w = ordered()
    nxt = g.withColumns({f"n{j}": F.lead(f"g{j}").over(w) for j in range(k)})
    t = nxt.groupBy(KEY).agg(
        *[F.avg(f"g{j}").alias(f"q{j}") for j in range(k)],
        *[F.sum(F.col(f"g{i}") * F.col(f"n{j}")).alias(f"t{i}{j}") for i in range(k) for j in range(k)])
    rows = []
    for i in range(k):
        fl = [F.col(f"t{i}{j}") + A_FLOOR for j in range(k)]
        tot = sum(fl[1:], fl[0])
        rows.append(F.array(*[x / tot for x in fl]))
    return t.select(KEY, F.array(*[F.col(f"q{j}") for j in range(k)]).alias("pi"),
                    F.array(*rows).alias("A"))


def forward_filter(df: DataFrame, k: int) -> DataFrame:
    """Filtered state probabilities of rows with pos, e (array of k likelihoods), pi, A.

    A step multiplies by A and scales by e, so a chunk of rows is one k x k
    matrix. (1) chunk matrices, in parallel over (key, chunk); (2) one fold over
    the chunk matrices of a key gives the vector entering each chunk; (3) rows
    fold inside their chunk. Emissions are scaled to a maximum of one and A is
    floored, so a chunk of 32 rows cannot underflow.
    """
    top = F.array_max("e") + 1e-300
    df = df.withColumn("e", F.transform("e", lambda v: v / top + 1e-30))
    df = df.withColumn("chunk", F.floor((F.col("pos") - 1) / F.lit(CHUNK)))
    chunks = df.groupBy(KEY, "chunk").agg(
        F.array_sort(F.collect_list(F.struct("pos", ORDER, "e"))).alias("rows"),     # <= 32
        F.first("pi").alias("pi"), F.first("A").alias("A"))

    def advance(v, r):
        """v A diag(e); the first row of a series has no transition before it."""
        def at(j):
            moved = sum((v[i] * F.col("A")[i][j] for i in range(1, k)), v[0] * F.col("A")[0][j])
            return F.when(r["pos"] == 1, v[j]).otherwise(moved) * r["e"][j]
        return F.array(*[at(j) for j in range(k)])

    unit = [F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(k)]) for i in range(k)]
    chunks = chunks.withColumns({f"M{i}": F.aggregate("rows", unit[i], advance) for i in range(k)})

    def vec_norm(xs):
        tot = sum(xs[1:], xs[0])
        return F.array(*[x / tot for x in xs])

    folded = chunks.groupBy(KEY).agg(
        F.array_sort(F.collect_list(F.struct("chunk", *[f"M{i}" for i in range(k)]))).alias("cs"),
        F.first("pi").alias("pi"))
    zero = F.struct(F.col("pi").alias("v"),
                    F.array().cast("array<struct<chunk:bigint,v:array<double>>>").alias("out"))

    def step(acc, c):
        v = acc["v"]
        moved = [sum((v[i] * c[f"M{i}"][j] for i in range(1, k)), v[0] * c["M0"][j]) for j in range(k)]
        return F.struct(vec_norm(moved).alias("v"), F.array_append(
            acc["out"], F.struct(c["chunk"].alias("chunk"), v.alias("v"))).alias("out"))

    entering = folded.select(KEY, F.explode(F.aggregate("cs", zero, step, lambda a: a["out"])).alias("c"))
    entering = entering.select(KEY, "c.chunk", F.col("c.v").alias("v_in"))
    run = chunks.select(KEY, "chunk", "rows", "A").join(entering, [KEY, "chunk"])

    def scan(acc, r):
        v = advance(acc["v"], r)
        return F.struct(v.alias("v"), F.array_append(acc["out"], F.struct(
            r[ORDER].alias(ORDER), v.alias("v"))).alias("out"))

    empty = F.struct(F.col("v_in").alias("v"),
                     F.array().cast("array<struct<date:date,v:array<double>>>").alias("out"))
    rows = run.select(KEY, F.explode(F.aggregate("rows", empty, scan, lambda a: a["out"])).alias("x"))
    rows = rows.select(KEY, F.col("x.date").alias(ORDER), F.col("x.v").alias("v"))
    tot = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("_t", tot).select(
        KEY, ORDER, *[(F.col("v")[j] / F.col("_t")).alias(f"f{j}") for j in range(k)])


def filtered_states(obs: DataFrame, train: DataFrame, cols, k: int, order_by, sort_by, rounds=8):
    """Scale, fit, order the states, estimate transitions, filter all rows."""
    d = len(cols)
    scaler = checkpointed(frozen_scaler(train, cols))
    xs = scaled(train, scaler, cols).select(KEY, ORDER, *[f"x{i}" for i in range(d)])
    params = sort_components(fit_mixture(xs, order_by, k, d, rounds), k, d, sort_by)
    params = checkpointed(params)
    trans = checkpointed(transitions(xs, params, k, d))
    df = scaled(obs, scaler, cols).join(params, KEY)
    # the filter needs plain likelihoods: divide the mixing weight out
    e = F.array(*[density(j, d) / F.col(f"w{j}") for j in range(k)])
    df = df.withColumns({"e": e, "pos": F.row_number().over(ordered())})
    return forward_filter(df.select(KEY, ORDER, "pos", "e").join(trans, KEY), k), trans


def markov_regime(panel: DataFrame, train_end, min_rows=30, rounds=8) -> DataFrame:
    """K4: filtered high-variance probability of returns, its change and dwell."""
    obs = ret_vol(panel)
    train = obs.filter(F.col(ORDER) <= train_end)
    keep = train.groupBy(KEY).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_rows)
    obs = checkpointed(obs.join(keep.select(KEY), KEY, "left_semi"))
    train = obs.filter(F.col(ORDER) <= train_end)
    filt, _ = filtered_states(obs, train, ("ret",), 2, F.abs("x0"), lambda j: F.col(f"c{j}_00"), rounds)
    return dwell(filt)


def dwell(filt: DataFrame) -> DataFrame:
    """Probability of the second state, its absolute change, and rows since the state changed."""
    w = ordered()
    p = filt.select(KEY, ORDER, F.col("f1").alias("f3_markov_prob_highvol"))
    state = (F.round("f3_markov_prob_highvol", 9) >= 0.5).cast("int")
    p = p.withColumn("_st", state)
    chg = F.when(F.lag("_st").over(w) == F.col("_st"), 0).otherwise(1)
    p = p.withColumn("_chg", chg)
    p = p.withColumn("_run", F.sum("_chg").over(running()))
    return p.select(KEY, ORDER, "f3_markov_prob_highvol",
                    F.abs(F.col("f3_markov_prob_highvol") - F.lag("f3_markov_prob_highvol").over(w))
                    .alias("f3_markov_switch_prob"),
                    F.row_number().over(Window.partitionBy(KEY, "_run").orderBy(ORDER))
                    .cast("double").alias("f3_regime_dwell"))


HMM_NAMES = ("f17_hmm_state_lo", "f17_hmm_state_mid", "f17_hmm_state_hi")


def hmm_states(panel: DataFrame, train_end, min_rows=200, rounds=8):
    """K5: three states on (ret, vol) ordered by mean volatility, forward-only."""
    obs = ret_vol(panel)
    train = obs.filter(F.col(ORDER) <= train_end)
    keep = train.groupBy(KEY).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_rows)
    obs = checkpointed(obs.join(keep.select(KEY), KEY, "left_semi"))
    train = obs.filter(F.col(ORDER) <= train_end)
    filt, trans = filtered_states(obs, train, ("ret", "vol"), 3, F.col("x1"),
                                  lambda j: F.col(f"m{j}_1"), rounds)
    return named_states(filt), trans


def named_states(filt: DataFrame) -> DataFrame:
    f = [F.round(f"f{j}", 9) for j in range(3)]
    arg = F.when((f[0] >= f[1]) & (f[0] >= f[2]), 0.0).when(f[1] >= f[2], 1.0).otherwise(2.0)
    return filt.select(KEY, ORDER, *[F.col(f"f{j}").alias(n) for j, n in enumerate(HMM_NAMES)],
                       arg.alias("f17_hmm_state_argmax"))


def next_state(panel: DataFrame, train_end, rounds=8) -> DataFrame:
    """M9: next-state distribution F*Q and expected next volatility state per key."""
    states, trans = hmm_states(panel, train_end, rounds=rounds)
    last = states.groupBy(KEY).agg(*[F.max_by(n, ORDER).alias(n) for n in HMM_NAMES],
                                   F.max(ORDER).alias(ORDER))
    df = last.join(trans, KEY)
    nxt = [sum((F.col(HMM_NAMES[i]) * F.col("A")[i][j] for i in range(1, 3)),
               F.col(HMM_NAMES[0]) * F.col("A")[0][j]) for j in range(3)]
    return df.select(KEY, ORDER, *[nxt[j].alias(f"next_{n}") for j, n in enumerate(("lo", "mid", "hi"))])


# ---- fits to a tolerance, as tables that are applied frozen ---------------------------

def parameter_names(k: int, d: int):
    return [f"w{j}" for j in range(k)] + [f"m{j}_{a}" for j in range(k) for a in range(d)] + [
        f"c{j}_{a}{b}" for j in range(k) for a, b in cov_pairs(d)]


def fit_table(train: DataFrame, cols, k: int, by, chain: bool, min_rows: int, tol=em.TOL, max_rounds=em.MAX_ROUNDS) -> DataFrame:
    """One row per key: train scaler, parameters, log likelihood and rounds; with ``chain`` pi and A.

    Every key is fitted to the tolerance by itself. States are numbered by ascending
    ``by(means, covariances)``; keys with fewer than ``min_rows`` train rows have no row.
    """
    import numpy as np
    import pandas as pd
    d, names = len(cols), parameter_names(k, len(cols))
    scaler = frozen_scaler(train, cols).filter(F.col("n_train") >= min_rows)
    xs = scaled(train, scaler, cols).select(KEY, ORDER, *[f"x{i}" for i in range(d)])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(ORDER)[[f"x{i}" for i in range(d)]].to_numpy()
        start = em.quantile_groups(np.abs(x[:, 0]) if d == 1 else x[:, -1], k)
        pi, a = np.full(k, 1.0 / k), np.full((k, k), 1.0 / k)
        if chain:
            pi, a, w, mean, cov, ll, rounds = em.hidden_chain(x, start, tol, max_rounds)
        else:
            w, mean, cov, ll, rounds = em.mixture(x, start, tol, max_rounds)
        o = np.argsort(by(mean, cov), kind="stable")
        w, mean, cov, pi, a = w[o], mean[o], cov[o], pi[o], a[np.ix_(o, o)]
        values = [*w, *mean.ravel(), *[cov[j, i, m] for j in range(k) for i, m in cov_pairs(d)]]
        return pd.DataFrame([[pdf[KEY].iloc[0], *values, pi.tolist(), a.tolist(), ll, rounds]],
                            columns=[KEY, *names, "pi", "A", "loglik", "rounds"])

    fitted = xs.groupBy(KEY).applyInPandas(fit, f"{KEY} string, " + ", ".join(f"{n} double" for n in names)
                                           + ", pi array<double>, A array<array<double>>, loglik double, rounds int")
    return scaler.join(fitted, KEY)


def filtered_by(obs: DataFrame, table: DataFrame, cols, k: int) -> DataFrame:
    """Forward-filtered state probabilities f0..f(k-1) of all rows under frozen tables."""
    d = len(cols)
    df = scaled(obs, table, cols)
    e = F.array(*[density(j, d) / F.col(f"w{j}") for j in range(k)])
    df = df.withColumns({"e": e, "pos": F.row_number().over(ordered())})
    return forward_filter(df.select(KEY, ORDER, "pos", "e", "pi", "A"), k)


RET_VOL, RET = ("ret", "vol"), ("ret",)


def fit_gmm(panel: DataFrame, train_end, min_rows=30, **more) -> DataFrame:
    """K3: two components on (ret, vol), the second of higher volatility."""
    obs = ret_vol(panel).filter(F.col(ORDER) <= train_end)
    return fit_table(obs, RET_VOL, 2, lambda mean, cov: mean[:, 1], False, min_rows, **more).drop("pi", "A")


def apply_gmm(panel: DataFrame, table: DataFrame) -> DataFrame:
    obs = ret_vol(panel)
    x = scaled(obs, table, RET_VOL).withColumns({f"p{j}": density(j, 2) for j in range(2)})
    post = x.select(KEY, ORDER, (F.col("p1") / (F.col("p0") + F.col("p1") + 1e-300)).alias("f3_gmm_prob_highvol"))
    return obs.select(KEY, ORDER).join(post, [KEY, ORDER], "left")


def fit_markov(panel: DataFrame, train_end, min_rows=30, **more) -> DataFrame:
    """K4: two states of the return, the second of higher variance."""
    obs = ret_vol(panel).filter(F.col(ORDER) <= train_end)
    return fit_table(obs, RET, 2, lambda mean, cov: cov[:, 0, 0], True, min_rows, **more)


def apply_markov(panel: DataFrame, table: DataFrame) -> DataFrame:
    return dwell(filtered_by(ret_vol(panel), table, RET, 2))


def fit_hmm(panel: DataFrame, train_end, min_rows=200, **more) -> DataFrame:
    """K5: three states on (ret, vol) by ascending mean volatility."""
    obs = ret_vol(panel).filter(F.col(ORDER) <= train_end)
    return fit_table(obs, RET_VOL, 3, lambda mean, cov: mean[:, 1], True, min_rows, **more)


def apply_hmm(panel: DataFrame, table: DataFrame) -> DataFrame:
    return named_states(filtered_by(ret_vol(panel), table, RET_VOL, 3))


def next_observation(panel: DataFrame, table: DataFrame) -> DataFrame:
    """M9: distribution of the next state (last filtered one times A) and of the next observation.

    The emission table O holds, per state, the probabilities of a return below, inside and
    above one train standard deviation; the distribution of the observation is the next
    state's times O. The expected next return and volatility are the states' means, unscaled.
    """
    last = apply_hmm(panel, table).groupBy(KEY).agg(*[F.max_by(n, ORDER).alias(n) for n in HMM_NAMES], F.max(ORDER).alias(ORDER))
    df = last.join(table, KEY)
    nxt = [sum((F.col(HMM_NAMES[i]) * F.col("A")[i][j] for i in range(1, 3)), F.col(HMM_NAMES[0]) * F.col("A")[0][j])
           for j in range(3)]
    df = df.withColumns({f"next_{n}": nxt[j] for j, n in enumerate(("lo", "mid", "hi"))})
    state = [F.col(f"next_{n}") for n in ("lo", "mid", "hi")]

    def below(j, at):
        """Normal distribution function of the scaled return in state j."""
        return normal_cdf((F.lit(at) - F.col(f"m{j}_0")) / F.sqrt(F.col(f"c{j}_00")))

    emission = [(below(j, -1.0), below(j, 1.0) - below(j, -1.0), 1.0 - below(j, 1.0)) for j in range(3)]

    def mixed(values):
        return sum((s * v for s, v in zip(state[1:], values[1:])), state[0] * values[0])

    return df.select(
        KEY, ORDER, *[f"next_{n}" for n in ("lo", "mid", "hi")],
        *[mixed([emission[j][o] for j in range(3)]).alias(f"next_obs_{n}") for o, n in enumerate(("down", "flat", "up"))],
        (mixed([F.col(f"m{j}_0") for j in range(3)]) * F.col("ret_s") + F.col("ret_m")).alias("next_ret"),
        (mixed([F.col(f"m{j}_1") for j in range(3)]) * F.col("vol_s") + F.col("vol_m")).alias("next_vol"))


def normal_cdf(z):
    """Abramowitz and Stegun 26.2.17, absolute error below 7.5e-8."""
    # The approximation's coefficients.
    coefs = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1.0 / (1.0 + 0.2316419 * F.abs(z))
    poly = sum((F.lit(c) * F.pow(t, F.lit(float(i))) for i, c in enumerate(coefs[1:], 2)), F.lit(coefs[0]) * t)
    tail = F.exp(-0.5 * z * z) / math.sqrt(2.0 * math.pi) * poly
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)
