"""Fits to a tolerance, Gram matrices, medians, clusters, and frozen bundles."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from panelspark.operators import em, gram, latent
from panelspark.plans import bundle as U, catalog
from panelspark.sources import bars as B
from panelspark.sources.store import checkpointed, panel


def plain_smoothing(pi, a, e):
    """Forward and backward passes row by row, in logarithms."""
    def lse(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    n, k = e.shape
    la, le = np.log(a), np.log(e)
    f, b = np.zeros((n, k)), np.zeros((n, k))
    f[0] = np.log(pi) + le[0]
    for t in range(1, n):
        f[t] = le[t] + lse(f[t - 1][:, None] + la, 0)
    for t in range(n - 2, -1, -1):
        b[t] = lse(la + le[t + 1] + b[t + 1], 1)
    ll = lse(f[-1], 0)
    moves = sum(np.exp(f[t][:, None] + la + le[t + 1] + b[t + 1] - ll) for t in range(n - 1))
    return np.exp(f + b - ll), moves, ll


def regime_series(n=600, seed=0):
    rng = np.random.default_rng(seed)
    state = np.cumsum(rng.random(n) < 0.03) % 2
    ret = rng.normal(0, np.where(state, 2.0, 0.5))
    return np.column_stack([ret, np.where(state, 1.0, -1.0) + rng.normal(0, 0.6, n)]), state


@pytest.mark.parametrize("n", [1, 2, 3, 57, 400])
def test_smoothing_by_matrix_products(n):
    rng = np.random.default_rng(n)
    pi, a = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3)
    e = rng.random((n, 3)) + 1e-3
    got, want = em.smoothed(pi, a, e), plain_smoothing(pi, a, e)
    for x, y in zip(got, want):
        assert np.allclose(x, y, atol=1e-9)


def test_fits_stop_at_a_fixed_point():
    x, state = regime_series()
    w, mean, cov, ll, rounds = em.mixture(x, em.quantile_groups(x[:, 1], 2))
    assert 2 < rounds < em.MAX_ROUNDS
    g, after = em.softened(np.log(w) + em.log_density(x, mean, cov))
    w2, mean2, cov2 = em.moments(x, g)
    assert abs(after.mean() - ll) < em.TOL
    assert np.allclose(w, w2, atol=1e-3) and np.allclose(mean, mean2, atol=1e-2)
    pi, a, w, mean, cov, ll, rounds = em.hidden_chain(x, em.quantile_groups(x[:, 1], 2))
    assert rounds < em.MAX_ROUNDS and np.allclose(a.sum(axis=1), 1.0)
    logp = em.log_density(x, mean, cov)
    top = logp.max(axis=1, keepdims=True)
    g, _, again = em.smoothed(pi, a, np.exp(logp - top))
    assert abs((again + top.sum()) / len(x) - ll) < 2 * em.TOL
    assert (g.argmax(axis=1) == state).mean() > 0.95
    likelihoods = [em.hidden_chain(x, em.quantile_groups(x[:, 1], 2), max_rounds=r)[5] for r in (1, 2, 4, 8)]
    assert likelihoods == sorted(likelihoods)


def test_gram_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(1e4, 1.0, (900, 30)) @ np.diag(rng.random(30) + 0.1)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 3], x[:, 4] = 5.0, np.nan
    x[300:, 5] = np.nan
    names = [f"c{i}" for i in range(30)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5)
    got = {(r.a, r.b): (r["corr"], r.n_pairs) for r in gram.correlation(df, names).collect()}
    assert len(got) == 30 * 29 // 2
    for i in range(30):
        for j in range(i + 1, 30):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            corr, n = got[names[i], names[j]]
            assert n == both.sum()
            if n < 252 or 3 in (i, j):
                assert corr is None
            else:
                assert corr == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    assert gram.correlation(df.limit(0), names).filter("corr is not null").count() == 0


def test_medians_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = []
    for cls, n in (("a", 1), ("b", 2), ("c", 20_001), ("d", 30_000)):
        for _ in range(n):
            rows.append((cls, float(rng.integers(-3, 4)), float(rng.lognormal()), None if rng.random() < 0.4 else float(rng.normal()), None))
    got = latent.medians(spark.createDataFrame(rows, "asset_class string, x double, y double, z double, e double"), ["x", "y", "z", "e"])
    for r in got.collect():
        mine = [q for q in rows if q[0] == r.asset_class]
        for k, c in enumerate("xyz", 1):
            v = [q[k] for q in mine if q[k] is not None]
            assert r[f"{c}_med"] == pytest.approx(np.median(v) if v else 0.0, abs=1e-12)
        assert r.e_med == 0.0


def test_clusters_are_the_best_of_converged_starts(spark):
    rng = np.random.default_rng(5)
    rows, points = [], {}
    for cls in ("p", "q"):
        spots = rng.normal(0, 6, (4, 3))
        points[cls] = np.concatenate([s + rng.normal(0, 1, (150, 3)) for s in spots])
        rows += [(f"{cls}{i % 7}", cls, dt.date(2000, 1, 1) + dt.timedelta(days=i), *map(float, v)) for i, v in enumerate(points[cls])]
    df = spark.createDataFrame(rows, "instrument string, asset_class string, date date, a double, b double, c double").repartition(4)
    cols = ["a", "b", "c"]
    table = checkpointed(latent.fit_clusters(df, cols))
    for r in table.collect():
        x = points[r.asset_class]
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        centres = np.array(r.cs)
        d = ((z[:, None] - centres) ** 2).sum(axis=2)
        again = np.array([z[d.argmin(axis=1) == i].mean(axis=0) for i in range(4)])
        assert np.allclose(again, centres, atol=1e-8)          # one more round changes nothing
        assert r.inertia == pytest.approx(d.min(axis=1).sum(), rel=1e-9)
        best = np.inf
        for _ in range(30):
            c = z[rng.choice(len(z), 4, replace=False)]
            for _ in range(50):
                near = ((z[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
                c = np.array([z[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(4)])
            best = min(best, ((z[:, None] - c) ** 2).sum(axis=2).min(axis=1).sum())
        assert r.inertia <= 1.02 * best
    got = latent.apply_clusters(df, table, cols)
    assert got.count() == len(rows) and got.select("f4_cluster_id").distinct().count() == 4


def test_registry():
    assert sum(f.family == "F11" for f in catalog.FEATURES.values()) == 45
    with pytest.raises(ValueError, match="registered already"):
        catalog.register_feature("f8_dow_sin", "F8", "E", 0, "f8")
    names = catalog.names()
    catalog.assert_coverage([*catalog.META, *names])
    with pytest.raises(ValueError, match="without a registered"):
        catalog.assert_coverage([*names, "odd"])
    with pytest.raises(ValueError, match="without a column"):
        catalog.assert_coverage(names[1:])
    with pytest.raises(ValueError, match="order"):
        catalog.assert_coverage(names[::-1])


def test_bundle_is_frozen_and_lookbacks_hold(spark, sf, tmp_path):
    """Scoring an extended panel leaves the earlier rows as they were."""
    cut = "2000-06-01"
    p, observations = checkpointed(panel(spark, sf)), checkpointed(B.macro_obs(spark, sf))
    early, known = checkpointed(p.filter(F.col("date") <= cut)), observations.filter(F.col("stamp") <= cut)
    merged = U.merged_families(p)
    b = U.Bundle(spark, str(tmp_path / "bundle")).fit(early, known, starts=2)
    before, after = b.apply(early, known), b.apply(p, observations, merged=merged)
    assert after.columns == [*catalog.META, *catalog.names()]

    def norm(df):
        return df.filter(F.col("date") <= cut).select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])

    before, after = checkpointed(norm(before)), checkpointed(after)
    assert before.count() > 1000 and after.filter("partition = ''").count() > 0
    assert before.exceptAll(norm(after)).isEmpty() and norm(after).exceptAll(before).isEmpty()
    w = merged.withColumn("pos", F.row_number().over(Window.partitionBy("instrument").orderBy("date")))
    have = [f for f in catalog.FEATURES.values() if f.name in merged.columns and f.lookback and f.lookback > 0]
    first = w.agg(*[F.min(F.when(F.col(f.name).isNotNull(), F.col("pos"))).alias(f.name) for f in have]).first()
    assert not [(f.name, f.lookback, first[f.name]) for f in have if first[f.name] is not None and first[f.name] < f.lookback]


def test_a_column_constant_where_another_is_present_has_no_correlation(spark):
    """It varies elsewhere, so its mean over all rows is not its value there."""
    rng = np.random.default_rng(6)
    n, sizes = 20_000, [25.0, 3.3, 7.7, 0.1, 1234.56, 19.9]
    names = ["x", "late", "far"] + [f"size{k}" for k in range(len(sizes))]
    x = rng.normal(0, 1, n)
    rows = [(float(a), float(a) ** 2 if i >= 50 else None, 1e6 + float(a) * 1e-6, *[v if i >= 50 else float(i % 7) for v in sizes])
            for i, a in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(7)
    got = {(r.a, r.b): (r["corr"], r.n_pairs) for r in gram.correlation(df, names).collect()}
    for k in range(len(sizes)):
        assert got["late", f"size{k}"] == (None, n - 50)
        assert got["x", f"size{k}"][0] is not None and got["x", f"size{k}"][1] == n
    assert got["x", "far"][0] == pytest.approx(1.0, abs=1e-6)
