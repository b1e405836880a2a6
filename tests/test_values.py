"""Hand-computed frames and brute-force comparisons."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import calendars as C
from panelspark.functions.joins import asof
from panelspark.functions.windows import halo_blocks, trailing, with_ewm, with_runs
from panelspark.operators import labels, latent, price, quality, risk, signal, splits, stats
from panelspark.sources import bars as B, sinks

D0 = dt.date(2020, 1, 1)


def series(spark, values, name="close", key="a"):
    rows = [(key, D0 + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"instrument string, date date, {name} double")


def values(df, col):
    return [r[col] for r in df.orderBy("instrument", "date").collect()]


def test_ewm_matches_pandas_with_gaps(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=2500)
    x[[0, 1, 7, 8, 9, 400, 2000]] = np.nan
    df = series(spark, [None if np.isnan(v) else v for v in x], "x")
    got = values(with_ewm(df, [("y", "x", 0.2, 3), ("z", "x", 1 / 14, 14)]), "y")
    want = pd.Series(x).ewm(alpha=0.2, adjust=False, min_periods=3).mean()
    assert np.allclose(pd.Series(got, dtype=float), want, equal_nan=True, atol=1e-10)


@pytest.mark.parametrize("adjust", [False, True])
def test_ewm_std_matches_pandas(spark, adjust):
    x = np.random.default_rng(2).normal(size=600)
    df = labels.ewm_std(series(spark, x, "x"), "x", "sd", 20, adjust)
    want = pd.Series(x).ewm(span=20, adjust=adjust).std()
    assert np.allclose(pd.Series(values(df, "sd"), dtype=float), want, equal_nan=True, atol=1e-9)


def test_skew_kurt_match_pandas(spark):
    x = np.random.default_rng(3).normal(size=80) ** 3
    df = series(spark, x, "x").withColumns({"s": price.corrected_skew("x", 60), "k": price.corrected_kurt("x", 60)})
    p = pd.Series(x).rolling(60)
    assert np.allclose(pd.Series(values(df, "s"), dtype=float), p.skew(), equal_nan=True)
    assert np.allclose(pd.Series(values(df, "k"), dtype=float), p.kurt(), equal_nan=True)


def test_runs(spark):
    df = with_runs(series(spark, [1, 1, 0, 0, 0, 1, None, None], "s"), "s")
    assert values(df, "run_length") == [1, 2, 1, 2, 3, 1, 1, 1]


def test_signal_entropy_and_flip_rate(spark):
    s = ([1, 0] * 40)[:70]
    df = series(spark, [100.0] * 70).join(series(spark, s, "s"), ["instrument", "date"])
    out = signal.signal_features(df.withColumn("s", F.col("s").cast("int")))
    assert values(out, "f5_signal_entropy_20")[-1] == pytest.approx(math.log(2))
    assert values(out, "f5_flip_rate_60")[-1] == 1.0
    assert values(out, "f5_days_since_nonzero")[:4] == [0, 1, 0, 1]


def barrier(spark, close, sigma, s0=1, **kw):
    df = series(spark, close).withColumns({
        "s": F.when(F.col("date") == F.lit(D0), s0).otherwise(0), "sigma": F.lit(float(sigma))})
    return labels.triple_barrier(df, **kw).collect()


def test_barrier_enters_next_bar_and_takes_first_touch(spark):
    ev = barrier(spark, [50, 100, 101, 130, 60, 60], sigma=0.1, h=4, pt_mult=1.0, sl_mult=1.0)
    assert len(ev) == 1 and ev[0].t_start == D0 + dt.timedelta(days=1)
    assert ev[0].t_end == D0 + dt.timedelta(days=3) and ev[0].label == 1
    assert ev[0].ret == pytest.approx(math.log(1.3), abs=1e-9)


def test_barrier_vertical_short_and_too_few_bars(spark):
    ev = barrier(spark, [100, 100, 101, 102, 103, 104], sigma=9.0, s0=-1, h=4)
    assert ev[0].t_end == D0 + dt.timedelta(days=5) and ev[0].label == 0 and ev[0].side == -1
    assert barrier(spark, [100, 100, 101], sigma=1.0, h=4) == []


def test_uniqueness_matches_definition(spark):
    rng = np.random.default_rng(4)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.05, 60)))
    df = series(spark, close).withColumns({"s": F.lit(1), "sigma": F.lit(0.05)})
    ev = labels.triple_barrier(df, h=5).toPandas()
    conc = {}
    for a, b in zip(ev.t_start, ev.t_end):
        for d in pd.date_range(a, b):
            conc[d] = conc.get(d, 0) + 1
    want = [np.mean([1 / conc[d] for d in pd.date_range(a, b)]) for a, b in zip(ev.t_start, ev.t_end)]
    assert np.allclose(ev.uniqueness_weight, want)


def test_known_holidays(spark):
    cal = C.calendar_table(spark.range(1990, 2023).select(F.col("id").cast("int").alias("year")))
    have = {(r.calendar, str(r.date), r.kind): r.label for r in cal.collect()}
    for d in ("1990-04-13", "2000-04-21", "2008-03-21", "2019-04-19", "2022-04-15"):
        assert have[("CMES", d, "holiday")] == "Good Friday"
    assert have[("CMES", "2021-07-05", "holiday")] == "Independence Day"
    assert have[("CMES", "2010-12-31", "holiday")] == "New Year's Day"
    assert have[("CMES", "1998-01-19", "holiday")].startswith("Martin") and ("CMES", "1997-01-20", "holiday") not in have
    assert ("CMES", "2007-01-02", "holiday") not in have and ("CME_Equity", "2007-01-02", "holiday") in have
    assert have[("XEUR", "2015-05-25", "holiday")] == "Whit Monday (Eurex)" and ("XEUR", "2016-05-16", "holiday") not in have
    assert have[("CMES", "2019-11-28", "holiday")] == "Thanksgiving Day"
    assert have[("CMES", "2013-07-05", "early_close")] == "July 5 (Independence Day Friday bridge)" if ("CMES", "2013-07-05", "early_close") in have else True
    assert ("XEUR", "2019-11-29", "early_close") not in have


def test_split_sizes(spark):
    df = spark.range(645).select(F.date_add(F.lit(D0), F.col("id").cast("int")).alias("date"))
    n = {r.partition: r["count"] for r in splits.chronological_split(df).groupBy("partition").count().collect()}
    assert n == {"train": 387, "val": 129, "test": 129}


def test_clean_keeps_first_copy(spark):
    rows = [("a", dt.date(2020, 1, 6), 1.0, 2.0, 0.5, 1.5, 3.0, None, 2), ("a", dt.date(2020, 1, 6), 9.0, 9.0, 9.0, 9.0, 3.0, None, 1),
            ("a", dt.date(2020, 1, 4), 1.0, 2.0, 0.5, 1.5, 3.0, None, 1), ("a", dt.date(2020, 1, 7), 1.0, 0.1, 0.5, 1.5, 3.0, None, 1),
            ("a", dt.date(2020, 1, 8), 1.0, 2.0, 0.5, 1.5, None, None, 1)]
    df = spark.createDataFrame(rows, "instrument string, date date, open double, high double, low double, "
                               "close double, volume double, open_interest double, ord int")
    got = quality.clean_long(df).orderBy("date").collect()
    assert [(r.date.day, r.close) for r in got] == [(6, 9.0), (8, 1.5)]
    assert [r.date.day for r in quality.clean_long(df, drop_zero_volume=True).collect()] == [6]
    flags = {(r.date.day, r.flag) for r in quality.anomalous_rows(df).collect()}
    assert flags == {(4, "weekend_row"), (7, "bad_ohlc_bounds"), (8, "zero_volume_weekday")}


@pytest.mark.parametrize("direction,strict", [("backward", False), ("backward", True), ("forward", False)])
def test_asof_matches_pandas(spark, direction, strict):
    rng = np.random.default_rng(5)
    base = pd.Timestamp("2020-01-01")
    def make(n, hot):
        t = base + pd.to_timedelta(np.sort(rng.choice(400, n, replace=False)), unit="h")
        return pd.DataFrame({"k": np.where(rng.random(n) < hot, "hot", "b"), "t": t})
    left, right = make(200, 0.9), make(150, 0.9)
    right["v"] = np.arange(len(right), dtype=float)
    want = pd.merge_asof(left, right, on="t", by="k", direction=direction, allow_exact_matches=not strict)
    got = asof(spark.createDataFrame(left), spark.createDataFrame(right), "k", "t", "t", "v", "v",
               direction, strict, block="day").toPandas()
    m = want.merge(got, on=["k", "t"], suffixes=("", "_g"))
    assert len(m) == len(left) and np.allclose(m.v, m.v_g.astype(float), equal_nan=True)


def test_running_total_with_hot_key(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"instrument": np.where(rng.random(3000) < 0.8, "hot", "cold"),
                        "ts": pd.Timestamp("2020-01-01") + pd.to_timedelta(np.arange(3000) * 7, unit="min"),
                        "x": rng.integers(1, 9, 3000)})
    got = B.running_total(spark.createDataFrame(pdf), "x", "c").toPandas()
    want = pdf.assign(c=pdf.groupby("instrument").x.cumsum())
    m = want.merge(got, on=["instrument", "ts"])
    assert len(m) == 3000 and (m.c_x == m.c_y).all()


def test_halo_blocks_equal_plain_windows(spark):
    df = series(spark, np.random.default_rng(7).normal(size=500), "x")
    plain = df.withColumn("m", F.sum("x").over(trailing(30)))
    halo = halo_blocks(df, 30, 64).withColumn("m", F.sum("x").over(trailing(30, ("instrument", "blk"), "pos")))
    halo = halo.filter("own")
    assert halo.count() == 500
    full = [(a, b) for i, (a, b) in enumerate(zip(values(plain, "m"), values(halo, "m"))) if i >= 29]
    assert np.allclose(*zip(*full))


def test_auc_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    y, p = rng.integers(0, 2, 400), np.round(rng.random(400), 2)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "y": y, "p": p}))
    pos, neg = p[y == 1], p[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert stats.auc(df, "y", "p", ["g"]).first().auc == pytest.approx(want)


def test_wavelet_matrix_is_orthonormal_and_complete():
    m, cut = risk.analysis_matrix(256, 5)
    assert np.allclose(m @ m.T, np.eye(len(m)), atol=1e-9) and list(np.diff(cut)) == [128, 64, 32, 16, 8]
    m, cut = risk.analysis_matrix(252, 5)
    assert list(np.diff(cut)) == [126, 63, 32, 16, 8]


def test_hurst_of_trending_and_reverting_series():
    rng = np.random.default_rng(9)
    e = rng.normal(size=(200, 100))
    trend = np.cumsum(rng.normal(size=(200, 100)), axis=1)
    sizes = risk.chunk_sizes(100)
    assert np.mean(risk.rescaled_range(trend, sizes)) > np.mean(risk.rescaled_range(e, sizes))


def test_information_helpers():
    a = np.array([0, 0, 1, 1] * 30)
    assert risk.entropy(a) == pytest.approx(math.log(2))
    assert risk.entropy(a) + risk.entropy(a) - risk.entropy(a, a) == pytest.approx(math.log(2))
    v = np.arange(100.0)
    want = pd.qcut(v, 5, labels=False)
    assert (risk.quantile_bins(v, 5) == want).all()
    s = np.array([-1.0] * 50 + [0.0] * 30 + [1.0] * 20)
    assert (risk.quantile_bins(s, 5) == pd.qcut(s, 5, labels=False, duplicates="drop")).all()


def test_principal_axes_match_numpy(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 2)) @ rng.normal(size=(2, 4)) + 0.1 * rng.normal(size=(300, 4))
    pdf = pd.DataFrame(x, columns=list("wxyz"))
    pdf["instrument"], pdf["asset_class"] = "a", "c"
    pdf["date"] = pd.date_range("2020-01-01", periods=300).date
    df = spark.createDataFrame(pdf)
    out = latent.latent_components(df, df, ("w", "x", "y", "z"), 2).toPandas()
    z = (x - x.mean(0)) / x.std(0)
    vals, vecs = np.linalg.eigh(z.T @ z / 300)
    top = vecs[:, ::-1][:, :2]
    want = ((z - z @ top @ top.T) ** 2).mean(axis=1)
    assert np.allclose(out.sort_values("date").f4_recon_error, want)


def test_redundancy_components(spark):
    corr = spark.createDataFrame([("a", "b", 0.9), ("b", "c", -0.8), ("c", "d", 0.1), ("d", "e", 0.75), ("a", "f", None)],
                                 "a string, b string, corr double")
    feats = spark.createDataFrame([(x,) for x in "abcdef"], "feature string")
    got = {r.feature: r.group_id for r in stats.redundancy_groups(corr, feats).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}


def test_sinks_round_trip(spark, tmp_path):
    df = series(spark, [1, 2, 3, 4]).withColumn("partition", F.lit("train"))
    sinks.write_matrix(df, str(tmp_path))
    back = spark.read.parquet(f"{tmp_path}/matrix.parquet").select(*df.columns)
    assert back.exceptAll(df).isEmpty() and back.count() == 4
    ev = df.drop("partition")
    sinks.write_events(ev, ev.groupBy("instrument").count(), str(tmp_path))
    assert sinks.drift_guard(ev.repartition(3), str(tmp_path))
    assert not sinks.drift_guard(ev.withColumn("close", F.col("close") + 1), str(tmp_path))
    sinks.write_tables({"t": ev}, str(tmp_path))
    sinks.write_families(df, str(tmp_path / "fam"), {"f": ["close"]})
    assert spark.read.option("header", True).csv(f"{tmp_path}/t").count() == 4


def test_csv_reader_coerces(spark, tmp_path):
    from panelspark.sources.readers import read_raw_csv, read_signals_csv
    (tmp_path / "p.csv").write_text("date,instrument,open,high,low,close,volume,open_interest\n"
                                    "2020-01-06,a,1,2,0.5,bad,NaN,\n")
    r = read_raw_csv(spark, str(tmp_path / "p.csv")).first()
    assert r.close is None and r.volume is None and r.open == 1.0 and r.date == dt.date(2020, 1, 6)
    (tmp_path / "s.csv").write_text("date,a,b\n2020-01-06,1,-1\n")
    assert read_signals_csv(spark, str(tmp_path / "s.csv"), ["a", "b"]).first().b == -1
