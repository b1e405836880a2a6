"""Values and shapes beyond those of the test tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions.calendars import last_weekday, nth_weekday
from panelspark.functions.joins import asof
from panelspark.operators import labels as L, models as M, risk, xsection as X
from panelspark.plans.queries_splits import columns_of
from panelspark.sources import bars as B

TICK = ("instrument string, asset_class string, date date, px double, qty double, l_linestatus string, "
        "l_orderkey bigint, l_linenumber int, l_partkey bigint")
DAY = dt.date(2000, 1, 3)


def day_bar(spark, ticks):
    rows = [("A", "C", DAY, px, 1.0, "O", o, n, p) for o, n, p, px in ticks]
    return B.daily_bars(spark.createDataFrame(rows, TICK))


@pytest.mark.parametrize("first, last", [
    ((1, 1, 7, 12_000_000.0), (2, 1, 7, 1.0)), ((1, 1, 7, 10.126), (2, 1, 7, 10.124)), ((1, 1, 7, -3.0), (2, 1, 7, -5.5)),
    ((1, 1, 5_000_000_000, 2.0), (1, 2, 3, 1.0)), ((1, 1, 20_000_000_000, 2.0), (1, 2, 3, 1.0)),
    ((600_000_000_000, 1, 9, 2.0), (600_000_000_000, 7, 1, 1.0)), ((1, 1, 7, -2.5), (1, 1, 7, 2.5)),
    ((1, 1, 7, 104_949.50), (1, 1, 7, 104_949.51)), ((1, 1, 8, 0.0), (1, 1, 9, -1e15))])
def test_open_and_close_at_any_price_and_key(spark, first, last):
    r = day_bar(spark, [last, first]).first()
    assert (r.open, r.close) == (first[3], last[3])


def test_order_key_is_guarded_and_hash_aggregated(spark):
    with pytest.raises(Exception, match="l_partkey is outside"):
        day_bar(spark, [(1, 1, 10 ** 12, 1.0), (2, 1, 1, 1.0)]).collect()
    plan = day_bar(spark, [(1, 1, 1, 1.0)])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_tied_times_keep_event_order(spark):
    t = dt.datetime(2000, 1, 3, 10)
    ev = spark.createDataFrame([("A", t, i, float(i)) for i in (3, 1, 2)], "instrument string, ts timestamp, event_id bigint, px double")
    r = B.time_bars(ev).first()
    assert (r.open, r.close) == (1.0, 3.0)
    got = {r.event_id: r.c for r in B.running_total(ev, "event_id", "c").collect()}
    assert got == {1: 1, 2: 3, 3: 6}


def test_asof_keeps_probes_without_key_or_time(spark):
    left = spark.createDataFrame([("a", 5, 1), (None, 5, 2), ("a", None, 3), ("b", 5, 4)], "k string, d int, id int")
    left = left.withColumn("t", F.date_add(F.lit("2000-01-01").cast("date"), F.col("d")))
    right = spark.createDataFrame([("a", 1, 1.0), ("a", 9, 2.0), (None, 1, 3.0)], "k string, d int, v double")
    right = right.select("k", F.date_add(F.lit("2000-01-01").cast("date"), F.col("d")).alias("u"), "v")
    for direction, want in (("backward", 1.0), ("forward", 2.0)):
        got = {r.id: r.x for r in asof(left, right, "k", "t", "u", "v", "x", direction).collect()}
        assert got == {1: want, 2: None, 3: None, 4: None}


def test_entropy_with_many_bins():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 10, 5000), rng.integers(0, 10, 5000)
    p = np.histogram2d(a, b, bins=10)[0].ravel() / 5000
    assert abs(risk.entropy(a, b) + (p[p > 0] * np.log(p[p > 0])).sum()) < 1e-12


def test_chunk_sizes_by_their_rule():
    assert risk.chunk_sizes(100) == [8, 12, 20, 31, 50]
    for n in (16, 40, 252, 1000):
        s = risk.chunk_sizes(n)
        assert s[0] == 8 and s[-1] == n // 2 and s == sorted(set(s))
    assert risk.chunk_sizes(14) == []


def test_weekday_rules(spark):
    years = spark.range(1990, 2031).select(F.col("id").cast("int").alias("y"))
    y = F.col("y")
    for r in years.select("y", nth_weekday(y, 9, "Mon", 1).alias("a"), nth_weekday(y, 11, "Thu", 4).alias("b"),
                          last_weekday(y, 5, "Mon").alias("c")).collect():
        days = lambda m, wd: [d for k in range(1, 32) if (d := dt.date(r.y, m, 1) + dt.timedelta(k - 1)).month == m and d.weekday() == wd]
        assert (r.a, r.b, r.c) == (days(9, 0)[0], days(11, 3)[3], days(5, 0)[-1])


@pytest.mark.parametrize("slope, tval", [(1.0, 20.0), (-0.1, -20.0), (0.0, None)])
def test_trend_scan_of_straight_lines(spark, slope, tval):
    rows = [("A", DAY + dt.timedelta(i), 1e6 + slope * i) for i in range(60)]
    df = spark.createDataFrame(rows, "instrument string, date date, close double")
    for forward in (True, False):
        got = L.trend_scan(df, forward=forward).collect()
        assert {(r.t_val, r.window_size) for r in got} == (set() if tval is None else {(tval, 5)})
        assert tval is None or len(got) >= 40


def test_a_twenty_sixth_instrument_gets_its_column(spark):
    df = spark.createDataFrame([(f"NATION_{i}",) for i in range(26)] + [("ODD",)], "instrument string")
    assert {"NATION_25", "ODD"} <= set(columns_of(df))


def test_rows_without_a_peer_stay(spark):
    rows = [("A", "X", DAY + dt.timedelta(i), 0.1 * i) for i in range(5)]
    df = spark.createDataFrame(rows, "instrument string, asset_class string, date date, ret double")
    assert [r.f9_pair_corr_mean for r in X.pair_corr_mean(df).collect()] == [None] * 5


def test_permutation_is_global_at_any_size(spark):
    """10,000 rows: every donor is used once per (group, repeat) and rows move far."""
    n = 10_000
    df = spark.range(n).select(F.lit("A").alias("instrument"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("date"),
                               F.col("id").cast("double").alias("x"))
    got = M.permuted(df.withColumn("y", F.col("x")), {"g": ["x"]}, 2)
    for rep in range(2):
        rows = got.filter(f"rep = {rep}").select("x", "y").collect()
        assert sorted(r.x for r in rows) == list(map(float, range(n)))
        assert abs(np.corrcoef([r.x for r in rows], [r.y for r in rows])[0, 1]) < 0.05


def test_size_estimates_stay_flat_over_the_rounds_of_a_loop(spark):
    """A loop that joins its state with itself plans each round with the size of the files."""
    from panelspark.sources.store import checkpointed
    state = checkpointed(spark.range(50).select("id", (F.col("id") * 7 % 50).alias("next")))
    bits = []
    for _ in range(30):
        step = state.select(F.col("id").alias("next"), F.col("next").alias("then"))
        state = checkpointed(state.join(step, "next").select("id", F.col("then").alias("next")))
        bits.append(state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bitLength())
    assert max(bits) - min(bits) <= 4
    assert state.count() == 50


def test_partner_means_equal_pairs_in_pandas(spark):
    """Tiles of instruments give the means of all pairs, over gaps, short series and equal returns."""
    rng, rows = np.random.default_rng(5), []
    days = pd.date_range("2020-01-01", periods=150)
    for k in range(14):
        for d in days[rng.random(150) > (0.1 if k else 0.8)][: 20 if k == 1 else None]:
            rows.append((f"i{k:02d}", f"c{k % 3}", d.date(), 0.01 if k == 2 else float(rng.normal(0, 0.02))))
    rows += [("alone", "own", d.date(), float(rng.normal())) for d in days]
    df = spark.createDataFrame(rows, "instrument string, asset_class string, date date, ret double")
    wide = pd.DataFrame(rows, columns=["i", "g", "d", "r"])
    group = dict(zip(wide.i, wide.g))
    wide = wide.pivot(index="d", columns="i", values="r")

    def partner_mean(corr, same):
        out = {}
        for a in wide:
            cs = [corr(wide[a], wide[b]) for b in wide if a != b and (not same or group[a] == group[b])]
            out[a] = pd.concat(cs, axis=1).mean(axis=1) if cs else pd.Series(np.nan, wide.index)
        return pd.DataFrame(out)

    def ewm(x, y):
        ok = x.notna() & y.notna()
        mean = [v.where(ok).ewm(alpha=1 - 0.5 ** (1 / 20), adjust=False).mean() for v in (x, y, x * x, y * y, x * y)]
        vx, vy = mean[2] - mean[0] ** 2, mean[3] - mean[1] ** 2
        return ((mean[4] - mean[0] * mean[1]) / np.sqrt(vx * vy)).where((vx > 1e-18) & (vy > 1e-18))

    def rolling(x, y):
        both = pd.concat([x, y], axis=1).dropna()
        return both.iloc[:, 0].rolling(30).corr(both.iloc[:, 1]).replace([np.inf, -np.inf], np.nan).reindex(x.index)

    def check(frame, name, want):
        got = frame.toPandas().pivot(index="date", columns="instrument", values=name)
        want = want.where(wide.notna()).reindex(columns=got.columns, index=got.index)
        assert got.notna().to_numpy().sum() > 500
        np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), rtol=1e-7, atol=1e-9)

    want = partner_mean(rolling, True)
    want.loc[:, "i02"] = np.nan             # a constant series has no correlation ...
    others = [c for c in wide if group[c] == group["i02"] and c != "i02"]
    for a in others:                        # ... and is no partner
        cs = [rolling(wide[a], wide[b]) for b in others if b != a]
        want[a] = pd.concat(cs, axis=1).mean(axis=1)
    check(X.pair_corr_mean(df, 30), "f9_pair_corr_mean", want)
    for same in (False, True):
        m = partner_mean(ewm, same)
        z = (m - m.rolling(40).mean()) / m.rolling(40).std(ddof=0)
        z = z.drop(columns="alone") if same else z
        check(X.implied_corr_z(df, n=40, within_class=same), "f9_ewma_implied_corr_z", z)
    assert X.implied_corr_z(df.limit(0)).count() == 0 and X.pair_corr_mean(df.limit(0)).count() == 0


def no_gaps(spark):
    return spark.createDataFrame([], "date date, category string, scope string")


def test_scope_counts_of_a_panel_without_gaps(spark):
    """A rollup of no rows still has its grand total, as in SQL."""
    from panelspark.operators.quality import category_scope_counts
    assert [tuple(r) for r in category_scope_counts(no_gaps(spark)).collect()] == [("ALL", "ALL", 0)]
    some = spark.createDataFrame([("glitch", "mixed"), ("glitch", "global")], "category string, scope string")
    assert {tuple(r) for r in category_scope_counts(some).collect()} == {
        ("ALL", "ALL", 2), ("glitch", "ALL", 2), ("glitch", "mixed", 1), ("glitch", "global", 1)}


def test_diagnostic_tables_of_a_panel_without_gaps(spark, tmp_path):
    """The stored scope counts have their line of the grand total, the other tables are empty."""
    from panelspark.operators import quality as Q
    from panelspark.sources import sinks as S
    tables = {"classified": no_gaps(spark), "scope_counts": Q.category_scope_counts(no_gaps(spark))}
    S.write_tables(tables, str(tmp_path))
    assert [tuple(r) for r in S.read_tables(spark, tables, str(tmp_path)).collect()] == [("scope_counts", "ALL|0|ALL")]


def test_panel_has_no_more_buckets_than_instruments(spark, sf, tmp_path):
    """Shuffle partitions are set for ticks; a bucketed scan would keep a task for each of them."""
    import shutil

    from panelspark.operators import price
    from panelspark.sources.store import panel
    for name in ("lineitem", "supplier", "nation", "region"):
        shutil.copy(f"{sf}/{name}.parquet", tmp_path)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        p, keys = panel(spark, str(tmp_path)), B.instruments(spark, str(tmp_path)).count()
        family = price.price_action(p)
        assert family.rdd.getNumPartitions() <= keys
        assert "Exchange" not in family._jdf.queryExecution().executedPlan().toString()
        assert family.count() == B.bars(spark, str(tmp_path)).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
