"""Truncation invariance: a value at date t may use rows up to t only."""

import pytest
from pyspark.sql import functions as F

from panelspark.operators import labels, macro, regimes
from panelspark.plans.features import engineered
from panelspark.sources import bars as B
from panelspark.sources.store import checkpointed, panel

CUT = "2000-06-01"
FAMILIES = ("f1", "f2", "f5", "f6", "f7", "f9_rank", "f9_pair", "f9_centroid", "f9_dispersion",
            "f10", "f12", "f12_hurst", "f13", "f15", "f15_passage")


def mismatch(full, part):
    """Rows up to the cut whose rounded values differ."""
    def norm(df):
        return df.filter(F.col("date") <= CUT).select(
            *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in sorted(df.dtypes)])
    a, b = norm(full), norm(part)
    return a.exceptAll(b).count() + b.exceptAll(a).count()


@pytest.fixture(scope="module")
def frames(spark, sf):
    p = checkpointed(panel(spark, sf))
    return engineered(p), engineered(checkpointed(p.filter(F.col("date") <= CUT)))


@pytest.mark.parametrize("family", FAMILIES)
def test_family(frames, family):
    full, part = frames
    assert full[family].filter(F.col("date") <= CUT).count() > 100
    assert mismatch(full[family], part[family]) == 0


def test_label_vol(spark, sf):
    p = panel(spark, sf)
    f = labels.label_vol(p).select("instrument", "date", "sigma")
    g = labels.label_vol(p.filter(F.col("date") <= CUT)).select("instrument", "date", "sigma")
    assert mismatch(f, g) == 0


def test_filter_with_frozen_fit(spark, sf):
    """The fit is held fixed (train end before the cut); only the applied side is cut."""
    p = panel(spark, sf)
    end = F.lit("2000-01-01").cast("date")
    f = regimes.markov_regime(p, end, rounds=2)
    g = regimes.markov_regime(p.filter(F.col("date") <= CUT), end, rounds=2)
    assert f.count() > 100 and mismatch(f, g) == 0


def test_macro_point_in_time(spark, sf):
    td = panel(spark, sf).filter("s <> 0").select("date").distinct()
    obs = macro.recover_cadence(B.macro_obs(spark, sf))
    full = macro.applied_panel(obs, td)
    known = macro.with_availability(obs).filter(F.col("available") <= CUT).drop("available")
    part = macro.applied_panel(known, td.filter(F.col("date") <= CUT))
    first = td.agg(F.date_sub(F.min("date"), 200)).first()[0]
    assert mismatch(full.filter(F.col("date") >= F.lit(first)), part) == 0


def test_regimes_are_probabilities(spark, sf):
    p = panel(spark, sf)
    st, _ = regimes.hmm_states(p, F.lit("2000-01-01").cast("date"), rounds=2)
    tot = F.col("f17_hmm_state_lo") + F.col("f17_hmm_state_mid") + F.col("f17_hmm_state_hi")
    assert st.count() > 100
    assert st.filter((F.abs(tot - 1) > 1e-9) | (F.col("f17_hmm_state_lo") < 0)).count() == 0


def test_partition_count_does_not_change_results(spark, sf):
    from panelspark.operators import price
    from panelspark.sources.sinks import fingerprint
    p = panel(spark, sf)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    a = fingerprint(price.momentum(p.repartition(3))).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = fingerprint(price.momentum(p.repartition(5))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b
