"""Fit on the train partition, apply frozen: the feature-matrix builder."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions.windows import KEY, ORDER
from ..operators import (latent, price, regimes, risk, signal, splits, xsection)
from ..sources.store import checkpointed

ROW = [KEY, ORDER]
LATENT_INPUTS = ("f1_mr_score_20", "f2_vol_20", "f6_ts_momentum_20", "f7_volume_z_20",
                 "f10_hl_range", "f12_efficiency_ratio_21")


def engineered(panel: DataFrame, heavy=True) -> dict:
    """Every causal family as (instrument, date, columns), keyed by family name."""
    rets = xsection.class_returns(panel)
    f1 = price.counter_trend(panel)
    scored = panel.join(f1.select(*ROW, "f1_mr_score_20"), ROW)
    out = {
        "f1": f1, "f2": price.volatility(panel),
        "f5": signal.signal_features(scored, "f1_mr_score_20"),
        "f6": price.momentum(panel), "f7": price.microstructure(panel),
        "f8": price.calendar_cycle(panel), "f9_rank": xsection.xsect_rank(panel),
        "f9_pair": xsection.pair_corr_mean(rets), "f10": price.price_action(panel),
        "f12": price.path_structure(panel), "f15": risk.path_shape(panel),
    }
    if heavy:
        out.update({"f9_centroid": xsection.lead_lag_centroid(rets),
                    "f9_dispersion": xsection.class_dispersion_z(rets),
                    "f9_implied": xsection.implied_corr_z(rets), "f12_hurst": risk.hurst(panel),
                    "f13": risk.wavelet_energy(panel), "f15_passage": risk.first_passage(panel)})
    return out


def stack(families: dict) -> DataFrame:
    """Full outer join of all families in one shuffle: the frames are stacked with
    NULL for absent columns and merged per (instrument, date)."""
    frames = list(families.values())
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    cols = [c for c in out.columns if c not in ROW]
    return out.groupBy(*ROW).agg(*[F.max(c).alias(c) for c in cols])


@dataclass
class FeatureBuilder:
    """``fit`` fixes the train end; ``transform`` applies every family.

    Fitted families only see rows up to ``train_end``; all later rows use their
    frozen tables.
    """

    rounds: int = 5
    heavy: bool = True
    train_end: object = None
    meta: dict = field(default_factory=dict)

    def fit(self, panel: DataFrame) -> "FeatureBuilder":
        sig = panel.filter("s IS NOT NULL")
        split = splits.chronological_split(sig)
        self.train_end = split.filter("partition = 'train'").agg(F.max(ORDER)).first()[0]
        self.meta = {"fe_train_end_date": str(self.train_end), "rounds": self.rounds}
        return self

    def transform(self, panel: DataFrame) -> DataFrame:
        end = F.lit(self.train_end).cast("date")
        families = engineered(panel, self.heavy)
        if self.heavy:
            families["f3_gmm"] = regimes.gmm_high_vol(panel, end, rounds=self.rounds)
            families["f3_markov"] = regimes.markov_regime(panel, end, rounds=self.rounds)
            families["f17"] = regimes.hmm_states(panel, end, rounds=self.rounds)[0]
        base = price.z_twins(stack(families))
        if self.heavy:
            rows = checkpointed(base.join(panel.select(*ROW, "asset_class", "s"), ROW))
            active = rows.filter("s <> 0").select(KEY, "asset_class", ORDER, *LATENT_INPUTS)
            train = active.filter(F.col(ORDER) <= end)
            base = rows.drop("asset_class", "s")
            parts = [latent.latent_components(active, train, LATENT_INPUTS).drop("asset_class"),
                     latent.cluster_ids(active, train, LATENT_INPUTS, rounds=self.rounds),
                     latent.drift_score(base.select(*ROW, *LATENT_INPUTS), LATENT_INPUTS, end)]
            for p in parts:
                base = base.join(p, ROW, "left")
        meta = splits.partition_meta(panel.filter("s IS NOT NULL").select(
            KEY, "asset_class", ORDER, "s"))
        return meta.drop("s").join(base, ROW)


def assert_coverage(matrix: DataFrame, expected) -> None:
    """1:1 check of produced and registered feature columns."""
    have = set(matrix.columns) - {KEY, ORDER, "asset_class", "partition", "fe_train_end_date"}
    missing, extra = sorted(set(expected) - have), sorted(have - set(expected))
    assert not missing and not extra, f"missing {missing}, extra {extra}"
