"""The registry of features: what the matrix holds, in which order, and who builds it.

A feature names its family, its leakage class (``E`` engineered from rows up to its date,
``TF`` fitted on the train partition and applied frozen), its lookback (a value needs at
least so many own rows; -1 all earlier rows, 0 the date alone, None where it is not in own rows) and its builder.
The matrix is built from this table and has its columns in this order.
"""

from dataclasses import dataclass
from typing import Optional

from pyspark.sql import DataFrame, SparkSession

from ..operators import macro
from ..operators.price import Z_TWIN_COLUMNS
from .queries_macro import ALL as MACRO_SERIES

META = ("date", "instrument", "partition", "fe_train_end_date")


@dataclass(frozen=True)
class Feature:
    name: str
    family: str
    leakage: str
    lookback: Optional[int]
    builder: str


FEATURES: dict[str, Feature] = {}


def register_feature(name, family, leakage, lookback, builder) -> None:
    if name in FEATURES:
        raise ValueError(f"{name} is registered already")
    FEATURES[name] = Feature(name, family, leakage, lookback, builder)


def register(family, builder, leakage="E", **lookbacks):
    for name, lookback in lookbacks.items():
        register_feature(name, family, leakage, lookback, builder)


ALL_ROWS = -1
for n in (10, 20, 40):
    register("F1", "f1", **{f"f1_mr_score_{n}": 2 * n - 1, f"f1_dist_ma_sigma_{n}": 2 * n - 1,
                            f"f1_ret_reversal_{n}": n + 1, f"f1_hilo_pos_{n}": n})
register("F1", "f1", f1_rsi_14=15, f1_bb_pctb_20=20, f1_bb_bandwidth_20=20)
register("F2", "f2", f2_vol_10=11, f2_vol_20=21, f2_vol_60=61, f2_vol_ratio_20_60=61, f2_vol_pctile_20=272, f2_vol_of_vol_20=80,
         f2_parkinson_20=20, f2_garman_klass_20=20, f2_rogers_satchell_20=20, f2_atr_14=14, f2_ret_skew_60=61, f2_ret_kurt_60=61)
register("F6", "f6", f6_ts_momentum_20=21, f6_ts_momentum_60=61, f6_ma_cross_20_60=60, f6_macd_12_26=26,
         f6_macd_hist_12_26_9=34, f6_adx_14=27, f6_donchian_pos_20=21)
register("F7", "f7", f7_volume_z_20=20, f7_volume_trend_20=20, f7_oi_level=1, f7_oi_change=2, f7_oi_z_20=20,
         f7_oi_price_div_20=21, f7_amihud_20=2, amihud_illiquidity=21, f7_rolls_spread_20=22, f7_kyles_lambda_20=21, f7_overnight_gap=2)
register("F10", "f10", f10_hl_range=1, f10_hl_range_mean_20=20, f10_oto_ret=2, f10_oto_ret_mean_20=21)
register("F5", "f5", f5_signal=1, f5_abs_signal=1, f5_trailing_run_length=ALL_ROWS, f5_days_since_flip=ALL_ROWS,
         f5_days_since_nonzero=ALL_ROWS, f5_participation_20=20, f5_participation_60=60, f5_long_bias_20=20,
         f5_signal_entropy_20=20, f5_flip_rate_60=60, f5_sign_agree_mr=39, signal_cum_pnl_20d=20)
register("F8", "f8", f8_dow_sin=0, f8_dow_cos=0, f8_month_sin=0, f8_month_cos=0)
register("F9", "f9_rank", f9_xsect_rank=21, f9_xsection_universe_size=0)
register("F9", "f9_pair", f9_pair_corr_mean=None)
register("F9", "f9_centroid", f9_dist_lead_lag_centroid=None)
register("F9", "f9_dispersion", f9_asset_class_dispersion_z=None)
register("F9", "f9_implied", f9_ewma_implied_corr_z=None)
register("F12", "f12", f12_autocorr_21=22, f12_efficiency_ratio_21=22, f12_variance_ratio_5_21=22, f12_ma21_slope=22,
         f12_trend_tval_10=10, f12_trend_tval_21=21, f12_trend_tval_42=42)
register("F12", "f12_hurst", f12_hurst_100=101)
register("F13", "f13", **{f"f13_mra_energy_d{k}": 253 for k in range(1, 6)})
register("F15", "f15", f15_path_tortuosity_20=21, f15_realized_semi_vol_ratio_20=20)
register("F15", "f15_passage", f15_expected_hit_time=None, f15_prob_timeout=None)
register("F3", "f3_gmm", "TF", f3_gmm_prob_highvol=21)
register("F3", "f3_markov", "TF", f3_markov_prob_highvol=ALL_ROWS, f3_markov_switch_prob=ALL_ROWS, f3_regime_dwell=ALL_ROWS)
register("F17", "f17", "TF", f17_hmm_state_lo=ALL_ROWS, f17_hmm_state_mid=ALL_ROWS, f17_hmm_state_hi=ALL_ROWS, f17_hmm_state_argmax=ALL_ROWS)
register("F4", "f4", "TF", **{f"f4_pc{k}": None for k in range(1, 5)}, f4_recon_error=None)
register("F4", "f4_cluster", "TF", f4_cluster_id=None, f4_cluster_dist=None)
for name in MACRO_SERIES:
    register("F11", "f11", "TF", **{f"f11_{macro.slug(name)}_{c}": None for c in ("level", "chg_short", "chg_long")})
register("F16", "f16", "TF", f16_regime_alignment_score=ALL_ROWS)
for name in Z_TWIN_COLUMNS:
    register(FEATURES[name].family, "z", **{f"z_{name}": ALL_ROWS})

# The stacked builders share one merge per (instrument, date); the latent fits read the
# engineered columns of the core families.
CORE = [f.name for f in FEATURES.values() if f.family in ("F1", "F2", "F5", "F6", "F7", "F8", "F10") and f.builder != "z"
        and f.name not in ("f2_rogers_satchell_20", "f5_signal_entropy_20", "f5_flip_rate_60", "signal_cum_pnl_20d", "f7_rolls_spread_20",
                           "f7_kyles_lambda_20", "f7_overnight_gap", "amihud_illiquidity")]
LIGHT = ("f1", "f2", "f5", "f6", "f7", "f8", "f9_rank", "f9_pair", "f10", "f12", "f15")


def names(builders=None) -> list:
    return [f.name for f in FEATURES.values() if builders is None or f.builder in builders]


def table(spark: SparkSession, builders=None) -> DataFrame:
    """The registry as rows (position, name, family, leakage, lookback, builder)."""
    rows = [(k, f.name, f.family, f.leakage, f.lookback, f.builder) for k, f in enumerate(FEATURES.values(), 1)
            if builders is None or f.builder in builders]
    return spark.createDataFrame(rows, "position int, name string, family string, leakage string, lookback int, builder string")


def assert_coverage(columns, builders=None) -> None:
    """Exactly the registered columns, in the order of the registry."""
    have, want = [c for c in columns if c not in META + ("asset_class",)], names(builders)
    missing, extra = [c for c in want if c not in have], [c for c in have if c not in want]
    if missing or extra:
        raise ValueError(f"columns without a registered feature: {extra}; features without a column: {missing}")
    if have != want:
        raise ValueError("columns are not in the order of the registry")
