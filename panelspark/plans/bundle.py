"""Fit once, apply frozen. A bundle is a folder of parameter tables.

``fit`` writes everything that later rows may depend on: the split of the signal dates and
the train end, mixture, Markov and hidden-state parameters per instrument, medians, scales,
axes and centres per class, the macro standardisation, and the registry of features. ``apply``
reads the panel, the macro observations and these tables and nothing else that was fitted, so
scoring an extended panel leaves the rows of earlier dates as they were.
"""

from pyspark.sql import DataFrame, functions as F

from ..functions.joins import with_scalars
from ..functions.windows import KEY, ORDER
from ..operators import latent, macro, price, regimes, splits
from ..sources.store import checkpointed
from . import catalog
from .features import ROW, engineered, stack
from .queries_macro import ALL, COLS as MACRO_COLS, SPREADS

TABLES = ("split", "gmm", "markov", "hmm", "components", "clusters", "macro", "registry")


def trade_dates(panel: DataFrame) -> DataFrame:
    return panel.filter("s <> 0").select(ORDER).distinct()


def macro_wide(panel: DataFrame, observations: DataFrame) -> DataFrame:
    """The 45 unscaled F11 columns on the dates that are traded."""
    days = trade_dates(panel)
    applied = macro.applied_panel(macro.recover_cadence(observations), days)
    return macro.macro_wide(macro.macro_features(macro.with_spreads(applied, SPREADS), days), ALL)


def core_block(panel: DataFrame, merged: DataFrame) -> DataFrame:
    """The latent inputs of the rows with a signal other than zero."""
    rows = panel.filter("s <> 0").select(*ROW, "asset_class")
    return merged.select(*ROW, *[F.col(c).cast("double").alias(c) for c in catalog.CORE]).join(rows, ROW)


def merged_families(panel: DataFrame, heavy=True) -> DataFrame:
    """All engineered families on one row per (instrument, date), written once."""
    return checkpointed(stack(engineered(panel, heavy)))


class Bundle:
    """The tables under ``path``."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def put(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")

    @property
    def train_end(self):
        return self.table("split").filter("partition = 'train'").agg(F.max(ORDER)).first()[0]

    def fit_regimes(self, panel: DataFrame) -> "Bundle":
        """The split and the tables that need the bars only."""
        sig = panel.filter("s IS NOT NULL")
        self.put("split", splits.chronological_split(sig).select(ORDER, "partition"))
        end = F.lit(self.train_end).cast("date")
        self.put("gmm", regimes.fit_gmm(panel, end))
        self.put("markov", regimes.fit_markov(panel, end))
        self.put("hmm", regimes.fit_hmm(panel, end))
        return self

    def fit(self, panel: DataFrame, observations: DataFrame, starts=10, merged: DataFrame = None) -> "Bundle":
        end = F.lit(self.fit_regimes(panel).train_end).cast("date")
        merged = merged_families(panel) if merged is None else merged
        train = checkpointed(core_block(panel, merged).filter(F.col(ORDER) <= end))
        self.put("components", latent.fit_components(train, catalog.CORE))
        self.put("clusters", latent.fit_clusters(train, catalog.CORE, starts=starts))
        wide = macro_wide(panel, observations)
        self.put("macro", macro.frozen_stats(wide, MACRO_COLS, F.col(ORDER) <= end))
        self.put("registry", catalog.table(self.spark))
        return self

    def apply(self, panel: DataFrame, observations: DataFrame, merged: DataFrame = None) -> DataFrame:
        """The matrix: rows with a signal, all registered features, in the registry's order."""
        end = F.lit(self.train_end).cast("date")
        merged = merged_families(panel) if merged is None else merged
        core = core_block(panel, merged)
        base = price.z_twins(merged)
        for part in (regimes.apply_gmm(panel, self.table("gmm")), regimes.apply_markov(panel, self.table("markov")),
                     regimes.apply_hmm(panel, self.table("hmm")),
                     latent.apply_components(core, self.table("components"), catalog.CORE).drop("asset_class"),
                     latent.apply_clusters(core, self.table("clusters"), catalog.CORE),
                     latent.drift_score(merged.select(*ROW, *DRIFT), DRIFT, end)):
            base = base.join(part, ROW, "left")
        scaled = macro.frozen_zscore(macro_wide(panel, observations), self.table("macro"), MACRO_COLS)
        base = base.join(F.broadcast(scaled), ORDER, "left")       # one row per calendar date
        rows = self.rows(panel)
        ends = self.table("split").filter("partition = 'train'").agg(F.max(ORDER).alias("fe_train_end_date"))
        matrix = with_scalars(rows, ends).join(base, ROW).select(*catalog.META, *catalog.names())
        catalog.assert_coverage(matrix.columns)
        return matrix


    def rows(self, panel: DataFrame) -> DataFrame:
        """(instrument, date, partition) of the rows with a signal; a date after the split has an empty partition."""
        split = F.broadcast(self.table("split"))        # one row per calendar date
        return panel.filter("s <> 0").select(*ROW).join(split, ORDER, "left").withColumn("partition", F.coalesce("partition", F.lit("")))


# the drift discriminator reads engineered columns that most rows have
DRIFT = ["f1_hilo_pos_20", "f1_ret_reversal_10", "f1_bb_bandwidth_20", "f2_vol_10", "f2_vol_20", "f2_parkinson_20", "f2_atr_14",
         "f6_ts_momentum_20", "f6_donchian_pos_20", "f7_volume_trend_20", "f10_hl_range", "f10_hl_range_mean_20", "f10_oto_ret"]


def redundancy(corr: DataFrame, names, threshold=0.70) -> DataFrame:
    """feature, group_id, group_size, max_corr_partner, max_abs_corr."""
    from ..operators import stats
    features = corr.sparkSession.createDataFrame([(n,) for n in names], "feature string")
    corr = checkpointed(corr)
    return stats.redundancy_groups(corr, features, threshold).join(stats.max_partner(corr), "feature", "left")


def provenance(rows: DataFrame, bundle: Bundle) -> DataFrame:
    """(scope, member, n_rows, first_date, last_date, detail) of the split, the rows and the regime fits."""
    def bounds(df, scope, member):
        return df.groupBy(F.lit(scope).alias("scope"), F.col(member).alias("member")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.min(ORDER).alias("first_date"), F.max(ORDER).alias("last_date")).withColumn("detail", F.lit(""))

    def fits(name):
        detail = F.to_json(F.struct("n_train", F.round("loglik", 4).alias("loglik"), "rounds"))
        return bundle.table(name).select(F.lit(name).alias("scope"), F.col(KEY).alias("member"), F.lit(None).cast("bigint").alias("n_rows"),
                                         F.lit(None).cast("date").alias("first_date"), F.lit(None).cast("date").alias("last_date"), detail.alias("detail"))

    out = bounds(bundle.table("split"), "split", "partition")
    for scope in ("partition", KEY):
        out = out.unionByName(bounds(rows, scope, scope))
    for name in ("gmm", "markov", "hmm"):
        out = out.unionByName(fits(name))
    return out
