"""Model training and importances on labelled panel rows."""

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import labels as L, models as M, splits as S, stats as T
from ..sources.store import checkpointed, panel
from .queries_stats import BLOCK, block
from .registry import query

FEATURES = ("ret", "hl", "oto", "lv", "mom5", "sd10")
GRID = ((0.001, 0.0), (0.1, 0.0), (0.01, 0.5))


def rows(spark, sf):
    """Labelled events with features, uniqueness weight, split part and date fold."""
    p = panel(spark, sf)
    ev = L.triple_barrier(L.label_vol(p)).select(
        "instrument", F.col("t_signal").alias("date"), "label",
        F.col("uniqueness_weight").alias("weight"))
    split = F.broadcast(S.chronological_split(p).select(
        "date", F.when(F.col("partition") == "train", "train").otherwise("test").alias("part")))
    folds = F.broadcast(S.kfold_dates(p, 6).select("date", "fold"))
    df = block(spark, sf).select("instrument", "date", *FEATURES).dropna()
    return checkpointed(df.join(ev, ["instrument", "date"]).join(split, "date").join(folds, "date"))


def forest(df):
    est = RandomForestClassifier(numTrees=20, maxDepth=5, seed=M.SEED, weightCol="weight")
    return M.fit(df.filter("part = 'train'"), FEATURES, est)


@query("model_metrics", "M1")
def model_metrics(spark, sf):
    return rounded(M.compare_models(rows(spark, sf), FEATURES), 4)


@query("forward_chaining_search", "M2")
def forward_chaining_search(spark, sf):
    return rounded(M.forward_chaining_search(rows(spark, sf), FEATURES, GRID), 4)


@query("impurity_importance", "M3 T3")
def impurity_importance(spark, sf):
    return M.impurity_importance(forest(rows(spark, sf)), FEATURES, spark, top=5)


@query("permutation_importance", "M4")
def permutation_importance(spark, sf):
    df = rows(spark, sf)
    return M.permutation_importance(forest(df), df.filter("part = 'test'"), {f: [f] for f in FEATURES}, 5)


def groups(spark, sf, df):
    corr = T.column_corr(df, FEATURES)
    return M.feature_clusters(corr, FEATURES)


@query("feature_clusters", "M7")
def feature_clusters(spark, sf):
    return rounded(groups(spark, sf, block(spark, sf)), 4)


@query("cluster_importance", "M5")
def cluster_importance(spark, sf):
    df = rows(spark, sf)
    imp = M.impurity_importance(forest(df), FEATURES, spark)
    return rounded(M.cluster_importance(imp, groups(spark, sf, df)))


@query("cluster_permutation_importance", "M6")
def cluster_permutation_importance(spark, sf):
    df = rows(spark, sf)
    named = {}
    for r in groups(spark, sf, df).select("feature", "group_id").collect():   # one row per feature
        named.setdefault(f"group_{r.group_id}", []).append(r.feature)
    return M.permutation_importance(forest(df), df.filter("part = 'test'"), named, 5)


@query("meta_predictions", "M8")
def meta_predictions(spark, sf):
    df = rows(spark, sf)
    scored = M.predictions(forest(df), df.filter("part = 'test'"))
    return rounded(scored.select("instrument", "date", "prediction"))
