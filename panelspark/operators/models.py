"""Classifiers, validation and importances with pyspark.ml."""

from pyspark.ml import Pipeline
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from . import stats
from ..functions.windows import KEY, ORDER
from ..sources.store import checkpointed

SEED = 42


def classifiers(n_features: int) -> dict:
    """Fixed hyper-parameters of the four model families."""
    return {
        "random_forest": RandomForestClassifier(numTrees=20, maxDepth=5, seed=SEED, weightCol="weight"),
        "boosted_trees": GBTClassifier(maxIter=5, maxDepth=3, seed=SEED, weightCol="weight"),
        "logistic": LogisticRegression(maxIter=20, regParam=0.01, weightCol="weight"),
        "mlp": MultilayerPerceptronClassifier(layers=[n_features, 8, 2], maxIter=30, seed=SEED),
    }


def fit(train: DataFrame, features, model):
    """Assemble, scale on the train rows only, and fit."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="raw"),
              StandardScaler(inputCol="raw", outputCol="features", withMean=True), model]
    return Pipeline(stages=stages).fit(train)


def predictions(model, rows: DataFrame) -> DataFrame:
    """M8: (instrument, date, prediction) with the probability of class 1."""
    p = vector_to_array("probability")[1]
    return model.transform(rows).select(*rows.columns, p.alias("prediction"))


def metrics(scored: DataFrame, by=()) -> DataFrame:
    """Accuracy, precision, recall, F1 and AUC of scored rows per group."""
    c = stats.classification_metrics(scored, "label", "prediction", by)
    a = stats.auc(scored, "label", "prediction", by)
    return c.join(a, list(by))


def compare_models(rows: DataFrame, features) -> DataFrame:
    """M1: train and test metrics of every model (rows carry ``part``)."""
    train = rows.filter("part = 'train'")
    out = None
    for name, est in classifiers(len(features)).items():
        scored = predictions(fit(train, features, est), rows).withColumn("model", F.lit(name))
        out = scored if out is None else out.unionByName(scored)
    return metrics(out, ("model", "part"))


def forward_chaining_search(rows: DataFrame, features, grid, k=5) -> DataFrame:
    """M2: every draw of the search over k forward-chaining splits by date fold.

    ``rows`` carry ``fold`` 0..k; split i trains on folds <= i, tests on fold i+1.
    """
    out = None
    for d, (reg, alpha) in enumerate(grid):
        for i in range(k):
            est = LogisticRegression(maxIter=20, regParam=reg, elasticNetParam=alpha)
            m = fit(rows.filter(F.col("fold") <= i), features, est)
            s = predictions(m, rows.filter(F.col("fold") == i + 1)).select(
                "label", "prediction", F.lit(d).alias("draw"), F.lit(i).alias("split"),
                F.lit(float(reg)).alias("reg"), F.lit(float(alpha)).alias("alpha"))
            out = s if out is None else out.unionByName(s)
    by = ("draw", "reg", "alpha", "split")
    return (stats.auc(out, "label", "prediction", by).groupBy("draw", "reg", "alpha")
            .agg(F.count("*").alias("n_splits"), F.avg("auc").alias("mean_auc"),
                 F.stddev_samp("auc").alias("sd_auc")))


def impurity_importance(model, features, spark, top=None) -> DataFrame:
    """Impurity importances, largest first (one row per feature)."""
    imp = model.stages[-1].featureImportances.toArray()
    df = spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)],
                               "feature string, importance double")
    df = df.orderBy(F.desc("importance"), "feature")
    return df.limit(top) if top else df


def global_rank(x: DataFrame, by, salt: str, ident, out: str) -> DataFrame:
    """Rank of every row among those of equal ``by``, in hash order, over all tasks.

    The hash order is cut at its leading 12 bits; counts per cut (at most 4096 per
    ``by``) give each cut's first rank, and a window ranks the rows inside a cut.
    """
    x = x.withColumn("_h", F.xxhash64(*ident, F.lit(salt)))
    x = x.withColumn("_cut", F.shiftrightunsigned("_h", 52))
    cuts = x.groupBy(*by, "_cut").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*by).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.withColumn("_first", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inside = Window.partitionBy(*by, "_cut").orderBy("_h", *ident)
    return (x.withColumn("_in", F.row_number().over(inside)).join(cuts, [*by, "_cut"])
            .withColumn(out, F.col("_first") + F.col("_in")).drop("_h", "_cut", "_first", "_in"))


def permuted(rows: DataFrame, groups: dict, repeats: int) -> DataFrame:
    """Rows times (group, repeat) with the group's columns taken from another row.

    One permutation of all rows per (group, repeat): the row of each rank by one hash
    receives the columns of the row of equal rank by a second hash, whatever the number
    of rows or tasks. Columns of one group share the donor row.
    """
    cols = sorted({c for g in groups.values() for c in g})
    conf = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(r).alias("rep"))
                     for g in groups for r in range(repeats)])
    x = rows.withColumn("_c", F.explode(conf)).select("*", "_c.grp", "_c.rep").drop("_c")
    ident, by = [KEY, ORDER, "rep"], ["grp", "rep"]
    to = global_rank(x, by, "to", ident, "_k")
    give = global_rank(x.select(*ident, "grp", *cols), by, "from", ident, "_k").select(
        *by, "_k", *[F.col(c).alias(f"d_{c}") for c in cols])
    y = to.join(give, [*by, "_k"])
    for c in cols:
        owners = [g for g, cs in groups.items() if c in cs]
        y = y.withColumn(c, F.when(F.col("grp").isin(owners), F.col(f"d_{c}")).otherwise(F.col(c)))
    return y.drop("_k", *[f"d_{c}" for c in cols])


def permutation_importance(model, rows: DataFrame, groups: dict, repeats=10) -> DataFrame:
    """M4 (one column per group) and M6 (a cluster per group): AUC drop, mean and sd,
    and the relative log-loss change."""
    def log_loss():
        p = F.greatest(F.least(F.col("prediction"), F.lit(1 - 1e-9)), F.lit(1e-9))
        return -F.avg(F.when(F.col("label") == 1, F.ln(p)).otherwise(F.ln(1 - p)))

    base = predictions(model, rows).withColumn("one", F.lit(1))
    b = stats.auc(base, "label", "prediction", ("one",)).join(
        base.groupBy("one").agg(log_loss().alias("base_ll")), "one").withColumnRenamed("auc", "base_auc")
    shuf = predictions(model, permuted(rows, groups, repeats))
    s = stats.auc(shuf, "label", "prediction", ("grp", "rep")).join(
        shuf.groupBy("grp", "rep").agg(log_loss().alias("ll")), ["grp", "rep"])
    s = s.withColumn("one", F.lit(1)).join(F.broadcast(b), "one")        # one base row
    return s.groupBy("grp").agg(
        F.avg(F.col("base_auc") - F.col("auc")).alias("auc_drop"),
        F.stddev_samp(F.col("base_auc") - F.col("auc")).alias("auc_drop_sd"),
        F.avg((F.col("ll") - F.col("base_ll")) / F.col("ll")).alias("logloss_importance"))


def cluster_importance(imp: DataFrame, clusters: DataFrame) -> DataFrame:
    """M5: impurity importances summed within clusters, normalised to one."""
    g = imp.join(clusters, "feature").groupBy("group_id").agg(
        F.sum("importance").alias("importance"), F.count("*").alias("n_features"))
    return g.withColumn("_t", F.sum("importance").over(Window.partitionBy(F.lit(1)))).select(
        "group_id", "n_features", F.try_divide(F.col("importance"), F.col("_t")).alias("importance"))


def distance_rows(corr: DataFrame, features) -> DataFrame:
    """One row per feature with its distance 1 - |corr| to every feature."""
    both = corr.select(F.explode(F.array(*[
        F.struct(F.col(x).alias("feature"), F.col(y).alias("other"))
        for x, y in (("a", "b"), ("b", "a"))])).alias("p"), (1 - F.abs("corr")).alias("d"))
    w = both.select("p.*", "d").groupBy("feature").pivot("other", list(features)).agg(F.first("d"))
    return w.fillna(0.0)


def feature_clusters(corr: DataFrame, features, ks=(2, 3, 4)) -> DataFrame:
    """M7: principal components of the distance rows, k-means with k chosen by
    silhouette, and soft membership from a Gaussian mixture."""
    # one row per feature: cut the lineage so the many small fits do not rescan the panel
    dist = checkpointed(distance_rows(corr, features).coalesce(1))
    rows = VectorAssembler(inputCols=list(features), outputCol="raw").transform(dist)
    pcs = PCA(k=2, inputCol="raw", outputCol="features").fit(rows).transform(rows)
    pcs = pcs.select("feature", "features")
    ev = ClusteringEvaluator()
    fits = []
    for k in ks:
        d = KMeans(k=k, seed=SEED).fit(pcs).transform(pcs)
        fits.append((ev.evaluate(d), k, d))
    score, k, best = max(fits, key=lambda t: (t[0], -t[1]))
    soft = GaussianMixture(k=k, seed=SEED, probabilityCol="soft", predictionCol="gm").fit(
        pcs).transform(pcs)
    return best.select("feature", F.col("prediction").alias("group_id")).join(
        soft.select("feature", F.array_max(vector_to_array("soft")).alias("membership")), "feature"
    ).withColumns({"k": F.lit(k), "silhouette": F.lit(float(score))})
