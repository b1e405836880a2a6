"""class-pooled scaler, principal components and clusters; F16 drift score.

Classes are fitted together: the covariance of a class is one grouped aggregate,
and only its p x p table reaches the eigen-solver.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.windows import KEY, ORDER, ordered
from ..sources.store import checkpointed
from . import gram
from .regimes import small

CLS = "asset_class"


def medians(train: DataFrame, cols) -> DataFrame:
    """Exact train median per class and column; all-NULL -> 0.

    No buffer holds a column: a quantile sketch brackets the middle (its rank error is
    n / 10,000, the bracket twice as wide), values below the bracket are counted, and only
    those inside it are ordered.
    """
    long = train.select(CLS, *cols).unpivot(CLS, list(cols), "col", "v").filter("v IS NOT NULL")
    on = [CLS, "col"]
    cuts = long.groupBy(*on).agg(F.count("*").alias("n"), F.percentile_approx(
        "v", F.array(F.lit(0.4997), F.lit(0.5003)), F.lit(10_000)).alias("cut"))
    marked = long.join(cuts, on)
    values = marked.groupBy(*on, F.when(F.col("v") < F.col("cut")[0], None).when(F.col("v") <= F.col("cut")[1], F.col("v"))
                            .otherwise(F.lit(float("inf"))).alias("v")).agg(F.count("*").alias("k"), F.first("n").alias("n"))
    # the values below the bracket are one NULL row that comes first
    upto = F.sum("k").over(Window.partitionBy(*on).orderBy(F.col("v").asc_nulls_first()))
    ranked = values.withColumn("upto", upto)

    def at(rank):
        return F.min(F.when(F.col("upto") > rank, F.col("v")))

    middle = ranked.groupBy(*on).agg(at(F.floor((F.col("n") - 1) / 2)).alias("lo"), at(F.ceil((F.col("n") - 1) / 2)).alias("hi"))
    wide = middle.groupBy(CLS).pivot("col", list(cols)).agg(F.first((F.col("lo") + F.col("hi")) / 2))
    wide = train.select(CLS).distinct().join(wide, CLS, "left")
    return wide.select(CLS, *[F.coalesce(F.col(c), F.lit(0.0)).alias(f"{c}_med") for c in cols])


def fit_scale(train: DataFrame, cols) -> DataFrame:
    """One row per class: the train median of every column, and mean and sd after filling."""
    med = checkpointed(medians(train, cols))
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_m"),
                 F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0).alias(f"{c}_s")]
    return checkpointed(med.join(filled(train, med, cols).groupBy(CLS).agg(*aggs), CLS))


def filled(x: DataFrame, table: DataFrame, cols) -> DataFrame:
    x = x.join(small(table, table.count()), CLS)
    return x.withColumns({c: F.coalesce(F.col(c), F.col(f"{c}_med")) for c in cols}).drop(*[f"{c}_med" for c in cols])


def apply_scale(x: DataFrame, table: DataFrame, cols) -> DataFrame:
    """(instrument, class, date, z): filled and scaled columns as one array."""
    x = filled(x, table, cols)
    return x.select(KEY, CLS, ORDER, F.array(*[(F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s") for c in cols]).alias("z"))


def impute_scale(df: DataFrame, train: DataFrame, cols):
    """Fit medians and moments on ``train``; return (scaled df, scaled train)."""
    table = fit_scale(train, cols)
    return apply_scale(df, table, cols), apply_scale(train, table, cols)


def principal_axes(ztrain: DataFrame, p: int, k: int) -> DataFrame:
    """K6 fit: (class, axes, variance) with axes an array of k axes of length p."""
    names = [f"z{i}" for i in range(p)]
    cov = gram.covariance(ztrain.select(CLS, *[F.col("z")[i].alias(n) for i, n in enumerate(names)]), names, CLS)

    def eig(pdf: pd.DataFrame) -> pd.DataFrame:
        """One row in, one row out: the p x p table of one class."""
        m = np.zeros((p, p))
        i, j = np.triu_indices(p)
        m[i, j] = m[j, i] = pdf["c"].iloc[0]
        val, vec = np.linalg.eigh(m)
        order = np.argsort(val)[::-1][:k]
        axes = vec[:, order].T
        sign = np.sign(axes[np.arange(k), np.abs(axes).argmax(axis=1)])
        return pd.DataFrame({CLS: [pdf[CLS].iloc[0]], "axes": [list(map(list, axes * sign[:, None]))],
                             "variance": [list(val[order])]})

    return cov.groupBy(CLS).applyInPandas(
        eig, f"{CLS} string, axes array<array<double>>, variance array<double>")


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def fit_components(train: DataFrame, cols, k=4) -> DataFrame:
    """K6: one row per class: the scale table with the axes of the train rows."""
    table = fit_scale(train, cols)
    return table.join(principal_axes(apply_scale(train, table, cols), len(cols), k), CLS)


def apply_components(df: DataFrame, table: DataFrame, cols, k=4) -> DataFrame:
    """K6/K8: frozen component scores and the row's mean squared reconstruction error.

    The axes are orthonormal, so the error is (|z|^2 - |scores|^2) / p.
    """
    n = table.count()
    z = apply_scale(df, table.drop("axes", "variance"), cols)
    out = z.join(small(table.select(CLS, "axes"), n), CLS)
    out = out.withColumns({f"f4_pc{j + 1}": dot(F.col("z"), F.col("axes")[j]) for j in range(k)})
    err = dot(F.col("z"), F.col("z"))
    for j in range(k):
        err = err - F.col(f"f4_pc{j + 1}") * F.col(f"f4_pc{j + 1}")
    return out.select(KEY, CLS, ORDER, *[f"f4_pc{j + 1}" for j in range(k)],
                      (F.greatest(err, F.lit(0.0)) / len(cols)).alias("f4_recon_error"))


def latent_components(df: DataFrame, train: DataFrame, cols, k=4) -> DataFrame:
    """K6/K8 fitted and applied at once."""
    return apply_components(df, checkpointed(fit_components(train, cols, k)), cols, k)


def reconstruction_mse(scored: DataFrame, train_end) -> DataFrame:
    """K8: mean reconstruction error of the train rows per class."""
    return (scored.filter(F.col(ORDER) <= train_end).groupBy(CLS)
            .agg(F.count("*").alias("n_train"), F.avg("f4_recon_error").alias("recon_mse")))


def nearest(z, centres):
    """(squared distance, index) of the closest centre."""
    d = F.transform(centres, lambda c, i: F.struct(
        F.aggregate(F.zip_with(z, c, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                    lambda s, x: s + x).alias("d"), i.alias("i")))
    return F.array_min(d)


def cluster_ids(df: DataFrame, train: DataFrame, cols, k=4, rounds=8) -> DataFrame:
    """K7: Lloyd's k-means for all classes at once, started from the quantile
    groups of the first column; returns the frozen cluster id and distance."""
    z, zt = impute_scale(df, train, cols)
    zt = checkpointed(zt.select(CLS, "z"))
    p = len(cols)
    cuts = checkpointed(zt.groupBy(CLS).agg(F.percentile(F.col("z")[0], F.array(
        *[F.lit(i / k) for i in range(1, k)])).alias("cuts")))
    n = cuts.count()
    grp = zt.join(small(cuts, n), CLS).withColumn(
        "i", F.size(F.filter("cuts", lambda c: c < F.col("z")[0])))

    def centres(rows, previous=None):
        c = rows.groupBy(CLS, "i").agg(F.array(*[F.avg(F.col("z")[j]) for j in range(p)]).alias("c"))
        if previous is not None:          # a cluster that lost all rows keeps its centre
            old = previous.select(CLS, F.posexplode("cs").alias("i", "oc"))
            c = old.join(c, [CLS, "i"], "left").select(CLS, "i", F.coalesce("c", "oc").alias("c"))
        return checkpointed(c.groupBy(CLS).agg(F.transform(
            F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("cs")))  # k centres

    cs = centres(grp)
    for _ in range(rounds):
        hit = zt.join(small(cs, n), CLS).withColumn("i", nearest(F.col("z"), F.col("cs"))["i"])
        cs = centres(hit, cs)
    out = z.join(small(cs, n), CLS).withColumn("_n", nearest(F.col("z"), F.col("cs")))
    return out.select(KEY, ORDER, F.col("_n.i").alias("f4_cluster_id"),
                      F.sqrt("_n.d").alias("f4_cluster_dist"))


def fit_clusters(train: DataFrame, cols, k=4, starts=10, max_rounds=100) -> DataFrame:
    """K7: one row per class: the scale table and the best of ``starts`` converged centre sets.

    All starts of all classes share the scans. Seeds are drawn one after another with
    probability in proportion to the squared distance to the seeds so far, by an exponential
    race of hashed draws; Lloyd rounds go on for the starts whose centres still move. A task
    compares its batches with all centres by matrix products and emits sums; the driver
    holds classes * starts * k centres and no rows.
    """
    spark, p = train.sparkSession, len(cols)
    table = fit_scale(train, cols)
    z = checkpointed(apply_scale(train, table, cols).select(CLS, F.xxhash64(KEY, ORDER).alias("h"), "z"))
    classes = [r[0] for r in table.select(CLS).collect()]
    centres = {c: np.empty((starts, 0, p)) for c in classes}
    for step in range(k):
        shared = spark.sparkContext.broadcast(centres)
        won = z.mapInArrow(lambda bs: seed_races(bs, shared.value, step, starts), f"{CLS} string, start int, race double, z array<double>")
        centres = {c: np.concatenate([x, np.zeros((starts, 1, p))], axis=1) for c, x in centres.items()}
        for r in won.groupBy(CLS, "start").agg(F.min(F.struct("race", "z")).alias("w")).collect():
            centres[r[CLS]][r["start"], -1] = r["w"]["z"]
    inertia = {c: np.full(starts, np.inf) for c in classes}
    active = {c: np.arange(starts) for c in classes}
    for _ in range(max_rounds):
        shared = spark.sparkContext.broadcast({c: (a, centres[c][a]) for c, a in active.items() if len(a)})
        sums = z.mapInArrow(lambda bs: lloyd_sums(bs, shared.value), f"{CLS} string, start int, i int, j int, v double")
        new = {c: np.zeros((starts, k, p + 2)) for c in classes}
        for r in sums.groupBy(CLS, "start", "i", "j").agg(F.sum("v").alias("v")).collect():
            new[r[CLS]][r["start"], r["i"], r["j"]] = r["v"]
        for c, a in active.items():
            n = new[c][a, :, p]
            moved = np.where(n[..., None] > 0, new[c][a, :, :p] / np.maximum(n, 1)[..., None], centres[c][a])
            still = np.abs(moved - centres[c][a]).max(axis=(1, 2), initial=0.0) > 1e-9
            inertia[c][a] = new[c][a, :, p + 1].sum(axis=1)
            centres[c][a] = moved
            active[c] = a[still]
        if not any(len(a) for a in active.values()):
            break
    best = {c: int(inertia[c].argmin()) for c in classes}
    # centres are numbered by their coordinates, the first one first
    rows = [(c, sorted(map(list, centres[c][s].tolist())), float(inertia[c][s])) for c, s in best.items()]
    found = spark.createDataFrame(rows, f"{CLS} string, cs array<array<double>>, inertia double")
    return table.join(F.broadcast(found), CLS)      # one row per class


def class_blocks(batches):
    """(class, hashes, rows as a matrix) of each Arrow batch."""
    for b in batches:
        if not b.num_rows:
            continue
        names = np.array(b.column(CLS).to_pylist(), dtype=object)
        x = b.column("z").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        h = b.column("h").to_numpy(zero_copy_only=False).astype(np.uint64)
        for c in sorted(set(names.tolist())):
            own = names == c
            yield c, h[own], x[own]


def distances(x, centres):
    """Squared distances (rows, starts, centres)."""
    flat = centres.reshape(-1, x.shape[1])
    d = (x * x).sum(axis=1)[:, None] - 2.0 * x @ flat.T + (flat * flat).sum(axis=1)
    return np.maximum(d, 0.0).reshape(len(x), *centres.shape[:2])


def seed_races(batches, centres, step, starts):
    """A task's winner of each start's race: least draw from an exponential law of rate d^2."""
    import pyarrow as pa
    best = {}
    for c, h, x in class_blocks(batches):
        rate = distances(x, centres[c]).min(axis=2) if step else np.ones((len(x), starts))
        rate[rate < 1e-12] = 0.0
        for s in range(starts):
            with np.errstate(over="ignore", divide="ignore"):
                v = (h ^ np.uint64(step * 1_000_003 + s + 1)) * np.uint64(0x9E3779B97F4A7C15)
                v = (v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                race = -np.log(((v >> np.uint64(12)) + np.uint64(1)).astype(float) / float((1 << 52) + 2)) / rate[:, s]
            at = int(race.argmin())
            if (c, s) not in best or race[at] < best[c, s][0]:
                best[c, s] = (min(float(race[at]), 1e300), x[at].tolist())
    for (c, s), (race, row) in best.items():
        yield pa.RecordBatch.from_pydict({CLS: pa.array([c], pa.string()), "start": pa.array([s], pa.int32()), "race": [race], "z": [row]})


def lloyd_sums(batches, state):
    """A task's sums (class, start, centre, coordinate): the rows' coordinates, number and squared distance."""
    import pyarrow as pa
    sums = {}
    for c, _, x in class_blocks(batches):
        if c not in state:
            continue
        active, centres = state[c]
        d = distances(x, centres)
        near, ones = d.argmin(axis=2), np.ones((len(x), 1))
        for a, s in enumerate(active.tolist()):
            own = np.eye(centres.shape[1])[near[:, a]]
            add = own.T @ np.hstack([x, ones, d[:, a].min(axis=1)[:, None]])
            sums[c, s] = sums[c, s] + add if (c, s) in sums else add
    for (c, s), v in sums.items():
        i, j = np.indices(v.shape)
        yield pa.RecordBatch.from_pydict({CLS: pa.array([c] * v.size, pa.string()), "start": pa.array([s] * v.size, pa.int32()),
                                          "i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()), "v": v.ravel()})


def apply_clusters(df: DataFrame, table: DataFrame, cols) -> DataFrame:
    """Frozen cluster id and distance."""
    z = apply_scale(df, table.drop("cs", "inertia"), cols)
    out = z.join(small(table.select(CLS, "cs"), table.count()), CLS).withColumn("_n", nearest(F.col("z"), F.col("cs")))
    return out.select(KEY, ORDER, F.col("_n.i").alias("f4_cluster_id"), F.sqrt("_n.d").alias("f4_cluster_dist"))


# ---- drift ------------------------------------------------------------------------

def drift_score(df: DataFrame, cols, train_end, window=63, refit_every=21, min_recent=20) -> DataFrame:
    """Probability that a row belongs to the recent window, not the train era.

    Every ``refit_every`` rows after train_end + window a discriminator is formed
    from group means and pooled variances of the train rows and of the last
    ``window`` rows (closed form, Gaussian with shared diagonal variance), and
    scores the next rows. Each row joins the few refits it is recent for; all
    keys and refits are one job. Rows with a NULL feature are skipped and keep a
    NULL score. Prior: at most five train rows per recent row.
    """
    full = F.lit(True)
    for c in cols:
        full = full & F.col(c).isNotNull()
    df = df.withColumns({"pos": F.row_number().over(ordered()) - 1, "_ok": full})
    cut = df.groupBy(KEY).agg(F.count_if(F.col(ORDER) <= train_end).alias("cut"),
                              F.count("*").alias("n"))
    df = df.join(cut, KEY)
    start = F.col("cut") + window

    def moments(rows, keys, tag):
        aggs = [F.count("*").alias(f"{tag}_n")]
        for c in cols:
            aggs += [F.avg(c).alias(f"{tag}_{c}_m"), F.var_pop(c).alias(f"{tag}_{c}_v")]
        return rows.groupBy(*keys).agg(*aggs)

    train = moments(df.filter((F.col("pos") < F.col("cut")) & F.col("_ok")), [KEY], "t")
    # refit r sits at start + r*step and uses positions [refit - window, refit)
    lo = F.greatest(F.ceil((F.col("pos") + 1 - start) / refit_every), F.lit(0))
    hi = F.floor((F.col("pos") + window - start) / refit_every)
    last = F.floor((F.col("n") - 1 - start) / refit_every)
    recent = df.filter(F.col("_ok") & (hi >= lo) & (last >= lo)).withColumn(
        "refit", F.explode(F.sequence(lo, F.least(hi, F.greatest(last, lo)))))
    stats = moments(recent, [KEY, "refit"], "r").filter(F.col("r_n") >= min_recent)
    stats = stats.join(train.filter(F.col("t_n") >= min_recent), KEY)
    rows = df.filter((F.col("pos") >= start) & F.col("_ok")).withColumn(
        "refit", F.floor((F.col("pos") - start) / refit_every))
    scored = rows.join(stats, [KEY, "refit"])
    nt = F.least(F.col("t_n"), 5 * F.col("r_n"))
    logit = F.ln(F.col("r_n") / nt)
    for c in cols:
        pooled = (F.col(f"t_{c}_v") * nt + F.col(f"r_{c}_v") * F.col("r_n")) / (nt + F.col("r_n")) + 1e-12
        mid = (F.col(f"t_{c}_m") + F.col(f"r_{c}_m")) / 2
        logit = logit + (F.col(c) - mid) * (F.col(f"r_{c}_m") - F.col(f"t_{c}_m")) / pooled
    scored = scored.select(KEY, ORDER, (1.0 / (1.0 + F.exp(-logit))).alias("f16_regime_alignment_score"))
    return df.select(KEY, ORDER).join(scored, [KEY, ORDER], "left")
