"""The registered matrix from a frozen bundle, its registry, redundancy and provenance."""

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import gram
from ..sources import bars as B, sinks as S
from ..sources.store import panel
from . import bundle as U, catalog
from .queries_matrix import folder, light_matrix, line_sql, matrix_sql
from . import queries_splits  # noqa: F401 - the tables that the sinks write
from .registry import QUERIES, query
from .sqltext import r

LIGHT = catalog.names(catalog.LIGHT)
REGISTRY = "reg(position, name, family, leakage, lookback, builder) AS (VALUES " + ", ".join(
    f"({k}, '{f.name}', '{f.family}', '{f.leakage}', {'NULL' if f.lookback is None else f.lookback}::INTEGER, '{f.builder}')"
    for k, f in enumerate(catalog.FEATURES.values(), 1)) + ")"
VALUES = f"""lm AS MATERIALIZED ({matrix_sql()}), lv AS MATERIALIZED (SELECT rid, c, v FROM (
  SELECT row_number() OVER () AS rid, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in LIGHT)} FROM lm)
  UNPIVOT (v FOR c IN ({', '.join(LIGHT)})))"""


def bundled(spark, sf):
    """A bundle fitted on the panel and the matrix that it gives."""
    p, observations = panel(spark, sf), B.macro_obs(spark, sf)
    merged = U.merged_families(p)
    b = U.Bundle(spark, folder(spark, "bundle")).fit(p, observations, merged=merged)
    return b, b.apply(p, observations, merged=merged)


@query("feature_matrix_full", "K15 B12 K11 K12 C7")
def feature_matrix_full(spark, sf):
    return rounded(bundled(spark, sf)[1], 5)


@query("feature_registry", "K15 B10", f"""WITH {VALUES}, {REGISTRY}, ct AS (SELECT c, count(*) AS n FROM lv GROUP BY 1)
SELECT reg.*, CASE WHEN reg.builder IN ({', '.join(f"'{b}'" for b in catalog.LIGHT)}) THEN coalesce(n, 0) END AS n_present
FROM reg LEFT JOIN ct ON c = name""")
def feature_registry(spark, sf):
    """Every registered feature, with the rows that have it in the matrix of the light builders."""
    m = light_matrix(spark, sf)
    catalog.assert_coverage(m.select(*LIGHT).columns, catalog.LIGHT)
    count = m.agg(*[F.count(c).alias(c) for c in LIGHT]).unpivot([], LIGHT, "name", "n_present")
    return catalog.table(spark).join(count, "name", "left")


CORR = """cc AS (SELECT a.c AS a, b.c AS b, CASE WHEN count(*) >= 252 AND stddev_pop(a.v) > 1e-12 AND stddev_pop(b.v) > 1e-12
  THEN corr(a.v, b.v) END AS corr, count(*) AS n_pairs FROM lv a JOIN lv b ON a.rid = b.rid AND a.c < b.c GROUP BY 1, 2),
al AS (SELECT x.c AS a, y.c AS b FROM (SELECT unnest([{0}]) AS c) x, (SELECT unnest([{0}]) AS c) y WHERE x.c < y.c),
mc AS MATERIALIZED (SELECT al.a, al.b, corr, coalesce(n_pairs, 0) AS n_pairs FROM al LEFT JOIN cc USING (a, b))""".format(
    ", ".join(f"'{c}'" for c in LIGHT))


def matrix_pairs(spark, sf):
    """Correlations of all columns of the light matrix, a before b by name."""
    m = light_matrix(spark, sf).select(*[F.col(c).cast("double").alias(c) for c in sorted(LIGHT)])
    return gram.correlation(m, sorted(LIGHT))


@query("matrix_corr", "D13", f"WITH {VALUES}, {CORR} SELECT a, b, {r('corr', 4)}, n_pairs FROM mc")
def matrix_corr(spark, sf):
    return rounded(matrix_pairs(spark, sf), 4)


GROUPS = """ed AS MATERIALIZED (SELECT a AS u, b AS v FROM mc WHERE abs(corr) > 0.7 UNION SELECT b, a FROM mc WHERE abs(corr) > 0.7),
rc AS (SELECT unnest([{0}]) AS u, unnest([{0}]) AS l UNION SELECT ed.v, rc.l FROM rc JOIN ed ON ed.u = rc.u),
gl AS (SELECT u AS feature, min(l) AS group_id FROM rc GROUP BY 1),
gs AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS group_size FROM gl),
bt AS (SELECT a AS feature, b AS partner, abs(corr) AS c FROM mc UNION ALL SELECT b, a, abs(corr) FROM mc),
mp AS (SELECT feature, arg_min(partner, row(-round(coalesce(c, 0), 9), partner)) AS max_corr_partner, max(round(coalesce(c, 0), 9)) AS max_abs_corr FROM bt GROUP BY 1),
rd AS (SELECT feature, group_id, group_size, max_corr_partner, max_abs_corr FROM gs JOIN mp USING (feature))""".format(
    ", ".join(f"'{c}'" for c in LIGHT))


def matrix_groups(spark, sf):
    return U.redundancy(matrix_pairs(spark, sf), LIGHT)


@query("matrix_redundancy", "D14 D15", f"""WITH RECURSIVE {VALUES}, {CORR}, {GROUPS}
SELECT feature, group_id, group_size, max_corr_partner, {r('max_abs_corr', 4)} FROM rd""")
def matrix_redundancy(spark, sf):
    return rounded(matrix_groups(spark, sf), 4)


@query("bundle_provenance", "A11 D34")
def bundle_provenance(spark, sf):
    p = panel(spark, sf)
    b = U.Bundle(spark, folder(spark, "bundle")).fit_regimes(p)
    return U.provenance(b.rows(p), b)


SINKS = {"redundancy": ("feature group_id group_size max_corr_partner max_abs_corr", "matrix_redundancy"),
         "provenance": ("scope member n_rows n_dates first_date last_date", "provenance_bounds"),
         "scope": ("instrument asset_class n_eff_gate fit_scope_regime fit_scope_latent low_power embargo_p90", "scope_registry")}


def sinks_sql():
    parts = []
    for name, (cols, q) in SINKS.items():
        kinds = {c: "double" if c == "max_abs_corr" else "" for c in cols.split()}
        parts.append(f"SELECT '{name}' AS \"table\", {line_sql(kinds)} AS line FROM ({QUERIES[q].sql})")
    return " UNION ALL ".join(parts)


@query("provenance_sinks", "A11", sinks_sql())
def provenance_sinks(spark, sf):
    """Redundancy, provenance and scope, written as JSON and read back as text."""
    path, out = folder(spark, "provenance"), None
    for name, (_, q) in SINKS.items():
        df = QUERIES[q].build(spark, sf)
        S.write_json(df, f"{path}/{name}")
        t = spark.read.schema(df.schema).json(f"{path}/{name}")
        t = t.select(F.lit(name).alias("table"), S.line(t).alias("line"))
        out = t if out is None else out.unionByName(t)
    return out
