"""DuckDB text fragments for the oracle queries. Nothing here is used by Spark."""

TICKS = """ticks AS (
  SELECT n_name AS instrument, r_name AS asset_class, CAST(l_shipdate AS DATE) AS date,
         l_extendedprice AS px, l_quantity AS qty, l_linestatus,
         row(l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

BARS = TICKS + """, bars AS (
  SELECT instrument, asset_class, date, arg_min(px, k) AS open, max(px) AS high,
         min(px) AS low, arg_max(px, k) AS close, sum(qty) AS volume,
         CAST(NULLIF(count(*) FILTER (l_linestatus = 'O'), 0) AS DOUBLE) AS open_interest
  FROM ticks GROUP BY 1, 2, 3)"""

PANEL = BARS + """, panel AS (
  SELECT * EXCLUDE (m), CASE WHEN m IS NULL THEN NULL WHEN close > 1.25*m THEN -1
         WHEN close < 0.75*m THEN 1 ELSE 0 END AS s
  FROM (SELECT *, CASE WHEN count(*) OVER w = 5 THEN avg(close) OVER w END AS m FROM bars
        WINDOW w AS (PARTITION BY instrument ORDER BY date
                     ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)))"""

DIM = """dim AS (
  SELECT n_name AS instrument, r_name AS asset_class,
    CASE WHEN r_name IN ('AFRICA','AMERICA') THEN 'CMES'
         WHEN r_name IN ('ASIA','EUROPE') THEN 'CME_Equity' ELSE 'XEUR' END AS calendar,
    CASE r_name WHEN 'AFRICA' THEN 'NYMEX' WHEN 'AMERICA' THEN 'COMEX'
         WHEN 'ASIA' THEN 'CME_EQ' WHEN 'EUROPE' THEN 'CME_EQ' ELSE 'EUREX' END AS venue
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

DIRTY = BARS + """, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY date) AS n FROM bars),
dirty AS (
  SELECT instrument, asset_class, date,
    CASE WHEN n % 79 = 0 THEN -open ELSE open END AS open,
    CASE WHEN n % 89 = 0 THEN low - 1 ELSE high END AS high, low,
    CASE WHEN n % 97 <> 0 THEN close END + (o.ord - 1) AS close,
    CASE WHEN n % 83 = 0 THEN 0.0 WHEN n % 71 = 0 THEN NULL ELSE volume END AS volume,
    open_interest, o.ord AS ord
  FROM numbered JOIN (SELECT 1 AS ord UNION ALL SELECT 2) o ON o.ord = 1 OR n % 73 = 0)"""

MACRO = """macro_obs AS (
  SELECT o_orderpriority AS series, 'daily' AS release_class, CAST(o_orderdate AS DATE) AS stamp,
         avg(o_totalprice) AS value FROM orders GROUP BY ALL
  UNION ALL
  SELECT c || '_' || st, c, stamp, value FROM (
    SELECT o_orderstatus AS st, CAST(o_orderdate AS DATE) AS stamp, avg(o_totalprice) AS value
    FROM orders GROUP BY ALL), (VALUES ('weekly'), ('monthly')) v(c))"""

EVENTS = """ev AS (SELECT event_type AS instrument, ts, event_id, value AS px FROM events)"""

KEY = "PARTITION BY instrument ORDER BY date"


def over(n, key=KEY):
    return f"({key} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def strict(fn, x, n, key=KEY):
    """fn(x) over the last n rows, NULL unless all are present."""
    return (f"CASE WHEN count({x}) OVER {over(n, key)} = {n} "
            f"THEN {fn}({x}) OVER {over(n, key)} END")


def sma(x, n, **kw):
    return "(" + strict("avg", x, n, **kw) + ")"


def sd(x, n, **kw):
    return "(" + strict("stddev_samp", x, n, **kw) + ")"


def pos(x):
    return f"(CASE WHEN {x} > 1e-12 THEN {x} END)"


def lag(x, k=1, key=KEY):
    return f"lag({x}, {k}) OVER ({key})"


def r(x, d=6, name=None):
    return f"round({x}, {d}) + 0.0 AS {name or x}"


def rs(cols, d=6):
    return ", ".join(r(x, d) for x in cols.split())


def ewm_sql(name, src, specs, key="instrument", order="date", keep="instrument, date"):
    """Row-by-row EWM as a recursive CTE. specs: (out, input, alpha, min_count).

    Inputs may have leading and interior NULLs; weights decay over gaps.
    """
    sel = ", ".join(f"CAST({x} AS DOUBLE) AS x{i}" for i, (_, x, _, _) in enumerate(specs))
    base, step = [], []
    for i, (_, _, a, _) in enumerate(specs):
        base.append(f"x{i} AS y{i}, 1.0::DOUBLE AS w{i}, "
                    f"CASE WHEN x{i} IS NULL THEN 0 ELSE 1 END AS n{i}")
        w = f"(e.w{i} * {1.0 - a!r})"
        step.append(
            f"CASE WHEN b.x{i} IS NULL THEN e.y{i} WHEN e.y{i} IS NULL THEN b.x{i} "
            f"ELSE ({w} * e.y{i} + {a!r} * b.x{i}) / ({w} + {a!r}) END, "
            f"CASE WHEN b.x{i} IS NULL THEN {w} ELSE 1.0 END, "
            f"e.n{i} + CASE WHEN b.x{i} IS NULL THEN 0 ELSE 1 END")
    outs = ", ".join(f"CASE WHEN n{i} >= {m} THEN y{i} END AS {o}"
                     for i, (o, _, _, m) in enumerate(specs))
    return (f"{name}_b AS MATERIALIZED (SELECT {keep}, row_number() OVER (PARTITION BY {key} "
            f"ORDER BY {order}) AS rn, {sel} FROM {src}), "
            f"{name}_e AS (SELECT {keep}, rn, {', '.join(base)} FROM {name}_b WHERE rn = 1 "
            f"UNION ALL SELECT {', '.join('b.' + k.strip() for k in keep.split(','))}, b.rn, "
            f"{', '.join(step)} FROM {name}_e e JOIN {name}_b b ON "
            f"{' AND '.join(f'b.{k.strip()} = e.{k.strip()}' for k in key.split(','))} "
            f"AND b.rn = e.rn + 1), "
            f"{name} AS (SELECT {keep}, {outs} FROM {name}_e)")
