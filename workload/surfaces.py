"""In-memory and saved data, collections of tables, defaults, names and charts."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import functions as F

from featloom import (
    Cast,
    Collect,
    Extract,
    from_csv_dir,
    from_frames,
    into_dataset,
    load_dataset,
    save_dataset,
    split_feature_name,
)
from featloom.plans.storage import scratch_path
from featloom.problem import Problem, suggest_problem
from featloom.reports import best_fit, chart_data, contingency_shares
from featloom.schema import Attribute
from workload.features import customer_features
from workload.registry import load, query, r4, read, stat_names
from workload.tables import _profile_sql

_SEGMENTS = "SELECT c_mktsegment AS segment, count(*) AS customers FROM customer GROUP BY c_mktsegment"


@query(" UNION ALL ".join(f"SELECT '{kind}' AS table_name, * FROM ({_SEGMENTS})" for kind in ("arrow", "frame", "lists", "numpy", "pandas")))
def memory_tables(spark, sf_dir):
    """A small table in every form that can be at hand in memory."""
    small = read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("customers"))
    arrow = small.toArrow()
    columns = {name: arrow.column(name).to_pylist() for name in arrow.column_names}
    arrays = {"segment": np.array(columns["segment"]), "customers": np.array(columns["customers"])}
    forms = {"arrow": arrow, "frame": small, "lists": columns, "numpy": arrays, "pandas": arrow.to_pandas()}
    tables = from_frames(spark, forms)
    return functools.reduce(lambda a, b: a.unionByName(b), [t.data.select(F.lit(t.name).alias("table_name"), "segment", "customers") for t in tables])


@query(
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{t}' AS table_name, (SELECT count(*) FROM {t}) AS row_count"
        for i, t in enumerate(("nation", "region", "supplier", "orders", "customer"))
    ),
)
def flatten_tables(spark, sf_dir):
    """Datasets, tables and nested lists of them, in order."""
    orders, customer = load(spark, sf_dir, "orders", "customer").tables
    flat = into_dataset(load(spark, sf_dir, "nation", "region"), [load(spark, sf_dir, "supplier"), [orders, [customer]]])
    parts = [t.data.agg(F.count("*").alias("row_count")).select(F.lit(i).alias("position"), F.lit(t.name).alias("table_name"), "row_count") for i, t in enumerate(flat)]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def _saved(spark, sf_dir, *names):
    path = scratch_path(spark, "dataset")
    save_dataset(load(spark, sf_dir, *names), path)
    return load_dataset(spark, path)


@query("SELECT * FROM orders")
def save_load_rows(spark, sf_dir):
    return _saved(spark, sf_dir, "customer", "orders").table("orders").data


@query(_profile_sql("orders", counts=False))
def save_load_columns(spark, sf_dir):
    """Attributes survive."""
    rows = [(c.name, *(a in c.attributes for a in Attribute)) for c in _saved(spark, sf_dir, "orders").table("orders").columns]
    return spark.createDataFrame(rows, "column_name string, " + ", ".join(f"is_{a.name} boolean" for a in Attribute))


@query("SELECT kind, event_id, value FROM (SELECT unnest(['cached', 'durable']) AS kind), events WHERE event_type = 'click'")
def collect_tables(spark, sf_dir):
    """A restricted table, computed once on the executors and once in the shared folder."""
    events = load(spark, sf_dir, "events").table("events").restrict("event_type = 'click'", name="clicks")
    done = [next(iter(Collect(durable=durable).apply([events]))) for durable in (False, True)]
    parts = [t.data.select(F.lit(k).alias("kind"), "event_id", "value") for k, t in zip(("cached", "durable"), done)]
    return parts[0].unionByName(parts[1])


_WHOLE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_SIZES = (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63))


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CASE "
        + " ".join(f"WHEN min({c}) >= -power(2, {b}) AND max({c}) <= power(2, {b}) - 1 THEN '{t}'" for t, b in _SIZES)
        + f" END AS type, CAST(sum({c}) AS DOUBLE) AS total FROM lineitem"
        for c in _WHOLE
    ),
)
def shrink_integers(spark, sf_dir):
    """The smallest type that holds all values, and the values in it."""
    lines = read(spark, sf_dir, "lineitem").selectExpr(*(f"CAST({c} AS BIGINT) AS {c}" for c in _WHOLE))
    shrunk = from_frames(spark, {"lines": lines}).apply(Cast(shrink=True)).table("lines").data
    kinds = dict(shrunk.dtypes)
    parts = [shrunk.agg(F.sum(F.col(c).cast("double")).alias("total")).select(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("type"), "total") for c in _WHOLE]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def _names_sql() -> str:
    tables = {
        "customer": ["c_nationkey", "c_acctbal"],
        "group_by(orders, custkey)": stat_names(["o_totalprice"]),
        "group_by(events, custkey)": stat_names(["value"]),
    }
    parts = []
    for name, features in tables.items():
        listed = ", ".join("'" + f.replace("'", "''") + "'" for f in features)
        parts.append(
            f"SELECT '{name}' AS source, f AS feature, CAST(row_number() OVER (ORDER BY length(f), i) AS INT) AS position FROM ("
            f"SELECT unnest([{listed}]) AS f, unnest(range({len(features)})) AS i) WHERE (SELECT count(*) FROM customer) > 0",
        )
    return " UNION ALL ".join(parts)


@query(_names_sql())
def feature_names(spark, sf_dir):
    """Features by table in their order, shorter names first, split into feature and source."""
    known, data = customer_features(spark, sf_dir)
    tables = [t for t in data.apply(Extract(known=known)) if t.columns]
    rows = []
    for t in tables:
        names = [split_feature_name(c.name) for c in t.columns]
        rows += [(source, feature, i) for i, (feature, source) in enumerate(names, 1)]
    return spark.createDataFrame(rows, "source string, feature string, position int")


_TARGETS = {
    "customer": ("c_mktsegment", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    "orders": ("o_totalprice", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
    "lineitem": ("l_returnflag", ["l_orderkey", "l_linenumber", "l_returnflag"]),
}


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, CASE WHEN count(DISTINCT {target}) <= 50 THEN 'classification' ELSE 'regression' END AS problem, "
        "array_to_string(list_filter(["
        + ", ".join(f"CASE WHEN count(DISTINCT {c}) = count(*) THEN '{c}' END" for c in columns if c != target)
        + f"], lambda c: c IS NOT NULL), ',') AS known FROM {name}"
        for name, (target, columns) in _TARGETS.items()
    ),
)
def problem_defaults(spark, sf_dir):
    rows = []
    for name, (target, _) in _TARGETS.items():
        problem, known = suggest_problem(load(spark, sf_dir, name).table(name), target)
        rows.append((name, str(problem), ",".join(c.name for c in known)))
    return spark.createDataFrame(rows, "table_name string, problem string, known string")


@query(
    f"SELECT {r4('regr_slope(l_extendedprice, l_quantity)')} AS slope, {r4('regr_intercept(l_extendedprice, l_quantity)')} AS intercept, "
    "CAST(min(l_quantity) AS DOUBLE) AS x_min, CAST(max(l_quantity) AS DOUBLE) AS x_max FROM lineitem WHERE l_linenumber > 1",
)
def best_fit_of_texts(spark, sf_dir):
    """Texts that are no numbers do not count."""
    lines = read(spark, sf_dir, "lineitem").selectExpr("IF(l_linenumber > 1, CAST(l_quantity AS STRING), 'n/a') AS x", "l_extendedprice AS y")
    return best_fit(lines, "x", "y").selectExpr(f"{r4('slope')} AS slope", f"{r4('intercept')} AS intercept", "x_min", "x_max")


@query(
    f"SELECT x, y, n AS count, {r4('n * 100.0 / sum(n) OVER (PARTITION BY x)')} AS percentage FROM "
    "(SELECT l_suppkey AS x, l_linenumber AS y, count(*) AS n FROM lineitem GROUP BY ALL)",
)
def contingency_long(spark, sf_dir):
    """Shares as rows, for any number of values."""
    found = contingency_shares(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_linenumber")
    return found.withColumn("percentage", F.expr(r4("percentage")))


_CHARTS = {
    ("classification", True): {"histogram": None, "box plot": "count(DISTINCT l_returnflag)"},
    ("classification", False): {"shares of target": "count(DISTINCT l_linestatus)", "shares of feature": "count(DISTINCT l_returnflag)", "hierarchy": None},
    ("regression", True): {"points": "count(*)", "best fit": "min(1)"},
    ("regression", False): {"box plot": "count(DISTINCT l_linestatus)"},
}


@query(
    " UNION ALL ".join(
        f"SELECT '{problem}' AS problem, {numeric} AS is_numeric, '{chart}' AS chart, CAST({rows or 'max(NULL)'} AS BIGINT) AS row_count FROM lineitem"
        for (problem, numeric), charts in _CHARTS.items()
        for chart, rows in charts.items()
    ),
)
def charts_by_kind(spark, sf_dir):
    """The charts of each problem and kind of feature, and how many rows tell them."""
    lines = read(spark, sf_dir, "lineitem")
    parts = []
    for (problem, numeric), expected in _CHARTS.items():
        target = "l_returnflag" if problem == "classification" else "l_extendedprice"
        feature = "l_quantity" if numeric else "l_linestatus"
        for chart, data in chart_data(lines, feature, target, Problem[problem], numeric=numeric).items():
            rows = data.agg(F.count("*").alias("row_count")) if expected[chart] else data.agg(F.lit(None).cast("long").alias("row_count"))
            parts.append(rows.select(F.lit(problem).alias("problem"), F.lit(numeric).alias("is_numeric"), F.lit(chart).alias("chart"), "row_count"))
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


@query("SELECT 'region' AS kind, r_regionkey AS key, r_name AS name FROM region UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def csv_many_files(spark, sf_dir):
    """Every file of a folder is a table."""
    path = scratch_path(spark, "csv-folder")
    for name, prefix in (("region", "r_regionkey AS key, r_name AS name"), ("supplier", "s_suppkey AS key, s_name AS name")):
        read(spark, sf_dir, name).selectExpr(f"'{name}' AS kind", *prefix.split(", ")).coalesce(1).write.mode("append").csv(path, header=True)
    tables = list(from_csv_dir(spark, path))
    return functools.reduce(lambda a, b: a.unionByName(b), [t.data.select("kind", "key", "name") for t in tables])
