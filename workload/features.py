"""Aggregation and feature extraction."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import functions as F

from featloom import (
    Aggregate,
    Attribute,
    Column,
    Combine,
    Dataset,
    Encode,
    Extract,
    Filter,
    Identity,
    Impute,
    Keep,
    Rename,
    Table,
    assemble,
    declare_key,
    with_attributes,
)
from featloom.functions import quote
from featloom.plans.quantiles import SKETCH_ERROR
from workload.registry import (
    comparable,
    dq,
    load,
    query,
    read,
    stat_columns,
    stat_names,
    tidy,
)

_CUSTOMER_KEY = {"c_custkey": "custkey", "o_custkey": "custkey", "user_id": "custkey"}


@query(f"SELECT o_custkey, {stat_columns(['o_totalprice'])} FROM orders GROUP BY o_custkey")
def agg_orders_by_cust(spark, sf_dir):
    # one declared key: prices that happen to be unique are still values
    orders = declare_key(load(spark, sf_dir, "orders"), "orders", ["o_orderkey"])
    grouped = orders.apply(Aggregate(is_pivotable=["o_custkey"]))
    return tidy(grouped.table("group_by(orders, o_custkey)").data)


_LINE_VALUES = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(f"SELECT l_orderkey, {stat_columns(_LINE_VALUES)} FROM lineitem GROUP BY l_orderkey")
def agg_lineitem_by_order(spark, sf_dir):
    grouped = load(spark, sf_dir, "lineitem").apply(Aggregate(is_pivotable=["l_orderkey"]))
    return tidy(grouped.table("group_by(lineitem, l_orderkey)").data)


def _two_pivots_sql() -> str:
    parts = []
    for pivots in (["l_returnflag"], ["l_linestatus"], ["l_returnflag", "l_linestatus"]):
        keys = ", ".join(
            f"{p if p in pivots else 'CAST(NULL AS VARCHAR)'} AS {p}" for p in ("l_returnflag", "l_linestatus")
        )
        parts.append(
            f"SELECT 'group_by(lineitem, {', '.join(pivots)})' AS table_name, {keys}, "
            f"{stat_columns(['l_quantity', 'l_extendedprice'])} FROM lineitem GROUP BY {', '.join(pivots)}",
        )
    return " UNION ALL ".join(parts)


@query(_two_pivots_sql())
def agg_lineitem_two_pivots(spark, sf_dir):
    columns = ["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice"]
    lines = load(spark, sf_dir, "lineitem").apply(Keep(columns=[(c, "lineitem") for c in columns]))
    grouped = lines.apply(Aggregate(is_pivotable=["l_returnflag", "l_linestatus"], max_pivots=2))
    parts = []
    for table in grouped:
        keys = [
            F.col(p) if table.has(p) else F.lit(None).cast("string").alias(p)
            for p in ("l_returnflag", "l_linestatus")
        ]
        stats = [F.col(quote(n)) for n in stat_names(["l_quantity", "l_extendedprice"])]
        parts.append(table.data.select(F.lit(table.name).alias("table_name"), *keys, *stats))
    return tidy(functools.reduce(lambda a, b: a.unionByName(b), parts))


_FLAGS, _LINE_SIZE = {"flag": "nullif(l_returnflag, 'N')", "status": "l_linestatus", "line": "nullif(l_linenumber, 7)"}, ["l_quantity", "l_extendedprice"]


def _three_pivots_sql() -> str:
    parts = []
    for size in (1, 2, 3):
        for pivots in itertools.combinations(_FLAGS, size):
            keys = ", ".join(f"{f'CAST({_FLAGS[p]} AS VARCHAR)' if p in pivots else 'CAST(NULL AS VARCHAR)'} AS {p}" for p in _FLAGS)
            parts.append(
                f"SELECT 'group_by(lines, {', '.join(pivots)})' AS table_name, {keys}, {stat_columns(_LINE_SIZE)} "
                f"FROM lineitem GROUP BY {', '.join(_FLAGS[p] for p in pivots)}",
            )
    return " UNION ALL ".join(parts)


def _three_pivots(spark, sf_dir, **options):
    """Seven combinations of three pivots, two of them with null keys, in one scan."""
    frame = read(spark, sf_dir, "lineitem").selectExpr(*(f"{sql} AS {p}" for p, sql in _FLAGS.items()), *_LINE_SIZE)
    numeric = {Attribute.numeric, Attribute.not_null}
    columns = [Column(name=p) for p in _FLAGS] + [Column(name=c, attributes=numeric) for c in _LINE_SIZE]
    lines = Table(name="lines", columns=columns, data=frame)
    parts = []
    for table in Dataset([lines]).apply(Aggregate(is_pivotable=list(_FLAGS), max_pivots=3, **options)):
        keys = [(F.col(p) if table.has(p) else F.lit(None)).cast("string").alias(p) for p in _FLAGS]
        stats = [F.col(quote(n)) for n in stat_names(_LINE_SIZE)]
        parts.append(table.data.select(F.lit(table.name).alias("table_name"), *keys, *stats))
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


@query(_three_pivots_sql())
def agg_three_pivots(spark, sf_dir):
    return tidy(_three_pivots(spark, sf_dir))


@query(_three_pivots_sql())
def agg_three_pivots_hot(spark, sf_dir):
    """The same by partial aggregates and radix selection: every group above 100 rows counts as hot."""
    return tidy(_three_pivots(spark, sf_dir, row_limit=100))


@query(
    f"SELECT * EXCLUDE ({dq('median(l_quantity)')}) FROM (SELECT l_suppkey, "
    f"{', '.join(f'true AS {c}_within' for c in _LINE_SIZE)}, {stat_columns(_LINE_SIZE[:1])} FROM lineitem GROUP BY l_suppkey)",
)
def agg_sketched_medians(spark, sf_dir):
    """Medians by sketches: all else is exact, and exact ranks of the medians stay within the bound."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", *_LINE_SIZE)
    numeric = {Attribute.numeric, Attribute.not_null}
    table = Table(name="lines", columns=[Column(name=c, attributes=numeric) for c in lines.columns], data=lines)
    made = Dataset([table]).apply(Aggregate(is_pivotable=["l_suppkey"], exact=False)).tables[0].data
    near = lines.join(made.select("l_suppkey", *(quote(f"median({c})") for c in _LINE_SIZE)), "l_suppkey").groupBy("l_suppkey")
    slack = f"(1 + count(1) * {SKETCH_ERROR})"
    ranks = near.agg(
        *(
            F.expr(
                f"count_if({c} < {quote(f'median({c})')}) - {slack} <= count(1) / 2 "
                f"AND count_if({c} <= {quote(f'median({c})')}) + {slack} >= count(1) / 2",
            ).alias(f"{c}_within")
            for c in _LINE_SIZE
        ),
    )
    exact = [n for n in stat_names(_LINE_SIZE[:1]) if not n.startswith("median")]
    return tidy(made.select("l_suppkey", *map(quote, exact))).join(ranks, "l_suppkey")


def customer_features(spark, sf_dir):
    """Customers with the features of themselves, their orders and their events."""
    data = load(spark, sf_dir, "customer", "orders", "events").apply(Rename(mapping=_CUSTOMER_KEY))
    data = declare_key(data, "customer", ["custkey"])
    data = declare_key(declare_key(data, "orders", ["o_orderkey"]), "events", ["event_id"])
    data = data.apply(Identity().then(Identity(), Aggregate(is_pivotable=["custkey"])))
    customer = data.table("customer")
    known = customer.select([customer.column("custkey")])
    return known, data


def _features_sql(fill: bool = False) -> str:
    orders, events = " :: group_by(orders, custkey)", " :: group_by(events, custkey)"
    numbers = [
        *stat_names(["o_totalprice"], orders),
        *stat_names(["value"], events),
    ]
    listed = ", ".join(f"coalesce({dq(n)}, 0) AS {dq(n)}" if fill else dq(n) for n in numbers)
    return (
        'SELECT c_custkey AS custkey, c_acctbal AS "c_acctbal :: customer", '
        f'c_nationkey AS "c_nationkey :: customer", {listed} FROM customer '
        f"LEFT JOIN (SELECT o_custkey, {stat_columns(['o_totalprice'], suffix=orders)} "
        "FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey "
        f"LEFT JOIN (SELECT user_id, {stat_columns(['value'], suffix=events)} "
        "FROM events GROUP BY user_id) ON c_custkey = user_id"
    )


@query(_features_sql())
def features_customer(spark, sf_dir):
    known, data = customer_features(spark, sf_dir)
    return tidy(data.features(known, keep_known=True))


@query(_features_sql(fill=True))
def impute_features(spark, sf_dir):
    known, data = customer_features(spark, sf_dir)
    imputed = data.apply(Extract(known=known).then(Impute()))
    return tidy(assemble(imputed, known))


_TYPES = ["click", "error", "purchase", "signup", "view"]


def _fused_sql() -> str:
    items = []
    for kind in _TYPES:
        for text, where in (
            (f"event_type == {kind}", f"event_type = '{kind}'"),
            (f"not(event_type == {kind})", f"NOT (event_type = '{kind}')"),
        ):
            suffix = f" :: group_by(filter(events, {text}), custkey)"
            # a group without matching rows does not exist, so its sum is missing, not 0
            listed = stat_columns(["value"], suffix=suffix, where=where)
            items.append(listed)
    names = ", ".join(
        dq(n)
        for kind in _TYPES
        for text in (f"event_type == {kind}", f"not(event_type == {kind})")
        for n in stat_names(["value"], f" :: group_by(filter(events, {text}), custkey)")
    )
    return (
        f"SELECT c_custkey AS custkey, {names} FROM customer LEFT JOIN "
        f"(SELECT user_id, {', '.join(items)} FROM events GROUP BY user_id) ON c_custkey = user_id"
    )


_WIDE = {"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"], "l_linenumber": [1, 2, 3, 4, 5, 6, 7]}
_WIDE_VALUES = ["l_quantity", "l_extendedprice", "l_discount"]


def _wide_sql() -> str:
    """Statistics of the rows of each category and of its complement, per supplier."""
    items = []
    for column, values in _WIDE.items():
        for v in values:
            same = f"{column} = {v!r}"
            for text, where in ((f"{column} == {v}", same), (f"not({column} == {v})", f"NOT ({same})")):
                suffix = f" :: group_by(filter(lineitem, {text}), l_suppkey)"
                items.append(stat_columns(_WIDE_VALUES, suffix=suffix, where=where))
    return f"SELECT l_suppkey, {', '.join(items)} FROM lineitem GROUP BY l_suppkey"


@query(_wide_sql())
def agg_filtered_wide(spark, sf_dir):
    """24 filters of three columns: one scan and one shuffle."""
    numeric = [Attribute.numeric, Attribute.not_null]
    columns = {
        "l_suppkey": numeric,
        **{c: numeric for c in _WIDE_VALUES},
        "l_returnflag": [Attribute.textual, Attribute.categorical, Attribute.not_null],
        "l_linestatus": [Attribute.textual, Attribute.categorical, Attribute.not_null],
        "l_linenumber": [Attribute.categorical, Attribute.not_null],
    }
    kept = load(spark, sf_dir, "lineitem").apply(Keep(columns=[(c, "lineitem") for c in columns]))
    lines = with_attributes(kept, {"lineitem": columns}).apply(
        Encode().then(Filter()).then(Aggregate(is_pivotable=["l_suppkey"])),
    )
    known = read(spark, sf_dir, "lineitem").select("l_suppkey").distinct()
    return tidy(lines.features(known, keep_known=True))


@query(_fused_sql())
def agg_filtered_fused(spark, sf_dir):
    data = load(spark, sf_dir, "events", "customer").apply(Rename(mapping=_CUSTOMER_KEY))
    # few users make a small table's key categorical, too; only the type is encoded here
    columns = {
        "custkey": [Attribute.numeric, Attribute.not_null],
        "event_type": [Attribute.textual, Attribute.categorical, Attribute.not_null],
        "value": [Attribute.numeric, Attribute.not_null],
    }
    kept = data.apply(Keep(columns=[(c, "events") for c in columns]))
    events = with_attributes(kept, {"events": columns}).apply(
        Encode().then(Filter()).then(Aggregate(is_pivotable=["custkey"])),
    )
    customer = data.table("customer")
    known = customer.select([customer.column("custkey")])
    return tidy(events.features(known, keep_known=True))


@query(
    "SELECT c_custkey AS custkey, "
    + ", ".join(
        f"{comparable('median', 'CASE WHEN ' + y + ' = 0 THEN CAST(' + chr(39) + 'NaN' + chr(39) + ' AS DOUBLE) ELSE CAST(' + x + ' AS DOUBLE) / ' + y + ' END')} "
        f"AS {dq(f'{xn} / {yn} :: combine(group_by(orders, custkey))')}"
        for (x, xn), (y, yn) in [
            (("count(*)", "count(*)"), ("max(o_totalprice)", "max(o_totalprice)")),
            (("count(*)", "count(*)"), ("min(o_totalprice)", "min(o_totalprice)")),
            (("max(o_totalprice)", "max(o_totalprice)"), ("min(o_totalprice)", "min(o_totalprice)")),
        ]
    )
    + " FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
)
def combine_features(spark, sf_dir):
    data = declare_key(load(spark, sf_dir, "orders"), "orders", ["o_orderkey"]).apply(
        Rename(mapping=_CUSTOMER_KEY).then(Aggregate(is_pivotable=["custkey"])),
    )
    group = "group_by(orders, custkey)"
    kept = data.apply(
        Keep(columns=[(c, group) for c in ("custkey", "count(*)", "max(o_totalprice)", "min(o_totalprice)")]),
    )
    known = read(spark, sf_dir, "orders").selectExpr("o_custkey AS custkey").distinct()
    return kept.apply(Combine()).features(known, keep_known=True)
