"""Sources, profiles, projections, filters, joins, unions and casts."""

from __future__ import annotations

import dataclasses
import datetime
import functools

from pyspark.sql import functions as F

from featloom import (
    Aggregate,
    Attribute,
    Cast,
    Column,
    Combine,
    Dataset,
    Drop,
    Encode,
    Filter,
    Identity,
    Join,
    Keep,
    Rename,
    Require,
    Table,
    Union,
    Window,
    clean,
    declare_key,
    drop_related,
    from_csv,
    from_csv_dir,
    from_frames,
    preview,
    profile_frame,
    read_known,
    redact,
    table,
    with_attributes,
)
from featloom.functions import quote
from featloom.plans.storage import scratch_path
from workload.registry import dq, load, named, query, read

_NUMERIC, _TEXT, _TIME, _NESTED = "numeric", "textual", "temporal", None

# Columns of the profiled tables with the attribute that follows from their type.
_KINDS = {
    "customer": {
        "c_custkey": _NUMERIC, "c_name": _TEXT, "c_nationkey": _NUMERIC, "c_acctbal": _NUMERIC,
        "c_mktsegment": _TEXT,
    },
    "orders": {
        "o_orderkey": _NUMERIC, "o_custkey": _NUMERIC, "o_orderstatus": _TEXT, "o_totalprice": _NUMERIC,
        "o_orderdate": _TIME, "o_orderpriority": _TEXT,
    },
    "lineitem": {
        "l_orderkey": _NUMERIC, "l_partkey": _NUMERIC, "l_suppkey": _NUMERIC, "l_linenumber": _NUMERIC,
        "l_quantity": _NUMERIC, "l_extendedprice": _NUMERIC, "l_discount": _NUMERIC, "l_tax": _NUMERIC,
        "l_returnflag": _TEXT, "l_linestatus": _TEXT, "l_shipdate": _TIME,
    },
    "events": {
        "event_id": _NUMERIC, "ts": _TIME, "user_id": _NUMERIC, "event_type": _TEXT, "value": _NUMERIC,
        "props": _TEXT,
    },
    "documents": {
        "doc_id": _NUMERIC, "text": _TEXT, "lang": _TEXT, "source": _TEXT, "n_chars": _NUMERIC,
    },
}


def _profile_sql(name: str, *, counts: bool) -> str:
    """Exact profile; null counts as one distinct value."""
    parts = []
    for column, kind in _KINDS[name].items():
        distinct = f"(count(DISTINCT {column}) + (count({column}) < count(*))::INT)"
        flags = ", ".join(
            [
                "false AS is_boolean",
                f"{distinct} <= 50 AS is_categorical",
                f"count({column}) = count(*) AS is_not_null",
                f"{str(kind == _NUMERIC).lower()} AS is_numeric",
                f"{distinct} = count(*) AS is_primary_key",
                f"{str(kind == _TIME).lower()} AS is_temporal",
                f"{str(kind == _TEXT).lower()} AS is_textual",
            ],
        )
        numbers = (
            f"count(*) AS row_count, count(*) - count({column}) AS null_count, "
            f"CAST({distinct} AS BIGINT) AS distinct_count, "
        )
        parts.append(f"SELECT '{column}' AS column_name, {numbers if counts else ''}{flags} FROM {name}")
    return " UNION ALL ".join(parts)


@query(_profile_sql("orders", counts=True))
def profile_orders(spark, sf_dir):
    return profile_frame(read(spark, sf_dir, "orders"))


@query(_profile_sql("lineitem", counts=True))
def profile_lineitem(spark, sf_dir):
    return profile_frame(read(spark, sf_dir, "lineitem"))


def _attributes(spark, sf_dir, name):
    """Attributes from the sketch-first profile: one row per column."""
    inferred = table(read(spark, sf_dir, name), name)
    rows = [(c.name, *(a in c.attributes for a in Attribute)) for c in inferred.columns]
    schema = "column_name string, " + ", ".join(f"is_{a.name} boolean" for a in Attribute)
    return spark.createDataFrame(rows, schema)


@query(_profile_sql("customer", counts=False))
def attributes_customer(spark, sf_dir):
    return _attributes(spark, sf_dir, "customer")


@query(_profile_sql("events", counts=False))
def attributes_events(spark, sf_dir):
    return _attributes(spark, sf_dir, "events")


@query(_profile_sql("documents", counts=False))
def attributes_documents(spark, sf_dir):
    return _attributes(spark, sf_dir, "documents")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def keep_cols(spark, sf_dir):
    data = load(spark, sf_dir, "orders", "nation")
    kept = data.apply(Keep(columns=[("o_orderkey", "orders"), ("o_totalprice", "orders")]))
    return kept.table("orders").data


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders")
def drop_cols(spark, sf_dir):
    data = load(spark, sf_dir, "orders")
    dropped = data.apply(Drop(columns=[("o_totalprice", "orders"), ("o_orderpriority", "orders")]))
    return dropped.table("orders").data


@query("SELECT o_orderkey AS orderkey, o_totalprice FROM orders")
def select_cols(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").apply(Rename(mapping={"o_orderkey": "orderkey"})).table("orders")
    return orders.select([orders.column("orderkey"), orders.column("o_totalprice")]).data


@query(
    "SELECT c_custkey AS custkey, c_name, c_nationkey AS nationkey, c_acctbal, c_mktsegment FROM customer",
)
def rename_cols(spark, sf_dir):
    mapping = {"c_custkey": "custkey", "c_nationkey": "nationkey", "c_name": "c_acctbal", "absent": "x"}
    return load(spark, sf_dir, "customer").apply(Rename(mapping=mapping)).table("customer").data


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def redact_customer(spark, sf_dir):
    data = load(spark, sf_dir, "customer", "region")
    return redact(data, columns=[("c_name", "customer"), ("c_acctbal", "customer")], tables=["region"]).tables[0].data


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def require_tables(spark, sf_dir):
    data = load(spark, sf_dir, "nation", "region", "supplier")
    return data.apply(Require(predicate=lambda t: any(c.name == "n_regionkey" for c in t.columns))).tables[0].data


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders")
def drop_related_cols(spark, sf_dir):
    data = load(spark, sf_dir, "orders", "lineitem")
    target = data.table("orders").column("o_totalprice")
    aggregated = data.apply(Identity().then(Identity(), Aggregate(is_pivotable=["o_custkey"])))
    return drop_related(aggregated, target).table("orders").data


_EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    " UNION ALL ".join(
        f"SELECT 'filter(events, {text})' AS table_name, event_id, user_id, value FROM events WHERE {sql}"
        for t in _EVENT_TYPES
        for text, sql in (
            (f"event_type == {t}", f"event_type = '{t}'"),
            (f"not(event_type == {t})", f"NOT (event_type = '{t}')"),
        )
    ),
)
def filter_events(spark, sf_dir):
    # other columns have few values, too, when the table is small
    columns = {"event_id": [], "user_id": [], "value": [], "event_type": [Attribute.textual, Attribute.categorical]}
    data = load(spark, sf_dir, "events").apply(Keep(columns=[(c, "events") for c in columns]))
    filtered = with_attributes(data, {"events": columns}).apply(Encode().then(Filter()))
    parts = [named(t).select("table_name", "event_id", "user_id", "value") for t in filtered]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


@query(
    " UNION ALL ".join(
        f"SELECT 'window(orders, {text})' AS table_name, o_orderkey, o_custkey, o_totalprice FROM orders "
        f"WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL {days} DAY"
        for days, text in ((30, "30 days, 0:00:00"), (365, "365 days, 0:00:00"))
    ),
)
def window_orders(spark, sf_dir):
    periods = [datetime.timedelta(days=30), datetime.timedelta(days=365)]
    recent = load(spark, sf_dir, "orders").apply(Window(periods=periods, as_of=datetime.datetime(2001, 8, 1)))
    parts = [named(t).select("table_name", "o_orderkey", "o_custkey", "o_totalprice") for t in recent]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def preview_orders(spark, sf_dir):
    return preview(load(spark, sf_dir, "orders").table("orders"), 100, order_by=["o_orderkey"])


_TEXT_DATES = {
    "day": "date_format(o_orderdate, 'yyyy-MM-dd')",
    "moment": "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\")",
    "clock": "concat(lpad(CAST(o_orderkey % 24 AS STRING), 2, '0'), ':', lpad(CAST(o_custkey % 60 AS STRING), 2, '0'), ':05')",
    "year": "date_format(o_orderdate, 'yyyy')",
}


@query(
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS TIMESTAMP) AS moment, "
    "lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') || ':05' "
    "AS clock, strftime(o_orderdate, '%Y') AS year FROM orders",
)
def cast_dates(spark, sf_dir):
    texts = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        *(f"{sql} AS {name}" for name, sql in _TEXT_DATES.items()),
    )
    cast = from_frames(spark, {"texts": texts}).apply(Cast()).table("texts")
    # a time of day is compared as text
    return cast.data.withColumn("clock", F.col("clock").cast("string"))


@query("SELECT doc_id, quality = 1 AS quality, toxic = 1 AS toxic FROM labels")
def cast_binary_labels(spark, sf_dir):
    return load(spark, sf_dir, "labels").apply(Cast()).table("labels").data


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, "
    + ", ".join(f"c_nationkey = {n} AS {dq(f'c_nationkey == {n}')}" for n in range(25))
    + ", "
    + ", ".join(f"c_mktsegment = '{s}' AS {dq(f'c_mktsegment == {s}')}" for s in _SEGMENTS)
    + " FROM customer",
)
def encode_segment(spark, sf_dir):
    return load(spark, sf_dir, "customer").apply(Encode()).table("customer").data


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def union_orders_parts(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    parts = {
        "open": orders.where("o_orderstatus = 'O'"),
        # other order of columns and a narrower type
        "closed": orders.where("o_orderstatus <> 'O'").selectExpr(
            "o_totalprice", "CAST(o_orderkey AS INT) AS o_orderkey", "o_orderstatus",
        ),
    }
    return from_frames(spark, parts).apply(Union()).table("union(open, closed)").data


@query(
    "SELECT l.l_orderkey AS orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity, l.l_extendedprice, "
    "l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus, l.l_shipdate, o.o_custkey, o.o_orderstatus, "
    "o.o_totalprice, o.o_orderdate, o.o_orderpriority "
    "FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey",
)
def join_lineitem_orders(spark, sf_dir):
    data = load(spark, sf_dir, "lineitem", "orders").apply(
        Rename(mapping={"l_orderkey": "orderkey", "o_orderkey": "orderkey"}),
    )
    return declare_key(data, "orders", ["orderkey"]).apply(Join()).table("join(lineitem, orders)").data


@query(
    "SELECT doc_id, quality = 1 AS quality, toxic = 1 AS toxic, "
    "quality = 0 AS \"quality == False\", quality = 1 AS \"quality == True\", "
    "toxic = 0 AS \"toxic == False\", toxic = 1 AS \"toxic == True\" FROM labels",
)
def clean_dataset(spark, sf_dir):
    return clean(load(spark, sf_dir, "labels", "region")).table("labels").data


@query(
    "SELECT "
    + ", ".join(
        f"CASE WHEN {y} = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST({x} AS DOUBLE) / CAST({y} AS DOUBLE) END AS {dq(f'{x} / {y}')}"
        for i, x in enumerate(["l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"])
        for y in ["l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"][i + 1 :]
    )
    + " FROM lineitem",
)
def combine_ratio(spark, sf_dir):
    columns = ["l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    lines = load(spark, sf_dir, "lineitem").apply(Keep(columns=[(c, "lineitem") for c in columns]))
    return lines.apply(Combine()).table("combine(lineitem)").data


@query(
    "SELECT doc_id, (quality = 1) AND (toxic = 1) AS \"quality & toxic\", "
    "(quality = 1) OR (toxic = 1) AS \"quality | toxic\" FROM labels",
)
def combine_bool(spark, sf_dir):
    return load(spark, sf_dir, "labels").apply(Cast().then(Combine())).table("combine(labels)").data


@query("SELECT o_orderkey, o_custkey AS key FROM orders WHERE o_totalprice IS NOT NULL")
def edit_schema(spark, sf_dir):
    data = load(spark, sf_dir, "orders").apply(Rename(mapping={"o_custkey": "key"}))
    edited = with_attributes(data, {"orders": {"o_orderkey": [Attribute.primary_key], "key": [Attribute.textual]}})
    chosen = edited.table("orders")
    return chosen.select(
        [c for c in chosen.columns if c.attributes in ({Attribute.primary_key}, {Attribute.textual})],
    ).data


def _as_csv(spark, frame, name: str) -> str:
    """Write a frame as CSV to the shared folder, texts as they are."""
    path = f"{scratch_path(spark, 'csv')}/{name}.csv"
    frame.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_roundtrip_documents(spark, sf_dir):
    """Texts with quotes, commas and line breaks, through a CSV file."""
    return from_csv(spark, _as_csv(spark, read(spark, sf_dir, "documents"), "documents")).table("documents.csv").data


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_folder(spark, sf_dir):
    """All files of a folder; types are inferred."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    (table,) = from_csv_dir(spark, _as_csv(spark, nation.coalesce(1), "nation"))
    return table.data


@query("SELECT o_orderkey, o_totalprice FROM orders")
def known_upload(spark, sf_dir):
    """Known rows from an uploaded file, matched by name and cast to the known types."""
    orders = read(spark, sf_dir, "orders")
    path = _as_csv(spark, orders.select("o_totalprice", "o_orderstatus", "o_orderkey"), "orders")
    return read_known(spark, path, orders.select("o_orderkey", "o_totalprice"))


@query(
    "SELECT l_orderkey, l_linenumber, CAST(dense_rank() OVER (ORDER BY 'order ' || l_orderkey) - 1 AS BIGINT) AS number, "
    "l_linestatus = 'O' AS is_open FROM lineitem",
)
def encode_high_cardinality(spark, sf_dir):
    """A text of very many values becomes the number of its category, one of few values becomes dummies."""
    frame = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "concat('order ', l_orderkey) AS clerk", "l_linestatus AS status")
    lines = Table(name="lines", columns=[Column(name=c) for c in frame.columns], data=frame)
    marked = [dataclasses.replace(c, attributes={Attribute.categorical, Attribute.textual}) if c.name in ("clerk", "status") else c for c in lines.columns]
    (encoded,) = Dataset([lines.select(marked)]).apply(Encode(max_columns=1000))
    return encoded.data.select("l_orderkey", "l_linenumber", F.col("`id(clerk)`").alias("number"), F.col("`status == O`").alias("is_open"))


_TAXES = [n / 100 for n in range(9)]


@query(
    "SELECT "
    + ", ".join(f"CAST(count(*) FILTER (CAST(l_tax AS FLOAT) = CAST({t} AS FLOAT)) AS BIGINT) AS {dq(f'tax == {t}')}" for t in _TAXES)
    + " FROM lineitem",
)
def encode_float(spark, sf_dir):
    """Rows per category of a FLOAT column."""
    frame = read(spark, sf_dir, "lineitem").selectExpr("CAST(l_tax AS FLOAT) AS tax")
    (encoded,) = from_frames(spark, {"taxes": frame}).apply(Encode())
    return encoded.data.selectExpr(*(f"count_if({quote(f'tax == {t}')}) AS {quote(f'tax == {t}')}" for t in _TAXES))


@query(
    "SELECT l_returnflag, round(CAST(sum(CAST(l_partkey AS HUGEINT) * 1000000000000) / 1000000000000 AS DOUBLE), 0) AS total, "
    "count(*) AS n FROM lineitem GROUP BY l_returnflag",
)
def agg_large_integers(spark, sf_dir):
    """A sum beyond BIGINT."""
    frame = read(spark, sf_dir, "lineitem").selectExpr("l_returnflag", "l_partkey * 1000000000000L AS big")
    (grouped,) = from_frames(spark, {"t": frame}).apply(Aggregate(is_pivotable=["l_returnflag"]))
    return grouped.data.selectExpr(
        "l_returnflag", "round(CAST(`sum(big)` AS DOUBLE) / 1000000000000, 0) AS total", "`count(*)` AS n",
    )
