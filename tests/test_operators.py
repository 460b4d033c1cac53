from __future__ import annotations

import dataclasses
import datetime
import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from featloom import (
    Aggregate,
    Attribute,
    Cast,
    Collect,
    Column,
    Combine,
    Dataset,
    Drop,
    Encode,
    Extract,
    Filter,
    Identity,
    Impute,
    Join,
    Keep,
    Require,
    Table,
    Union,
    Window,
    clean,
    declare_key,
    from_frames,
    preview,
    profile,
    redact,
    table,
    with_attributes,
)
from featloom.functions import quote

A = Attribute


def cell(frame, column):
    return [r[0] for r in frame.select(F.col(quote(column))).collect()]


def attributes(t, name):
    return {a.name for a in t.column(name).attributes}


# --- profile -----------------------------------------------------------------------------


def test_profile_counts_null_as_a_value(spark):
    frame = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    (counts,) = profile(frame)
    assert (counts.rows, counts.nulls, counts.distinct, counts.exact) == (3, 1, 3, True)
    assert attributes(table(frame, "t"), "x") == {"numeric", "categorical", "primary_key"}


def test_profile_of_empty_and_single_row_tables(spark):
    assert attributes(table(spark.createDataFrame([], "x string"), "t"), "x") == {
        "textual", "categorical", "not_null", "primary_key",
    }
    one = table(spark.createDataFrame([(1.5, None)], "x double, y string"), "t")
    assert attributes(one, "x") == {"numeric", "categorical", "not_null", "primary_key"}
    assert attributes(one, "y") == {"textual", "categorical", "primary_key"}


def test_profile_limits(spark):
    frame = spark.range(200).selectExpr(
        "id", "id % 50 AS fifty", "id % 51 AS more", "CAST(id AS STRING) AS name", "array(id) AS nested",
        "CAST('2020-01-01' AS DATE) AS day",
    )
    t = table(frame, "t")
    assert attributes(t, "id") == {"numeric", "not_null", "primary_key"}
    assert attributes(t, "fifty") == {"numeric", "not_null", "categorical"}
    assert attributes(t, "more") == {"numeric", "not_null"}
    assert attributes(t, "name") == {"textual", "not_null", "primary_key"}
    assert attributes(t, "nested") == {"not_null"}
    assert attributes(t, "day") == {"temporal", "not_null", "categorical"}


def test_fast_and_exact_profile_agree_on_attributes(spark):
    frame = spark.range(5000).selectExpr("id", "id DIV 2 AS pairs", "id % 60 AS sixty", "hash(id) % 4900 AS noisy")
    fast, exact = table(frame, "t"), table(frame, "t", exact=True)
    assert [c.attributes for c in fast.columns] == [c.attributes for c in exact.columns]


# --- cast --------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("texts", "kind", "expected"),
    [
        (["2021-02-03"], "date", "2021-02-03"),
        (["2021-02-03T04:05:06"], "timestamp_ntz", "2021-02-03 04:05:06"),
        (["2021/02/03 04:05:06.5"], "timestamp_ntz", "2021-02-03 04:05:06.5"),
        (["09:30:05"], "time(6)", "09:30:05"),
    ],
)
def test_cast_texts(spark, texts, kind, expected):
    t = from_frames(spark, {"t": {"x": texts}}).apply(Cast()).table("t")
    assert t.data.schema["x"].dataType.simpleString() == kind
    assert cell(t.data.selectExpr("CAST(x AS STRING) AS x"), "x") == [expected]
    assert attributes(t, "x") == {"temporal"}


def test_cast_looks_at_every_row(spark):
    late = {"flag": [0, 1] * 6 + [2], "day": ["2021-02-03"] * 12 + ["soon"], "year": ["2021"] * 13}
    t = from_frames(spark, {"t": late}).apply(Cast()).table("t")
    assert [f.dataType.simpleString() for f in t.data.schema] == ["bigint", "string", "string"]


def test_cast_binary_and_empty(spark):
    t = from_frames(spark, {"t": {"flag": [0, 1, 1], "one": [1, 1, 1]}}).apply(Cast()).table("t")
    assert rows(t.data) == [(False, 1), (True, 1), (True, 1)]
    assert attributes(t, "flag") == {"boolean", "categorical", "not_null"}
    empty = from_frames(spark, {"t": spark.createDataFrame([], "x string, y int")}).apply(Cast()).table("t")
    assert [f.dataType.simpleString() for f in empty.data.schema] == ["string", "int"]


def test_cast_shrinks_integers_on_request(spark):
    t = from_frames(spark, {"t": {"x": [5, 300], "y": [-3, 100], "z": [2**40, 1]}}).apply(Cast(shrink=True)).table("t")
    assert [f.dataType.simpleString() for f in t.data.schema] == ["smallint", "tinyint", "bigint"]


# --- encode, impute, combine ----------------------------------------------------------------


def test_encode_order_labels_and_nulls(spark):
    frame = spark.createDataFrame(
        [(1, "b", True, 1.0), (2, "a", False, 2.5), (3, None, True, 1.0)], "id int, s string, b boolean, d double",
    )
    t = from_frames(spark, {"t": frame}).apply(Encode()).table("t")
    assert t.data.columns == [
        "id", "b", "d", "id == 1", "id == 2", "id == 3", "s", "s == a", "s == b", "b == False", "b == True",
        "d == 1.0", "d == 2.5",
    ]
    first = t.data.where("id = 3").first()
    assert first["s == a"] is None and first["b == True"] is True
    assert t.column("s == a").roots == {("s", "t")}


def test_encode_numbers_what_has_too_many_categories(spark):
    """One column of numbers in place of dummies, for the rows of the table only; dummies stay as they are."""
    frame = spark.range(200).selectExpr("CASE WHEN id % 9 = 0 THEN NULL ELSE concat('c', id % 60) END AS c", "id % 2 = 0 AS b")
    t = from_frames(spark, {"t": frame}).tables[0]
    marked = t.select([dataclasses.replace(x, attributes=x.attributes | {A.categorical}) for x in t.columns])
    few = marked.restrict("c > 'c3'", name="few")
    whole, part = Dataset([marked, few]).apply(Encode(max_columns=10)).tables
    assert whole.data.columns == ["b", "c", "id(c)", "b == False", "b == True"]
    for table, rows_of in ((whole, frame), (part, frame.where("c > 'c3'"))):
        order = {v: i for i, v in enumerate(sorted(r[0] for r in rows_of.select("c").distinct().collect() if r[0] is not None))}
        found = table.data.select("c", "`id(c)`").collect()
        assert len(found) == rows_of.count()
        assert all(number == order.get(c) for c, number in found)
    assert A.numeric in whole.column("id(c)").attributes and whole.column("id(c)").roots == {("c", "t")}


def test_sparse_dummies(spark):
    from featloom.plans.dictionary import sparse_dummies

    frame = spark.createDataFrame([(1, "b"), (2, None), (1, "a"), (None, "b")], "x int, y string")
    rows_of, order, words = sparse_dummies(frame, ["x", "y"])
    assert order == ["x", "y"] and rows(words["y"]) == [("a", 0), ("b", 1)]
    found = {(r.x, r.y): (r.dummies.size, r.dummies.indices.tolist()) for r in rows_of.collect()}
    assert {n for n, _ in found.values()} == {6}
    assert {k: i for k, (_, i) in found.items()} == {(1, "b"): [0, 4], (2, None): [1, 5], (1, "a"): [0, 3], (None, "b"): [2, 4]}


def test_impute_leaves_nan(spark):
    frame = spark.createDataFrame([(None, None, "x"), (float("nan"), True, None)], "d double, b boolean, s string")
    t = from_frames(spark, {"t": frame}).apply(Impute()).table("t")
    first, second = t.data.collect()
    assert tuple(first) == (0.0, False, "x")
    assert math.isnan(second["d"]) and second["s"] is None
    assert A.not_null in t.column("d").attributes
    again = Dataset([t]).apply(Impute()).table("t")
    assert str(rows(again.data)) == str(rows(t.data))


def test_combine_values(spark):
    frame = spark.createDataFrame(
        [(1, 6, 3, None), (2, 6, 0, True), (3, None, 2, True), (4, 1, None, False)],
        "id int, x int, y int, b boolean",
    ).withColumn("c", F.expr("id > 2"))
    declared = [
        Column(name="id", attributes={A.numeric, A.primary_key}),
        *(Column(name=n, attributes={A.numeric}) for n in "xy"),
        *(Column(name=n, attributes={A.boolean}) for n in "bc"),
    ]
    t = Dataset([Table(name="t", columns=declared, data=frame)]).apply(Combine()).table("combine(t)")
    assert t.data.columns == ["id", "x / y", "b & c", "b | c"]
    found = {r[0]: tuple(r)[1:] for r in t.data.collect()}
    assert found[1] == (2.0, False, None)
    assert math.isnan(found[2][0]) and found[2][1:] == (False, True)
    assert found[3] == (None, True, True)
    assert found[4] == (None, False, True)
    assert Dataset([t]).apply(Keep(columns=[("id", "combine(t)")])).apply(Combine()).tables == []


# --- filters ----------------------------------------------------------------------------------


def test_filter_needs_complete_booleans(spark):
    frame = spark.createDataFrame([(True, None), (False, True), (True, False)], "x boolean, y boolean")
    found = from_frames(spark, {"t": frame}).apply(Filter())
    assert [t.name for t in found] == ["filter(t, x)", "filter(t, not(x))"]
    assert [t.data.count() for t in found] == [2, 1]


def test_window(spark):
    frame = spark.sql(
        "SELECT DATE'2024-01-01' + CAST(id AS INT) AS day, "
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id AS INT)) AS at FROM range(10)",
    )
    now = datetime.datetime(2024, 1, 10)
    week = datetime.timedelta(days=7)
    found = from_frames(spark, {"t": frame}).apply(Window(periods=[week], as_of=now))
    assert [t.name for t in found] == ["window(t, 7 days, 0:00:00, day)", "window(t, 7 days, 0:00:00, at)"]
    assert [t.data.count() for t in found] == [8, 8]
    assert from_frames(spark, {"t": frame}).apply(Window(periods=[week])).tables[0].data.count() == 0


def test_window_is_pushed_into_the_scan(spark, tmp_path):
    spark.sql("SELECT id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS at FROM range(10)").write.parquet(f"{tmp_path}/t")
    data = from_frames(spark, {"t": spark.read.parquet(f"{tmp_path}/t")})
    recent = data.apply(Window(periods=[datetime.timedelta(days=1)], as_of=datetime.datetime(2024, 1, 2)))
    plan = recent.tables[0].data._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"),
    )
    assert "GreaterThanOrEqual(at" in plan


# --- projections ----------------------------------------------------------------------------------


def test_keep_drop_require_redact(spark):
    data = from_frames(spark, {"t": {"a": [1], "b": [2]}, "u": {"a": [3]}})
    shape = lambda d: {t.name: [c.name for c in t.columns] for t in d}
    assert shape(data.apply(Keep(columns=[("a", "t")]))) == {"t": ["a"]}
    assert shape(data.apply(Keep(columns=[]))) == shape(data)
    assert shape(data.apply(Keep(tables=["u"]))) == {"u": ["a"]}
    assert shape(data.apply(Drop(columns=[("a", "t"), ("a", "u")]))) == {"t": ["b"]}
    assert shape(data.apply(Drop(tables=["t"]))) == {"u": ["a"]}
    assert shape(data.apply(Require(predicate=lambda t: len(t.columns) > 1))) == {"t": ["a", "b"]}
    assert shape(redact(data, columns=[("b", "t")], tables=["u"])) == {"t": ["a"]}


def test_preview(spark):
    t = from_frames(spark, {"t": spark.range(50)}).table("t")
    assert cell(preview(t, 3, order_by=["id"]), "id") == [0, 1, 2]
    with pytest.raises(ValueError):
        preview(t, 0)


# --- union --------------------------------------------------------------------------------------


def test_union_by_name_with_wider_types(spark):
    frames = {
        "a": spark.createDataFrame([(1, "x"), (2, "y")], "n int, s string"),
        "b": spark.createDataFrame([("z", 2**40), ("z", 5)], "s string, n bigint"),
        "c": spark.createDataFrame([("other",)], "z string"),
        "d": spark.createDataFrame([("one", 1)], "n string, s int"),
    }
    data = from_frames(spark, frames).apply(Union())
    assert [t.name for t in data] == ["union(a, b, d)", "c"]
    merged = data.tables[0]
    assert rows(merged.data) == rows(
        spark.createDataFrame(
            [("1", "x"), ("2", "y"), (str(2**40), "z"), ("5", "z"), ("one", "1")], "n string, s string",
        ),
    )
    assert not merged.key
    assert merged.column("n").roots == {("n", "a"), ("n", "b"), ("n", "d")}


# --- joins ----------------------------------------------------------------------------------------


def keyed(spark, name, frame, key, **kinds):
    columns = [
        Column(
            name=f.name,
            attributes={kinds.get(f.name, A.numeric)} | ({A.primary_key} if f.name in key else set()),
        )
        for f in frame.schema
    ]
    return Table(name=name, columns=columns, data=frame)


def test_join_takes_new_columns_only(spark):
    lines = keyed(spark, "lines", spark.createDataFrame([(1, 5, 9), (3, 6, 9)], "k int, v int, same int"), [])
    heads = keyed(spark, "heads", spark.createDataFrame([(1, 7, 1), (2, 8, 2)], "k int, same int, w int"), ["k"])
    for order in ([lines, heads], [heads, lines]):
        joined = Dataset(order).apply(Join()).tables
        assert [t.name for t in joined] == ["join(lines, heads)"]
        assert rows(joined[0].data.select("k", "v", "same", "w")) == [(1, 5, 9, 1), (3, 6, 9, None)]


def test_join_skips_names_within_names_and_rejects_duplicates(spark):
    part = keyed(spark, "part", spark.createDataFrame([(1,)], "k int"), ["k"])
    partsupp = keyed(spark, "partsupp", spark.createDataFrame([(1, 2)], "k int, v int"), [])
    assert Dataset([part, partsupp]).apply(Join()).tables == []
    twice = keyed(spark, "twice", spark.createDataFrame([(1, 1), (1, 2)], "k int, w int"), ["k"])
    with pytest.raises(ValueError, match="not unique"):
        Dataset([partsupp, twice]).apply(Join())


def test_extract_values(spark):
    known = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (None, 13), (9, 14)], "k int, shared int")
    a = keyed(spark, "a", spark.createDataFrame([(1, 100, 5), (None, 300, 7)], "k int, shared int, longer int"), ["k"])
    b = keyed(spark, "b", spark.createDataFrame([(2, True)], "k int, flag boolean"), ["k"], flag=A.boolean)
    skipped = keyed(spark, "c", spark.createDataFrame([(2, 4)], "other int, z int"), ["other"])
    data = Dataset([a, b, skipped])
    wide = data.features(known, keep_known=True)
    assert wide.columns == ["k", "shared", "longer :: a", "shared :: a", "flag :: b"] or wide.columns == [
        "k", "shared", "shared :: a", "longer :: a", "flag :: b",
    ]
    found = rows(wide.select("k", "shared", "`shared :: a`", "`longer :: a`", "`flag :: b`"))
    # known values win, known rows stay as they are, null keys match nothing
    assert found == rows(
        spark.createDataFrame(
            [(1, 10, 10, 5, None), (1, 11, 11, 5, None), (2, 12, 12, None, True), (None, 13, 13, None, None),
             (9, 14, 14, None, None)],
            "a int, b int, c int, d int, e boolean",
        ),
    )
    extracted = data.apply(Extract(known=known))
    assert [t.name for t in extracted] == ["features(a)", "features(b)"]
    assert extracted.tables[0].column("longer :: a").roots == {("longer", "a"), ("k", "a")}


def test_extract_orders_features_by_length_of_name(spark):
    frame = spark.createDataFrame([(1, 1, 2, 3)], "k int, bbb int, aa int, cc int")
    known = spark.createDataFrame([(1,)], "k int")
    assert Dataset([keyed(spark, "t", frame, ["k"])]).features(known).columns == ["aa :: t", "cc :: t", "bbb :: t"]


def test_extract_rejects_duplicate_keys(spark):
    twice = keyed(spark, "t", spark.createDataFrame([(1, 1), (1, 2)], "k int, v int"), ["k"])
    with pytest.raises(ValueError, match="not unique"):
        Dataset([twice]).features(spark.createDataFrame([(1,)], "k int"))
    with pytest.raises(ValueError, match="no key"):
        declare_key(Dataset([twice]), "t", ["k"])


def test_extract_around_hot_keys(spark):
    """A key with most of the rows, many null keys, and two feature tables."""
    known = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id % 100 END AS k", "id AS row",
    )
    a = keyed(spark, "a", spark.range(50).selectExpr("id AS k", "id * 2 AS v"), ["k"])
    b = keyed(spark, "b", spark.range(5, 70).selectExpr("id AS k", "id * 3 AS w"), ["k"])
    plain = Dataset([a, b]).apply(Extract(known=known))
    split = Dataset([a, b]).apply(Extract(known=known, row_limit=100))
    from featloom import assemble

    assert rows(assemble(split, known)) == rows(assemble(plain, known))
    assert assemble(split, known).count() == 3000


# --- aggregation ------------------------------------------------------------------------------------


EDGE = [
    ("one", 5.0), ("nulls", None), ("nulls", None), ("nan", float("nan")), ("nan", 1.0), ("nan", 3.0),
    (None, 2.0), (None, 4.0), ("many", 1.0), ("many", 2.0), ("many", 4.0),
]


def edge_table(spark):
    frame = spark.createDataFrame(EDGE, "k string, x double")
    return Table(
        name="t",
        columns=[Column(name="k", attributes={A.textual}), Column(name="x", attributes={A.numeric, A.categorical})],
        data=frame,
    )


def check_edges(result):
    found = {r["k"]: r for r in result.data.collect()}
    assert set(found) == {"one", "nulls", "nan", None, "many"}
    assert found["one"]["std(x)"] is None and found["one"]["var(x)"] is None and found["one"]["median(x)"] == 5.0
    assert found["nulls"]["sum(x)"] == 0.0 and found["nulls"]["count(*)"] == 2
    assert all(found["nulls"][f"{s}(x)"] is None for s in ("max", "min", "mean", "median", "std", "var"))
    assert (found["nan"]["min(x)"], found["nan"]["max(x)"]) == (1.0, 3.0)
    assert all(math.isnan(found["nan"][f"{s}(x)"]) for s in ("mean", "sum", "std", "var"))
    assert found[None]["mean(x)"] == 3.0 and found[None]["count(*)"] == 2
    many = found["many"]
    assert [many[f"{s}(x)"] for s in ("max", "mean", "median", "min", "sum")] == [4.0, 7 / 3, 2.0, 1.0, 7.0]
    assert many["var(x)"] == pytest.approx(7 / 3) and many["std(x)"] == pytest.approx((7 / 3) ** 0.5)


@pytest.mark.parametrize("row_limit", [1000, 2])
def test_aggregate_edges(spark, row_limit):
    """The second limit makes every group but one hot."""
    grouped = Dataset([edge_table(spark)]).apply(Aggregate(is_pivotable=["k"], row_limit=row_limit))
    (result,) = grouped.tables
    assert result.name == "group_by(t, k)" and result.key == ["k"]
    assert attributes(result, "count(*)") == {"numeric", "not_null"}
    assert attributes(result, "sum(x)") == {"numeric", "categorical", "not_null"}
    assert attributes(result, "std(x)") == {"numeric", "categorical"}
    check_edges(result)


def events(spark):
    frame = spark.range(4000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 40 END AS k",
        "CASE WHEN id % 11 = 0 THEN NULL ELSE CAST(pmod(hash(id), 500) AS DOUBLE) / 7 END AS x",
        "id % 5 = 0 OR id % 40 = 39 AS f", "id % 40 < 20 AS g",
    )
    columns = [
        Column(name="k", attributes={A.numeric, A.not_null}),
        Column(name="x", attributes={A.numeric}),
        *(Column(name=n, attributes={A.boolean, A.not_null}) for n in "fg"),
    ]
    return Table(name="e", columns=columns, data=frame)


@pytest.mark.parametrize("row_limit", [10_000, 90])
def test_fused_aggregates_equal_separate_ones(spark, row_limit):
    aggregate = Aggregate(is_pivotable=["k"], row_limit=row_limit)
    filtered = Dataset([events(spark)]).apply(Identity().then(Identity(), Filter())).tables
    fused = Dataset(filtered).apply(aggregate)
    assert len({id(t.frame) for t in fused}) == 1
    separate = [Dataset([t]).apply(Aggregate(is_pivotable=["k"])).tables[0] for t in filtered]
    assert len({id(t.frame) for t in separate}) == len(filtered)

    def rounded(frame):
        return rows(frame.selectExpr(*(f"round({quote(c)}, 9) AS {quote(c)}" for c in frame.columns)))

    for one, other in zip(fused, separate):
        assert one.name == other.name
        assert rounded(one.data) == rounded(other.data)
    known = spark.range(45).selectExpr("CAST(id AS INT) AS k")
    assert rounded(fused.features(known)) == rounded(Dataset(separate).features(known))


def test_aggregate_by_several_pivots(spark):
    frame = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (2, 2, 5.0)], "a int, b int, x double")
    t = Table(name="t", columns=[Column(name=n, attributes={A.numeric}) for n in "abx"], data=frame)
    found = Dataset([t]).apply(Aggregate(is_pivotable=["a", "b"], max_pivots=2))
    assert [t.name for t in found] == ["group_by(t, a)", "group_by(t, b)", "group_by(t, a, b)"]
    assert rows(found.tables[2].data.select("a", "b", "`sum(x)`")) == [(1, 1, 2.0), (1, 2, 3.0), (2, 2, 5.0)]


@pytest.mark.parametrize("row_limit", [10_000, 20])
def test_pivots_share_one_scan(spark, tmp_path, monkeypatch, row_limit):
    """Three pivots with null keys, a filter and hot groups: what separate aggregates give, from one plan."""
    from featloom.operators import aggregate as module

    spark.range(3000).selectExpr(
        "CASE WHEN id % 7 < 2 THEN NULL ELSE id % 7 END AS a",
        "CASE WHEN id % 3 = 0 THEN NULL ELSE concat('b', id % 3) END AS b",
        "id % 2 = 0 AS c",
        "CASE WHEN id % 11 = 0 THEN NULL ELSE CAST(pmod(hash(id), 50) AS DOUBLE) END AS x",
    ).write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    columns = [Column(name=n, attributes={A.numeric, A.categorical}) for n in "abcx"]
    whole = Table(name="t", columns=columns, data=frame, max_rows=3000)
    tables = [whole, whole.restrict("x < 25", name="small")]
    plans = []

    def recorded(*args, **options):
        plans.append(grouped_statistics(*args, **options))
        return plans[-1]

    grouped_statistics = module.grouped_statistics
    monkeypatch.setattr(module, "grouped_statistics", recorded)
    pivots = Aggregate(is_pivotable=["a", "b", "c"], max_pivots=3, row_limit=row_limit)
    fused = list(Dataset(tables).apply(pivots))
    assert len(plans) == 1
    if row_limit == 10_000:
        assert str(plans[0]._jdf.queryExecution().executedPlan()).count("FileScan") == 1
    names = ["a", "b", "c", "a, b", "a, c", "b, c", "a, b, c"]
    assert [t.name for t in fused] == [f"group_by({t}, {n})" for t in ("t", "small") for n in names]
    for made, (table, keys) in zip(fused, [(t, n.split(", ")) for t in tables for n in names]):
        assert made.key == keys
        expected = table.data.groupBy(*keys).agg(
            F.count("*"), F.max("x"), F.mean("x"), F.expr("median(x)"), F.min("x"), F.stddev("x"), F.expr("coalesce(sum(x), 0)"), F.variance("x"),
        )
        rounded = [[f"round({quote(c)}, 6)" if c not in keys else c for c in f.columns] for f in (made.data, expected)]
        assert rows(made.data.selectExpr(*rounded[0])) == rows(expected.selectExpr(*rounded[1]))
    assert {t.frame for t in fused[:7]} == {t.frame for t in fused[7:]}, "filters share the frame of their pivots"


def test_sketched_medians(spark):
    frame = spark.range(60_000).selectExpr("id % 3 AS k", "CAST(pmod(hash(id), 20011) AS DOUBLE) AS x")
    data = from_frames(spark, {"t": frame})
    made = data.apply(Aggregate(is_pivotable=["k"], exact=False)).tables[0].data.select("k", F.col("`median(x)`").alias("m"))
    ranks = frame.join(made, "k").groupBy("k").agg(F.expr("count_if(x < m)").alias("under"), F.expr("count_if(x <= m)").alias("upto"), F.count("*").alias("n"))
    assert all(r.under - 3 <= r.n / 2 <= r.upto + 3 for r in ranks.collect())


@pytest.mark.parametrize("durable", [False, True])
def test_collect_and_clean(spark, durable):
    data = from_frames(spark, {"t": {"flag": [0, 1, 1], "name": ["a", "b", "b"]}})
    done = clean(data).apply(Collect(durable=durable)).table("t")
    assert done.data.columns == ["flag", "flag == False", "flag == True", "name", "name == a", "name == b"]
    assert rows(done.data)[0][:3] == (False, True, False)


# --- sums beyond BIGINT, dummies of narrow types ---------------------------------------------------------


def test_sums_of_large_integers_do_not_overflow(spark):
    frame = spark.range(20).selectExpr("id % 2 AS k", "9000000000000000000L + id DIV 4 AS x")
    made = from_frames(spark, {"t": frame}).apply(Aggregate(is_pivotable=["k"])).tables[0].data
    row = next(r for r in made.collect() if r["k"] == 0)
    assert int(row["sum(x)"]) == 10 * 9 * 10**18 + 20 and row["mean(x)"] == pytest.approx(9e18)


@pytest.mark.parametrize("kind", ["float", "double", "decimal(5,2)", "tinyint", "date", "timestamp", "timestamp_ntz"])
def test_dummies_hold_for_every_type(spark, kind):
    values = {"date": ["2021-03-28", "2020-01-01"], "tinyint": ["7", "-3"]}.get(kind) or (
        ["2021-03-28 01:30:00.5", "2020-01-01 00:00:00"] if "timestamp" in kind else ["0.1", "2.25"]
    )
    frame = spark.createDataFrame([(values[i % 2],) for i in range(8)], "v string").selectExpr(f"CAST(v AS {kind}) AS x")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        table = from_frames(spark, {"t": frame}).tables[0]
        marked = [dataclasses.replace(c, attributes=c.attributes | {Attribute.categorical}) for c in table.columns]
        encoded = Dataset([table.select(marked)]).apply(Encode()).tables[0]
        dummies = [quote(c.name) for c in encoded.columns if "==" in c.name]
        assert len(dummies) == 2
        counts = encoded.data.selectExpr(*(f"count_if({d}) AS n{i}" for i, d in enumerate(dummies))).first()
        assert tuple(counts) == (4, 4)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
