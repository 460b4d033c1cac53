from __future__ import annotations

import hypothesis.strategies as st
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from pyspark.sql import functions as F

from conftest import rows
from featloom.plans import grouping
from featloom.plans.grouping import Slice, grouped_statistics
from featloom.plans.groupscan import scan_groups
from featloom.plans.ordering import ordered_split, running_total
from featloom.plans.quantiles import grouped_quantiles
from featloom.plans.skew import find_hot_groups, split_left_join
from featloom.plans.storage import materialise, shared_folder


def skewed(spark, n=5000):
    return spark.range(n).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 17 = 0 THEN NULL ELSE CAST(id % 20 AS STRING) END AS k",
        "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 THEN 4.5 ELSE CAST(pmod(hash(id), 1000) AS DOUBLE) END AS x",
    )


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("row_limit", [3, 100])
def test_quantiles_of_hot_groups(spark, keys, row_limit):
    frame = skewed(spark)
    targets = {"a": ("x", 0.5), "b": ("x", 0.25), "c": ("CASE WHEN x < 300 THEN x END", 0.9), "d": ("x", 1.0)}
    found = rows(grouped_quantiles(frame, keys, targets, row_limit=row_limit))
    builtin = [F.expr(f"percentile({sql}, {p}D)").alias(n) for n, (sql, p) in targets.items()]
    assert [tuple(map(_rounded, r)) for r in found] == [
        tuple(map(_rounded, r)) for r in rows(frame.groupBy(*keys).agg(*builtin))
    ]


def _rounded(value):
    return round(value, 9) if isinstance(value, float) else value


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_quantiles_of_any_values(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    (found,) = grouped_quantiles(frame, [], {"m": ("x", 0.5), "q": ("x", 0.3)}, row_limit=2).collect()
    assert found["m"] == pytest.approx(np.quantile(values, 0.5), rel=1e-9, abs=1e-9)
    assert found["q"] == pytest.approx(np.quantile(values, 0.3), rel=1e-9, abs=1e-9)


def test_hot_groups(spark):
    hot = find_hot_groups(skewed(spark), ["k"], row_limit=1000)
    assert (rows(hot.keys), hot.count) == ([("hot",)], 1)
    assert find_hot_groups(skewed(spark), ["k"], row_limit=2000) is None
    assert find_hot_groups(spark.createDataFrame([], "k int"), ["k"], row_limit=1) is None


@pytest.mark.parametrize("row_limit", [5000, 20])
def test_radix_selection(spark, row_limit):
    """Any sign and magnitude, dense prefixes, infinities, NaN, ties, groups without values; at most three scans."""
    from featloom.plans import quantiles

    pick = np.random.default_rng(3)
    groups = {
        "wide": pick.standard_normal(900) * 10.0 ** pick.integers(-300, 300, 900),
        "dense": 1000 + pick.random(900) * 1e-9,
        "close": np.nextafter(1.0, 2) + np.arange(900) * 2.0**-52,
        "ties": pick.integers(-3, 4, 900).astype(float),
        "ends": np.array([-np.inf, np.inf, 0.0, -0.0, 5e-324, -5e-324, 1.7e308] * 30),
        "nan": np.array([np.nan] * 70 + [1.0] * 30),
        "one": np.array([7.0]),
    }
    data = [(k, float(v)) for k, values in groups.items() for v in values] + [("none", None)] * 30 + [(None, 2.0)] * 40
    frame = spark.createDataFrame(data, "k string, x double")
    targets = {f"q{p}": ("x", p) for p in (0.0, 0.25, 0.5, 0.9, 1.0)}
    found = quantiles.hot_quantiles(frame, ["k"], targets, row_limit=row_limit)
    expected = frame.groupBy("k").agg(*(F.expr(f"percentile(x, {p}D)").alias(n) for n, (_, p) in targets.items()))
    def shown(row):
        return [-123.5 if v is None else v for v in row[1:]]

    same = {r[0]: shown(r) for r in expected.collect()}
    for row in found.collect():
        assert shown(row) == pytest.approx(same.pop(row[0]), rel=1e-12, nan_ok=True), row
    assert not same
    whole = quantiles.hot_quantiles(frame.where("k <> 'nan'"), [], targets, row_limit=row_limit).collect()
    assert whole[0] == pytest.approx(frame.where("k <> 'nan'").agg(*(F.expr(f"percentile(x, {p}D)") for _, p in targets.values())).first(), rel=1e-12)


def test_radix_selection_reads_three_times(spark, tmp_path, monkeypatch):
    """Two or three scans of the input for all groups and targets."""
    from featloom.plans import quantiles

    spark.range(5000).selectExpr("id % 3 AS k", "pmod(hash(id), 1000) / 8 AS x", "1000 + rand(1) AS y").write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    scans = []

    def counted(part, label):
        scans.append(str(part._jdf.queryExecution().executedPlan()).count("/t]"))
        return materialise(part, label)

    monkeypatch.setattr(quantiles, "materialise", counted)
    found = quantiles.hot_quantiles(frame, ["k"], {"a": ("x", 0.5), "b": ("y", 0.1)}, row_limit=20)
    scans.append(str(found._jdf.queryExecution().executedPlan()).count("/t]"))
    assert scans == [1, 1, 1]


def test_split_left_join(spark):
    left = skewed(spark)
    right = spark.range(10).selectExpr("CAST(id AS STRING) AS k", "id AS v").unionByName(
        spark.createDataFrame([("hot", 99), (None, -1)], "k string, v bigint"),
    )
    assert rows(split_left_join(left, right, ["k"], row_limit=100)) == rows(left.join(right, ["k"], "left"))


def test_running_total(spark):
    frame = spark.range(1000).selectExpr("id AS a", "id % 7 AS n")
    found = {r["a"]: r["before"] for r in running_total(frame, [F.col("a")], "n", "before").collect()}
    total = 0
    for i in range(1000):
        assert found[i] == total
        total += i % 7


@pytest.mark.parametrize(("n", "share"), [(10, 0.8), (7, 0.8), (1, 0.8), (1000, 0.8), (1000, 1.0), (1000, 0.0)])
def test_ordered_split(spark, n, share):
    frame = spark.range(n).selectExpr("id", "id * 37 % 1009 AS o")
    split = ordered_split(frame, [F.col("o")], share, "first")
    ordered = [r["first"] for r in split.orderBy("o").collect()]
    assert ordered == [i < int(share * n + 1e-9) for i in range(n)]


def test_ordered_split_with_ties_has_the_exact_size(spark):
    frame = spark.range(999).selectExpr("id", "id % 2 AS o")
    assert ordered_split(frame, [F.col("o")], 0.8, "first").where("first").count() == 799


def test_materialise_uses_the_shared_folder(spark):
    folder = shared_folder(spark)
    assert spark.sparkContext.getCheckpointDir() is not None
    written = materialise(spark.range(5).toDF("a b (c)"), "check")
    assert all(f.startswith(("file:", folder)) for f in written.inputFiles())
    assert written.count() == 5


def test_scanned_groups_equal_built_in_aggregates(spark, monkeypatch):
    nan = float("nan")
    data = [
        (k, s, v, w, big, f)
        for k, s in ((None, "a"), (1, "a"), (1, None), (2, "b"), (3, "c"))
        for v, w, big, f in (
            (1.5, 1, 2**62, True), (nan, None, 2**62 + 1, False), (None, -7, -(2**62), None),
            (float("inf"), 3, None, True), (-0.5, 4, 5, k != 3),
        )[: 1 + (k or 4)]
    ]
    frame = spark.createDataFrame(data, "k int, s string, v double, w int, big long, f boolean").repartition(3)
    keys, values = {"k": "k", "s": "s"}, {"v": "v", "w": "w", "big": "big"}
    slices = [Slice("all ", None), Slice("some ", "f"), Slice("none ", "false")]
    scanned = grouped_statistics(frame, keys, values, slices)
    assert "MapInArrow" in scanned._jdf.queryExecution().toString()
    monkeypatch.setattr(grouping, "scannable", lambda *_: False)
    built_in = grouped_statistics(frame, keys, values, slices)
    assert scanned.schema.simpleString() == built_in.schema.simpleString()

    def rounded(made):
        return [tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in row) for row in rows(made)]

    assert str(rounded(scanned)) == str(rounded(built_in))


def test_scanned_groups_are_not_cut_by_batches(spark):
    frame = spark.range(30_000).selectExpr("id % 7 AS k", "CAST(id AS DOUBLE) AS v").union(spark.range(500).selectExpr("id + 100", "1D"))
    frame = frame.repartition(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        found = scan_groups(frame.withColumnRenamed("v", "value 0"), ["k"], [frame.schema["v"].dataType], [None], chunk=250).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = {row["k"]: (row["rows 0"], row["median 0 0"]) for row in found}
    own = list(range(3, 30_000, 7))
    assert len(found) == len(sizes) == 507 and sizes[3] == (len(own), float(np.median(own)))


def test_large_groups_of_several_sets_repeat_partial_results(spark, monkeypatch):
    """Rows of hot groups are never repeated per set; all statistics equal those of complete aggregation."""
    frame = spark.range(6000).selectExpr(
        "CASE WHEN id % 7 > 0 THEN id % 3 END AS a", "CASE WHEN id < 5990 THEN concat('b', id % 2) ELSE 'rare' END AS b",
        "1e9D + pmod(hash(id), 50) AS x", "CASE WHEN id % 5 > 0 THEN 4000000000000000L + id % 97 * 1000000000000L END AS y",
        "CAST(pmod(hash(id, 1), 60) / 10 AS DECIMAL(9, 2)) AS z", "CASE WHEN id % 1999 = 0 THEN CAST('NaN' AS DOUBLE) ELSE id % 40 END AS w",
    )
    sets = [["a"], ["b"], ["a", "b"]]
    names = {c: c for c in "xyzw"}

    def found(row_limit):
        pieces = [grouping.Slice("", None), grouping.Slice("few: ", "x < 1e9D + 10")]
        made = grouping.grouped_statistics(frame, {"a": "a", "b": "b"}, names, pieces, row_limit=row_limit, sets=sets)
        return {(r[0], r["a"], r["b"]): r.asDict() for r in made.collect()}

    seen, single = [], grouping._of_hot_groups

    def recorded(rows, *args):
        seen.append(rows.count())
        return single(rows, *args)

    expected = found(10_000_000)
    monkeypatch.setattr(grouping, "_of_hot_groups", recorded)
    made = found(100)
    assert seen and max(seen[:3]) < 6000  # sizes, partial statistics and counts; not 3 x 6000 rows for each scan
    assert made.keys() == expected.keys()
    for key, row in made.items():
        for name, value in row.items():
            other = expected[key][name]
            if isinstance(value, float) and not np.isnan(value):
                assert abs(value - other) <= 1e-6 * max(1.0, abs(other)), (key, name)
            else:
                assert value == other or np.isnan(value) and np.isnan(other), (key, name)
