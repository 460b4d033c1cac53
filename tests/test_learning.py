from __future__ import annotations

import dataclasses
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from featloom import (
    Aggregate,
    Attribute,
    Column,
    Combine,
    Dataset,
    Identity,
    Problem,
    Table,
    declare_key,
    from_frames,
    suggest_problem,
)
from featloom.learning import (
    PREDICTION_METHODS,
    Baseline,
    BoostedTrees,
    Boruta,
    Correlation,
    FeatureImportance,
    Model,
    MutualInformation,
    PermutationImportance,
    RandomForest,
    ShapelyImpact,
    feature_matrix,
    pair_correlations,
)
from featloom.learning import predictors, rank_correlation, trees
from featloom.learning.matrix import filled, indexed, summarise, vectors, with_donors
from featloom.learning.model import Round
from featloom.learning.matrix import decode_labels, encode_labels
from featloom.learning.rank_correlation import signed_pairs
from featloom.learning.selectors import binomial_tail, mutual_information, permutation_losses, top
from featloom.plans.quantiles import _ranked, array_quantiles
from featloom.learning.trees import explain, leaf_values, mean_impacts, read_ensemble


@pytest.fixture(scope="module")
def numbers(spark):
    """Features a (decides), b (helps), c (noise), d (copy of a), e (constant), f (has gaps)."""
    rng = np.random.default_rng(3)
    n = 600
    a, b, c = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    f = np.where(rng.random(n) < 0.3, np.nan, np.round(a + rng.normal(size=n), 1))
    score = a + 0.5 * b
    frame = pd.DataFrame(
        {"a": a, "b": b, "c": c, "d": 2 * a + 1, "e": 1.0, "f": f, "score": score,
         "two": (score > 0).astype(int), "three": np.where(score > 0.7, "hi", np.where(score < -0.7, "lo", "mid"))},
    )
    return spark.createDataFrame(frame).repartition(3).cache(), frame


NAMES = list("abcdef")


def two_classes(numbers):
    return feature_matrix(numbers[0], NAMES, "two", Problem.classification)


# --- matrix --------------------------------------------------------------------------------------


def test_matrix_of_missing_and_infinite_values(spark):
    frame = spark.createDataFrame(
        [(1.0, None, True, 0), (float("nan"), 2, None, 1), (float("inf"), 3, False, 0)],
        "x double, y int, z boolean, t int",
    )
    matrix = feature_matrix(frame, ["x", "y", "z"], "t", Problem.classification)
    assert [(s.present, s.mean) for s in summarise(matrix)] == [(1, 1.0), (2, 2.5), (2, 0.5)]
    found = filled(matrix.frame, [-1.0, -2.0, -3.0]).collect()
    assert [r["features"] for r in found] == [[1.0, -2.0, 1.0], [-1.0, 2.0, -3.0], [-1.0, 3.0, 0.0]]


def test_summary_and_fills(numbers):
    found = summarise(two_classes(numbers))
    pdf = numbers[1]
    for name, s in zip(NAMES, found):
        assert s.present == pdf[name].count()
        assert (s.mean, s.low, s.high) == pytest.approx((pdf[name].mean(), pdf[name].min(), pdf[name].max()))
    fitted = RandomForest().fit(two_classes(numbers))
    assert fitted.fills[5] < pdf.f.min()


def test_pairs_computed_in_tasks_equal_their_sql(spark):
    frame = spark.createDataFrame(
        [(1, 6.0, 3.0, True, None), (2, 6.0, 0.0, False, None), (3, None, 2.0, True, True), (4, 1.0, None, None, False)],
        "k int, x double, y double, b boolean, c boolean",
    )
    columns = [
        Column(name="k", attributes={Attribute.primary_key, Attribute.numeric}),
        *(Column(name=n, attributes={Attribute.numeric}) for n in "xy"),
        *(Column(name=n, attributes={Attribute.boolean}) for n in "bc"),
    ]
    data = Dataset([Table(name="t", columns=columns, data=frame, unique_on=["k"])])
    both = data.apply(Identity().then(Identity(), Combine()))
    from featloom import Extract, assemble

    known = frame.selectExpr("k", "k % 2 AS label")
    extracted = both.apply(Extract(known=known))
    wide = assemble(extracted, known)
    assert len(extracted.tables[0].frame.columns) == len(known.columns) + 4 + 4
    cells = {c.name: t.expr(c) for t in extracted for c in t.columns}
    pairs = {n: p for t in extracted for n, p in t.pairs.items()}
    fast = feature_matrix(extracted.tables[0].frame, cells, "label", Problem.regression, extra=["k"], pairs=pairs)
    slow = feature_matrix(wide, list(cells), "label", Problem.regression, extra=["k"])
    assert len(pairs) == 3 and fast.names == slow.names
    # missing values are NaN on one side and null on the other
    assert rows(filled(fast.frame, [-9.0] * 7)) == rows(filled(slow.frame, [-9.0] * 7))


def test_donors_are_a_permutation(numbers):
    numbered, n = indexed(two_classes(numbers).frame.select("features", "label"))
    assert n == 600 and [r["index"] for r in numbered.orderBy("index").collect()] == list(range(600))
    donated = with_donors(numbered, n, seed=5).select("features", "donor").toPandas()
    own, given = ([tuple(np.nan_to_num(v)) for v in donated[c]] for c in ("features", "donor"))
    assert sorted(own) == sorted(given) and sum(a == b for a, b in zip(own, given)) < 30


def test_labels_of_many_classes(spark):
    """Numbers of the sorted classes by a join, and back."""
    frame = spark.range(3000).selectExpr("CASE WHEN id % 100 = 7 THEN NULL ELSE concat('k', id % 700) END AS k", "CAST(id AS DOUBLE) AS x")
    matrix = feature_matrix(frame, ["x"], "k", Problem.classification)
    assert matrix.classes == sorted(matrix.classes) and len(matrix.classes) == 693
    encoded, classes = encode_labels(frame, "k")
    back = decode_labels(encoded, classes, name="again").collect()
    assert len(back) == 3000 and all(r["k"] == r["again"] for r in back)
    label = {r["x"]: r["label"] for r in back}
    for row in matrix.frame.collect():
        assert row["label"] == label[row["features"][0]]


@pytest.mark.parametrize(
    ("target", "method"),
    [("three", RandomForest()), ("two", BoostedTrees()), ("three", BoostedTrees()), ("score", RandomForest()), ("score", BoostedTrees())],
)
def test_permutation_losses_against_scoring_every_variant(numbers, target, method):
    """What the model itself says to rows with one feature replaced, feature by feature."""
    problem = Problem.regression if target == "score" else Problem.classification
    matrix = feature_matrix(numbers[0], NAMES, target, problem)
    matrix = dataclasses.replace(matrix, frame=matrix.frame.where("label IS NOT NULL"))
    fitted = method.fit(matrix)
    numbered, n = indexed(matrix.frame.select("features", "label"))
    donated = with_donors(numbered, n, 5)
    good = "avg(CAST(prediction = label AS DOUBLE))" if problem is Problem.classification else "1 - avg(pow(prediction - label, 2)) / var_pop(label)"
    intact = fitted.score(numbered).agg(F.expr(good)).first()[0]
    losses = permutation_losses(matrix, fitted, repeats=1, seed=5)
    for feature in range(matrix.width):
        swapped = donated.withColumn("features", F.expr(f"transform(features, (x, i) -> if(i = {feature}, donor[i], x))"))
        expected = intact - fitted.score(swapped).agg(F.expr(good)).first()[0]
        assert losses[feature] == [pytest.approx(expected, abs=1e-9)]


# --- correlation ------------------------------------------------------------------------------------


def correlations(matrix, method):
    return {(r["i"], r["j"]): r["r"] for r in pair_correlations(matrix, method).collect()}


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlation_against_pandas(numbers, method):
    expected = numbers[1][NAMES].corr() if method == "pearson" else None
    found = correlations(two_classes(numbers), method)
    assert set(found) == set(itertools.combinations(range(6), 2))
    for (i, j), r in found.items():
        pair = numbers[1][[NAMES[i], NAMES[j]]].dropna()
        if method == "spearman":
            pair = pair.rank()
        e = expected.iloc[i, j] if expected is not None else pair.corr().iloc[0, 1]
        assert (r is None and math.isnan(e)) or r == pytest.approx(e, abs=1e-9)


def brute_tau(x, y):
    dx, dy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    spread = math.sqrt((dx != 0).sum()) * math.sqrt((dy != 0).sum())
    return (dx * dy).sum() / spread if spread else None


@pytest.mark.parametrize("strip_rows", [100_000, 150])
def test_kendall_against_all_pairs(spark, strip_rows, monkeypatch):
    monkeypatch.setattr(rank_correlation, "STRIP_ROWS", strip_rows)
    rng = np.random.default_rng(1)
    x = np.where(rng.random(500) < 0.35, 3.0, rng.integers(0, 60, 500))
    y = np.where(rng.random(500) < 0.35, 7.0, np.round(x / 3 + rng.normal(size=500) * 8))
    z = np.where(rng.random(500) < 0.2, np.nan, rng.normal(size=500))
    frame = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "z": z, "one": 1.0, "t": 1.0}))
    found = correlations(feature_matrix(frame, ["x", "y", "z", "one"], "t", Problem.regression), "kendall")
    keep = ~np.isnan(z)
    assert found[(0, 1)] == pytest.approx(brute_tau(x, y))
    assert found[(0, 2)] == pytest.approx(brute_tau(x[keep], z[keep]))
    assert found[(1, 2)] == pytest.approx(brute_tau(y[keep], z[keep]))
    assert found[(0, 3)] is None


@pytest.mark.parametrize("method", ["spearman", "kendall"])
def test_rank_correlations_take_as_many_jobs_for_more_pairs(spark, method):
    frame = spark.range(300).selectExpr(
        *(f"CASE WHEN id % {k + 2} = 0 THEN NULL ELSE CAST(pmod(hash(id, {k}), 40) AS DOUBLE) END AS f{k}" for k in range(6)), "1D AS t",
    )
    jobs = []
    for width in (3, 6):
        matrix = feature_matrix(frame, [f"f{k}" for k in range(width)], "t", Problem.regression)
        spark.sparkContext.setJobGroup(f"{method} {width}", "pairs")
        assert len(correlations(matrix, method)) == width * (width - 1) // 2
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{method} {width}")))
    spark.sparkContext.setJobGroup(None, None)
    assert abs(jobs[0] - jobs[1]) <= 2, jobs


def test_kendall_of_one_heavy_value(spark, monkeypatch):
    """A value with most points is a strip of its own, and strips of strips are compared again."""
    monkeypatch.setattr(rank_correlation, "STRIP_ROWS", 60)
    rng = np.random.default_rng(4)
    x = np.where(rng.random(300) < 0.6, 5.0, rng.normal(size=300) * 9)
    y = rng.normal(size=300) + x / 9
    frame = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "t": 1.0}))
    found = correlations(feature_matrix(frame, ["x", "y"], "t", Problem.regression), "kendall")
    assert found[(0, 1)] == pytest.approx(brute_tau(x, y))


def test_signed_pairs():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 64):
        points = {(a, b) for a, b in rng.integers(0, 9, (n, 2))}
        x, y = (np.array(v, dtype=float) for v in zip(*points))
        w = rng.integers(1, 5, len(points)).astype(float)
        expected = sum(
            w[i] * w[j] * np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
            for i, j in itertools.combinations(range(len(points)), 2)
        )
        assert signed_pairs(pd.Series(x), pd.Series(y), pd.Series(w)) == pytest.approx(expected)


# --- selectors -----------------------------------------------------------------------------------------


def test_correlation_selector_keeps_the_last_of_a_group(numbers):
    assert Correlation(max=0.9).select(two_classes(numbers)) == [False, True, True, True, True, True]
    one = two_classes(numbers).take([4])
    assert Correlation().select(one) == [True]


def test_selectors_keep_everything_that_fits(numbers):
    matrix = two_classes(numbers)
    for selector in (
        FeatureImportance(n=6, predictor=RandomForest()),
        ShapelyImpact(n=9, predictor=RandomForest()),
        PermutationImportance(n=6, predictor=RandomForest()),
        MutualInformation(n=6, problem=Problem.classification),
    ):
        assert selector.select(matrix) == [True] * 6


def test_selectors_find_the_features_that_matter(numbers):
    matrix = two_classes(numbers).take([0, 1, 2, 4])
    for selector in (
        ShapelyImpact(n=2, predictor=RandomForest()),
        PermutationImportance(n=2, predictor=RandomForest(), repeats=3),
        MutualInformation(n=2, problem=Problem.classification),
    ):
        assert selector.select(matrix) == [True, True, False, False], selector
    # at least as important as the mean: only the deciding one
    assert FeatureImportance(n=3, predictor=RandomForest()).select(matrix) == [True, False, False, False]


def test_boruta(numbers):
    matrix = two_classes(numbers).take([0, 2, 4])
    kept = Boruta(importance="gini", predictor=RandomForest(), problem=Problem.classification, trials=7).select(matrix)
    assert kept[0] and not kept[2]


def test_top_and_binomial_tail():
    assert top([1.0, 3.0, 3.0, 2.0], 2) == [False, True, True, False]
    assert top([1.0, 1.0], 1) == [True, False]
    assert binomial_tail(0, 5) == 1 and binomial_tail(5, 5) == 1 / 32 and binomial_tail(4, 5) == 6 / 32


def test_mutual_information_of_known_tables(spark):
    frame = spark.range(400).selectExpr(
        "CAST(id % 2 AS DOUBLE) AS same", "CAST(id DIV 2 % 2 AS DOUBLE) AS none", "id % 2 AS label",
        "CASE WHEN id % 2 = 0 THEN NULL ELSE 5 END AS gaps",
    )
    matrix = feature_matrix(frame, ["same", "none", "gaps"], "label", Problem.classification)
    found = {r["feature"]: r["information"] for r in mutual_information(matrix).collect()}
    assert found == {0: pytest.approx(math.log(2)), 1: pytest.approx(0), 2: pytest.approx(math.log(2))}


@pytest.mark.parametrize("values", [64, 65, 1000])
def test_mutual_information_does_not_depend_on_the_number_of_values(spark, values):
    frame = spark.range(20 * values).selectExpr(f"CAST(id % {values} AS DOUBLE) AS x", f"id % {values} % 2 AS label")
    matrix = feature_matrix(frame, ["x"], "label", Problem.classification)
    assert mutual_information(matrix).first()["information"] == pytest.approx(math.log(2), abs=2e-4)
    assert mutual_information(matrix, bins=8).first()["information"] < 0.05


@pytest.mark.parametrize("method", [BoostedTrees(), RandomForest()])
def test_trees_of_counted_rows_are_those_of_all_rows(spark, monkeypatch, method):
    frame = spark.range(0, 6000, 1, 3).selectExpr(
        "CAST(id % 10 AS DOUBLE) AS a", "CAST(id % 3 AS DOUBLE) AS b", "CAST(id % 10 > 6 AS INT) + CAST(id % 3 > 1 AS INT) AS y",
    )
    for problem, target in ((Problem.classification, "y"), (Problem.regression, "y")):
        matrix = feature_matrix(frame, ["a", "b"], target, problem)
        monkeypatch.setattr(predictors, "WEIGHED_ROWS", 1 << 20)
        plain = method.fit(matrix)
        monkeypatch.setattr(predictors, "WEIGHED_ROWS", 500)
        fits = []
        monkeypatch.setattr(predictors, "release", lambda counted: fits.append(counted.count()))
        weighed = method.fit(matrix)
        assert fits == [30]
        both = [sorted(map(tuple, m.score(matrix.frame).select("features", "prediction").distinct().collect())) for m in (plain, weighed)]
        close = 1e-6 if isinstance(method, BoostedTrees) else 0.35
        assert [p for _, p in both[0]] == pytest.approx([p for _, p in both[1]], abs=close)
        expected, found = (mean_impacts(matrix.frame, m, 2) for m in (plain, weighed))
        assert expected == pytest.approx(found, rel=0.15)


@pytest.mark.parametrize("cells", [1 << 18, 40, 0])
def test_tabulated_trees_answer_like_their_leaves(spark, numbers, monkeypatch, cells):
    monkeypatch.setattr(trees, "TABULATED_CELLS", cells)
    matrix = feature_matrix(numbers[0], ["a", "b", "c", "f"], "three", Problem.classification)
    ensemble = read_ensemble(spark, RandomForest().fit(matrix))
    used = sorted({int(f) for leaf in ensemble.leaves for f in leaf.features})
    rng = np.random.default_rng(5)
    limits = np.array([v for leaf in ensemble.leaves for v in (*leaf.low, *leaf.high) if np.isfinite(v)])
    own, donor = (np.where(rng.random((500, 4)) < 0.5, rng.normal(size=(500, 4)), rng.choice(limits, (500, 4))) for _ in range(2))
    expected, found = trees.swapped_outputs(ensemble, own, donor, used), trees.swapped_function(ensemble, used)(own, donor)
    assert all(np.allclose(x, y, atol=1e-12) for x, y in zip(expected, found))


def test_listed_ranks_equal_joined_ones(numbers, monkeypatch):
    matrix = feature_matrix(numbers[0], NAMES, "two", Problem.classification)
    listed = rows(pair_correlations(matrix, "spearman"))
    monkeypatch.setattr(rank_correlation, "LISTED_RANKS", 0)
    joined = rows(pair_correlations(matrix, "spearman"))
    assert [r[:2] for r in listed] == [r[:2] for r in joined]
    assert [r[2] for r in listed] == [r[2] if r[2] is None else pytest.approx(r[2], abs=1e-9) for r in joined]
    monkeypatch.setattr(rank_correlation, "LISTED_RANKS", 1 << 21)
    monkeypatch.setattr(rank_correlation, "split_left_join", None)  # no row is shuffled
    assert rows(pair_correlations(matrix, "spearman")) == listed


def test_bins_are_cut_at_exact_quantiles_of_many_rows(spark):
    n = 200_000
    frame = spark.range(0, n, 1, 7).selectExpr(
        "array(CAST(pmod(id * 77773, 200003) AS DOUBLE), CAST(id % 5 AS DOUBLE), -0.0D, CAST(least(id, 1000) AS DOUBLE)) AS x",
    )
    shares = [k / 20 for k in range(1, 20)]
    found = array_quantiles(frame, "x", [0, 1, 2, 3], shares)
    own = np.array([row.x for row in frame.collect()])
    expected = np.sort(own, axis=0)[[max(1, math.ceil(round(n * p, 6))) - 1 for p in shares]]
    for f in range(4):
        assert found[f].tolist() == expected[:, f].tolist()
    missed = _ranked(frame, {0: np.array([[10.0, 20.0]])}, [1, 15])
    assert np.isnan(missed[0][0]) and missed[0][1] == np.sort(own[:, 0])[14]
    assert array_quantiles(frame.where("false"), "x", [1], shares)[1].size == 0


def test_mutual_information_of_infinite_features(spark):
    frame = spark.range(200).selectExpr(
        "CAST(CASE id % 4 WHEN 0 THEN 'Infinity' WHEN 1 THEN '-Infinity' WHEN 2 THEN 'NaN' ELSE '0' END AS DOUBLE) AS x",
        "CAST(id % 4 >= 2 AS INT) AS label",
    )
    matrix = feature_matrix(frame, ["x"], "label", Problem.classification)
    assert matrix.frame.count() == 200
    assert mutual_information(matrix).first()["information"] >= 0


# --- Shapley values --------------------------------------------------------------------------------------


def test_leaf_values_against_all_subsets():
    share, holds = np.array([0.3, 0.8, 0.5]), np.array([[1.0, 0.0, 1.0]])
    value = lambda s: np.prod([holds[0, k] if k in s else share[k] for k in range(3)])
    for k in range(3):
        others = [j for j in range(3) if j != k]
        expected = sum(
            math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (value({*s, k}) - value(set(s)))
            for size in range(3)
            for s in itertools.combinations(others, size)
        )
        assert leaf_values(share, holds)[0, k] == pytest.approx(expected)


@pytest.mark.parametrize(
    ("method", "target", "problem"),
    [
        (BoostedTrees(), "score", Problem.regression),
        (RandomForest(), "score", Problem.regression),
        (BoostedTrees(), "two", Problem.classification),
        (RandomForest(), "three", Problem.classification),
        (BoostedTrees(), "three", Problem.classification),
    ],
)
def test_impacts_add_up_to_the_output(spark, numbers, method, target, problem):
    frame = numbers[0].withColumn("id", F.monotonically_increasing_id())
    matrix = feature_matrix(frame, NAMES, target, problem, extra=["id"])
    fitted = method.fit(matrix)
    ensemble = read_ensemble(spark, fitted)
    impacts = explain(matrix.frame, fitted, NAMES, keys=["id"], classes=matrix.classes)
    sums = impacts.groupBy("id", "class").agg(F.sum("impact").alias("s")).toPandas()
    ready = vectors(filled(matrix.frame, fitted.fills))
    models = getattr(fitted.model, "models", [fitted.model])
    for k, model in enumerate(models):
        scored = model.transform(ready)
        if problem is Problem.regression:
            outputs = {None: "prediction"}
        elif method.fit.__qualname__.startswith("Random"):
            outputs = {c: f"element_at(vector_to_array(probability), {i + 1})" for i, c in enumerate(matrix.classes)}
        else:
            name = matrix.classes[k] if len(models) > 1 else None
            outputs = {name: "element_at(vector_to_array(rawPrediction), 2)"}
        from pyspark.ml.functions import vector_to_array

        for column in ("probability", "rawPrediction"):
            if column in scored.columns:
                scored = scored.withColumn(column, vector_to_array(column))
        for label, sql in outputs.items():
            real = scored.select("id", F.expr(sql.replace("vector_to_array(", "(")).alias("out")).toPandas()
            mine = sums[sums["class"].isna()] if label is None else sums[sums["class"] == str(label)]
            joined = real.merge(mine, on="id")
            at = 0 if len(ensemble.outputs) == 1 else (k if len(models) > 1 else matrix.classes.index(label))
            assert len(joined) == 600
            assert np.allclose(joined["out"], joined["s"] + ensemble.expectation[at], atol=1e-8)
    means = mean_impacts(matrix.frame, fitted, len(NAMES))
    expected = impacts.groupBy("feature").agg(F.avg(F.abs("impact")).alias("m")).toPandas().set_index("feature")["m"]
    assert np.allclose(means, [expected[n] for n in NAMES])


# --- training -----------------------------------------------------------------------------------------------


def accounts(spark):
    """Accounts whose target depends on their sessions."""
    sessions = spark.range(3000).selectExpr(
        "id AS session", "id % 200 AS account", "id % 200 % 7 + CAST(pmod(hash(id), 100) AS DOUBLE) / 100 AS minutes",
        "id % 4 = 0 AS mobile",
    )
    people = spark.range(200).selectExpr(
        "id AS account", "id % 7 > 3 AS churned", "CAST(id % 7 * 10 AS DOUBLE) AS spend", "CAST(id % 5 AS DOUBLE) AS size",
    )
    data = declare_key(from_frames(spark, {"sessions": sessions, "people": people}), "people", ["account"])
    return declare_key(data, "sessions", ["session"])


def test_default_training_of_a_classifier(spark):
    data = accounts(spark)
    people = data.table("people")
    problem, known = suggest_problem(people, "churned")
    assert (problem, [c.name for c in known]) == (Problem.classification, ["account"])
    model = Model.train(
        data,
        known_columns=known,
        prediction_method=RandomForest(),
        problem=problem,
        target_column=people.column("churned"),
        training_data=people,
    )
    assert not any("churned" in n for n in model.names)
    assert model.test.count() == 40
    evaluation = {r["Metric"]: r for r in model.evaluation.collect()}
    assert list(evaluation) == ["Accuracy", "F1", "Precision", "Recall"]
    assert evaluation["F1"]["Model"] > 0.95 > evaluation["F1"]["Baseline"]

    prediction = model.predict(spark.range(100, 120).toDF("account"))
    assert prediction.y.columns == ["account", "churned"]
    assert {r["account"]: r["churned"] for r in prediction.y.collect()} == {i: i % 7 > 3 for i in range(100, 120)}
    assert set(prediction.frame.columns) == {"account", "churned", *model.names}
    assert prediction.explanation.count() == 20 * 2 * len(model.names)
    grid = model.importance.collect()
    assert grid[0]["Importance"] == 1.0 and {r["Id"] for r in grid} == set(model.names)
    assert prediction.impact.count() == len(model.names)
    assert model.charts(grid[0]["Id"])
    with pytest.raises(ValueError, match="known columns"):
        model.predict(spark.range(3).toDF("other"))


def test_training_of_a_regressor_and_what_if(spark):
    data = accounts(spark)
    people = data.table("people")
    aggregate = Aggregate(is_pivotable=["account"])
    model = Model.train(
        data,
        known_columns=[people.column("account")],
        prediction_method=BoostedTrees(),
        problem=Problem.regression,
        target_column=people.column("spend"),
        training_data=people,
        rounds=[Round(generate=Identity().then(Identity(), aggregate), selectors=[Correlation(max=0.95)])],
    )
    evaluation = {r["Metric"]: r for r in model.evaluation.collect()}
    assert evaluation["RMSE"]["Model"] < 5 < evaluation["RMSE"]["Baseline"]
    features = model.features(spark.range(5).toDF("account"))
    edited = features.withColumns({f"`{n}`": F.lit(None) for n in model.names[:0]})
    assert model.score(edited).count() == 5
    assert rows(model.score(features).select("account", "spend")) == rows(
        model.predict(spark.range(5).toDF("account")).y,
    )


def test_registry_and_baseline(spark, numbers):
    assert list(PREDICTION_METHODS)[:3] == ["BoostedTrees", "RandomForest", "Baseline"]
    assert Baseline().fit(feature_matrix(numbers[0], ["a"], "score", Problem.regression)).value == pytest.approx(
        numbers[1].score.mean(),
    )
    tie = spark.createDataFrame([("b", 1), ("a", 1), ("b", 1), ("a", 1), ("c", 1)], "t string, x int")
    assert Baseline().fit(feature_matrix(tie, ["x"], "t", Problem.classification)).value == 0.0
    with pytest.raises(ValueError, match="missing values"):
        t = from_frames(spark, {"t": spark.createDataFrame([(None,), (1,)], "x int")}).table("t")
        suggest_problem(t, "x")


def test_boruta_joins_donors_once_per_trial(spark):
    fitted = []

    class Seen(RandomForest):
        def fit(self, matrix):
            fitted.append(matrix.frame._jdf.queryExecution().optimizedPlan().toString())
            return super().fit(matrix)

    frame = spark.range(200).selectExpr("CAST(id % 20 AS DOUBLE) AS a", "CAST(pmod(hash(id), 9) AS DOUBLE) AS b", "id % 20 > 9 AS y")
    matrix = feature_matrix(frame, ["a", "b"], "y", Problem.classification)
    Boruta(importance="gini", predictor=Seen(), problem=Problem.classification, trials=1).select(matrix)
    assert len(fitted) == 1 and "Join" not in fitted[0]


def test_training_reads_texts_once_and_uses_all_cores(spark):
    from workload.training import _forest_rounds, document_model

    model = document_model(spark, "/root/testdata/sf0.001", _forest_rounds())
    plans = [t.frame._jdf.queryExecution().toString() for t in model.dataset]
    assert plans and not any("regexp_replace" in plan for plan in plans)
    assert len(model.test.inputFiles()) > 1


@pytest.fixture(scope="module")
def empty_texts(spark, tmp_path_factory):
    """Documents whose quality is their share of digits; every tenth is empty, every other tenth null."""
    folder = str(tmp_path_factory.mktemp("documents"))
    text = "CASE id % 10 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat(repeat('1', CAST(id % 89 AS INT)), ' ', repeat('a', CAST(5 + id % 53 AS INT))) END"
    documents = spark.range(400).selectExpr("id AS doc_id", f"{text} AS text", "if(id % 2 = 0, 'en', 'de') AS lang", "'src' AS source")
    documents = documents.selectExpr("*", "CAST(length(text) AS LONG) AS n_chars")
    documents.write.parquet(f"{folder}/documents.parquet")
    quality = "CAST(coalesce(id % 10 > 1 AND id % 89 > 5 + id % 53, false) AS INT) AS quality"
    spark.range(400).where("id % 3 > 0").selectExpr("id AS doc_id", quality, "0 AS toxic").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_impacts_of_predictions_with_empty_texts(spark, empty_texts):
    from workload.training import _forest_rounds, document_model, prediction_impacts

    impacts = {r["Feature"]: r["Impact"] for r in prediction_impacts(spark, empty_texts).collect()}
    assert "digit_share" in impacts and all(math.isfinite(v) for v in impacts.values())
    model = document_model(spark, empty_texts, _forest_rounds())
    found = model.predict(spark.range(400).toDF("doc_id")).frame
    shares = {r["doc_id"]: r["digit_share :: documents"] for r in found.collect()}
    assert len(shares) == 400 and {i for i, share in shares.items() if share is None} == {i for i in range(400) if i % 10 < 2}
    assert all(shares[i] == pytest.approx((i % 89) / (i % 89 + 6 + i % 53)) for i in range(400) if i % 10 > 1)
    right = [r["quality"] == (r["doc_id"] % 10 > 1 and r["doc_id"] % 89 > 5 + r["doc_id"] % 53) for r in found.collect()]
    assert sum(right) > 0.95 * 400


def test_importance_with_empty_texts(spark, empty_texts):
    from workload.training import shap_importance

    grid = {r["Feature"]: r["Importance"] for r in shap_importance(spark, empty_texts).collect()}
    assert max(grid, key=grid.get) == "digit_share" and grid["digit_share"] == pytest.approx(1.0)


def test_default_training_with_empty_texts(spark, empty_texts):
    from workload.training import train_predict_labels

    evaluation = {r["Metric"]: r for r in train_predict_labels(spark, empty_texts).collect()}
    assert list(evaluation) == ["Accuracy", "F1", "Precision", "Recall"]
    assert evaluation["Accuracy"]["Model"] > 0.9 > evaluation["Accuracy"]["Baseline"]
