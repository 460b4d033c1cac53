"""Selection, training, prediction and explanation."""

from __future__ import annotations

import functools

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from featloom import Dataset, Encode, Identity, Problem, declare_key, table
from featloom.functions import quote
from featloom.learning import (
    PREDICTION_METHODS,
    BoostedTrees,
    Boruta,
    Correlation,
    FeatureMatrix,
    Model,
    PermutationImportance,
    RandomForest,
    ShapelyImpact,
    feature_matrix,
    pair_correlations,
)
from featloom.learning.matrix import decode_labels, encode_labels, filled, indexed, vectors
from featloom.learning.model import Round
from featloom.learning.predictors import baseline
from featloom.learning.selectors import FeatureImportance, mutual_information
from featloom.learning.trees import explain
from featloom.plans.storage import materialise
from featloom.reports import importance_grid, prediction_impact
from workload.registry import dq, query, r4, read

_NUMBERS = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _r(sql: str) -> str:
    return f"round(CAST({sql} AS DOUBLE), 6) + 0.0"


def _lines(spark, sf_dir, names=_NUMBERS, target="l_returnflag") -> FeatureMatrix:
    return feature_matrix(read(spark, sf_dir, "lineitem"), names, target, Problem.classification)


@query(
    " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, {_r(f'corr({x}, {y})')} AS r FROM lineitem"
        for i, x in enumerate(_NUMBERS)
        for y in _NUMBERS[i + 1 :]
    ),
)
def corr_pairs(spark, sf_dir):
    return _named_pairs(pair_correlations(_lines(spark, sf_dir)), _NUMBERS)


def _named_pairs(pairs, names):
    listed = F.array(*(F.lit(n) for n in names))
    return pairs.select(F.get(listed, F.col("i")).alias("x"), F.get(listed, F.col("j")).alias("y"), F.expr(f"{_r('r')} AS r"))


_RANKED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "WITH r AS (SELECT "
    + ", ".join(
        f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS {x}" for x in _RANKED
    )
    + " FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, {_r(f'corr({x}, {y})')} AS r FROM r"
        for i, x in enumerate(_RANKED)
        for y in _RANKED[i + 1 :]
    ),
)
def corr_spearman(spark, sf_dir):
    return _named_pairs(pair_correlations(_lines(spark, sf_dir, _RANKED), "spearman"), _RANKED)


_TAU = ["l_quantity", "l_discount", "l_tax"]


def _tau_sql(x: str, y: str) -> str:
    """Tau-b from counted value pairs."""
    cells = f"(SELECT {x} AS x, {y} AS y, count(*) AS n FROM lineitem GROUP BY ALL)"
    ties = "(SELECT sum(n * (n - 1) / 2.0) FROM (SELECT {c}, count(*) AS n FROM lineitem GROUP BY {c}))"
    pairs = "(SELECT count(*) * (count(*) - 1) / 2.0 FROM lineitem)"
    agreement = (
        f"(SELECT sum(CAST(a.n AS DOUBLE) * b.n * sign(a.x - b.x) * sign(a.y - b.y)) / 2 FROM {cells} a, {cells} b)"
    )
    spread = f"sqrt({pairs} - {ties.format(c=x)}) * sqrt({pairs} - {ties.format(c=y)})"
    return f"SELECT '{x}' AS x, '{y}' AS y, {_r(f'{agreement} / ({spread})')} AS r"


@query(" UNION ALL ".join(_tau_sql(x, y) for i, x in enumerate(_TAU) for y in _TAU[i + 1 :]))
def corr_kendall(spark, sf_dir):
    return _named_pairs(pair_correlations(_lines(spark, sf_dir, _TAU), "kendall"), _TAU)


# Two columns that are missing together, one that is missing elsewhere, and a complete one.
_GAPS = {
    "quantity": "CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END",
    "tax": "CASE WHEN l_linenumber % 3 <> 0 THEN l_tax END",
    "discount": "CASE WHEN l_suppkey % 4 <> 1 THEN l_discount END",
    "line": "l_linenumber",
}


def _gappy(spark, sf_dir) -> FeatureMatrix:
    frame = read(spark, sf_dir, "lineitem").selectExpr("l_returnflag", *(f"{sql} AS {n}" for n, sql in _GAPS.items()))
    return feature_matrix(frame, list(_GAPS), "l_returnflag", Problem.classification)


def _gap_pairs(sql) -> str:
    names = list(_GAPS)
    return " UNION ALL ".join(sql(x, y) for i, x in enumerate(names) for y in names[i + 1 :])


def _rho_sql(x: str, y: str) -> str:
    """Average ranks among the rows that have both."""
    ranks = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in "xy")
    rows = f"SELECT * FROM (SELECT {_GAPS[x]} AS x, {_GAPS[y]} AS y FROM lineitem) WHERE x IS NOT NULL AND y IS NOT NULL"
    return f"SELECT '{x}' AS x, '{y}' AS y, {_r('corr(x, y)')} AS r FROM (SELECT {ranks} FROM ({rows}))"


@query(_gap_pairs(_rho_sql))
def corr_spearman_nulls(spark, sf_dir):
    return _named_pairs(pair_correlations(_gappy(spark, sf_dir), "spearman"), list(_GAPS))


def _tau_nulls_sql(x: str, y: str) -> str:
    rows = f"(SELECT * FROM (SELECT {_GAPS[x]} AS x, {_GAPS[y]} AS y FROM lineitem) WHERE x IS NOT NULL AND y IS NOT NULL)"
    cells = f"(SELECT x, y, CAST(count(*) AS DOUBLE) AS n FROM {rows} GROUP BY x, y)"
    ties = "(SELECT sum(n * (n - 1) / 2.0) FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM {rows} GROUP BY {c}))"
    pairs = f"(SELECT CAST(count(*) AS DOUBLE) * (count(*) - 1) / 2.0 FROM {rows})"
    agreement = f"(SELECT sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) / 2 FROM {cells} a, {cells} b)"
    spread = " * ".join(f"sqrt({pairs} - {ties.format(rows=rows, c=c)})" for c in "xy")
    return f"SELECT '{x}' AS x, '{y}' AS y, {_r(f'{agreement} / ({spread})')} AS r"


@query(_gap_pairs(_tau_nulls_sql))
def corr_kendall_nulls(spark, sf_dir):
    return _named_pairs(pair_correlations(_gappy(spark, sf_dir), "kendall"), list(_GAPS))


@query(
    "WITH p AS ("
    + " UNION ALL ".join(
        f"SELECT '{x}' AS x, abs(corr({x}, {y})) AS r FROM lineitem"
        for i, x in enumerate(_NUMBERS)
        for y in _NUMBERS[i + 1 :]
    )
    + ") "
    + " UNION ALL ".join(
        f"SELECT '{x}' AS feature, coalesce((SELECT max(r) FROM p WHERE x = '{x}'), 0) < 0.5 AS kept" for x in _NUMBERS
    ),
)
def corr_select(spark, sf_dir):
    kept = Correlation(max=0.5).select(_lines(spark, sf_dir))
    return spark.createDataFrame(list(zip(_NUMBERS, kept)), "feature string, kept boolean")


_DISCRETE = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]


def _information_sql(x: str) -> str:
    joint = f"(SELECT {x} AS b, l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY ALL)"
    return (
        f"SELECT '{x}' AS feature, {_r('sum(n / total * ln(n * total / nb / ny))')} AS information FROM ("
        f"SELECT CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER () AS DOUBLE) AS total, "
        "CAST(sum(n) OVER (PARTITION BY b) AS DOUBLE) AS nb, CAST(sum(n) OVER (PARTITION BY y) AS DOUBLE) AS ny "
        f"FROM {joint})"
    )


@query(" UNION ALL ".join(_information_sql(x) for x in _DISCRETE))
def mi_binned(spark, sf_dir):
    scores = mutual_information(_lines(spark, sf_dir, _DISCRETE))
    listed = F.array(*(F.lit(n) for n in _DISCRETE))
    return scores.select(F.get(listed, F.col("feature")).alias("feature"), F.expr(f"{_r('information')} AS information"))


_CONTINUOUS = ["l_extendedprice", "l_partkey", "l_suppkey", "l_quantity"]
_BINS = 20


def _bin_sql(x: str) -> str:
    """Number of quantiles below a value; equal quantiles count once."""
    shares = ", ".join(repr(k / _BINS) for k in range(1, _BINS))
    limits = f"(SELECT list_distinct(quantile_disc(CAST({x} AS DOUBLE), [{shares}])) FROM lineitem)"
    return f"len(list_filter({limits}, lambda q: q < CAST({x} AS DOUBLE)))"


def _binned_sql(x: str, target: str) -> str:
    joint = f"(SELECT {_bin_sql(x)} AS b, {target} AS y, count(*) AS n FROM lineitem GROUP BY ALL)"
    return (
        f"SELECT '{x}' AS feature, {_r('sum(n / total * ln(n * total / nb / ny))')} AS information FROM ("
        "SELECT CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER () AS DOUBLE) AS total, "
        "CAST(sum(n) OVER (PARTITION BY b) AS DOUBLE) AS nb, CAST(sum(n) OVER (PARTITION BY y) AS DOUBLE) AS ny "
        f"FROM {joint})"
    )


def _information(matrix: FeatureMatrix, names: list[str]):
    scores = mutual_information(matrix, bins=_BINS)
    listed = F.array(*(F.lit(n) for n in names))
    return scores.select(F.get(listed, F.col("feature")).alias("feature"), F.expr(f"{_r('information')} AS information"))


@query(" UNION ALL ".join(_binned_sql(x, "l_returnflag") for x in _CONTINUOUS))
def mi_continuous(spark, sf_dir):
    """Features of many values, in quantile bins."""
    return _information(_lines(spark, sf_dir, _CONTINUOUS), _CONTINUOUS)


@query(" UNION ALL ".join(_binned_sql(x, _bin_sql("l_extendedprice")) for x in _CONTINUOUS[1:]))
def mi_regression(spark, sf_dir):
    """Features and a target of many values, in quantile bins."""
    names = _CONTINUOUS[1:]
    matrix = feature_matrix(read(spark, sf_dir, "lineitem"), names, "l_extendedprice", Problem.regression)
    return _information(matrix, names)


@query(
    "SELECT c_mktsegment AS prediction FROM customer GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 1",
)
def baseline_class(spark, sf_dir):
    return baseline(read(spark, sf_dir, "customer"), "c_mktsegment", Problem.classification)


@query(f"SELECT {r4('avg(o_totalprice)')} AS prediction FROM orders")
def baseline_reg(spark, sf_dir):
    constant = baseline(read(spark, sf_dir, "orders"), "o_totalprice", Problem.regression)
    return constant.select(F.expr(r4("prediction")).alias("prediction"))


@query(
    "SELECT "
    + ", ".join(
        f"CAST(count(*) FILTER (WHERE l_returnflag = '{f}') AS BIGINT) AS {dq(f)}" for f in ("A", "N", "R")
    )
    + " FROM lineitem",
)
def label_encoding(spark, sf_dir):
    """Labels are positions of the sorted classes; decode them again and count."""
    matrix = _lines(spark, sf_dir)
    decoded = F.get(F.array(*(F.lit(c) for c in matrix.classes)), F.col("label").cast("int"))
    return matrix.frame.select(decoded.alias("flag")).groupBy().pivot("flag", matrix.classes).count()


@query(
    "SELECT 'order ' || l_orderkey AS value, CAST(dense_rank() OVER (ORDER BY 'order ' || l_orderkey) - 1 AS BIGINT) AS label, count(*) AS n "
    "FROM lineitem GROUP BY l_orderkey",
)
def label_encoding_wide(spark, sf_dir):
    """Labels of more classes than any list should hold, read back by the same dictionary."""
    lines = read(spark, sf_dir, "lineitem").selectExpr("concat('order ', l_orderkey) AS name")
    encoded, classes = encode_labels(lines, "name")
    back = decode_labels(encoded, classes, name="value")
    return back.groupBy("value", "label").agg(F.count("*").alias("n"))


def document_model(spark, sf_dir, rounds=None) -> Model:
    """Predict the quality of labelled documents from their own columns and their source."""
    documents = read(spark, sf_dir, "documents")
    # facts per document that a chain of row-wise expressions can see; a text without characters has no
    # share of digits, which is a missing feature
    facts = documents.selectExpr(
        "doc_id", "lang", "source", "CAST(n_chars AS DOUBLE) AS n_chars",
        "n_chars / size(split(text, ' ')) AS word_length", "n_chars / size(split(text, '\n')) AS line_length",
        "try_divide(length(regexp_replace(text, '[^0-9]', '')), n_chars) AS digit_share",
    )
    # profile, categories and every round of training read them again; the texts are read once
    facts = materialise(facts, "facts")
    labels = table(read(spark, sf_dir, "labels"), "labels")
    data = declare_key(Dataset([table(facts, "documents")]).apply(Encode()), "documents", ["doc_id"])
    return Model.train(
        data,
        known_columns=[labels.column("doc_id")],
        prediction_method=BoostedTrees() if rounds is None else RandomForest(),
        problem=Problem.classification,
        target_column=labels.column("quality"),
        training_data=labels,
        rounds=rounds,
    )


def _forest_rounds():
    return [
        Round(
            generate=Identity(),
            selectors=[Correlation(max=0.9), FeatureImportance(predictor=RandomForest(), n=12)],
        ),
    ]


@query()
def train_predict_labels(spark, sf_dir):
    """Evaluation of a model after all three default rounds."""
    return document_model(spark, sf_dir).evaluation


@query("SELECT doc_id, CAST(lang = 'en' AS INT) AS english FROM documents")
def predict_batch(spark, sf_dir):
    """Predictions for every document, labelled or not, of a target that its columns decide."""
    documents = read(spark, sf_dir, "documents")
    english = documents.join(read(spark, sf_dir, "labels"), "doc_id", "left_semi")
    known = table(english.selectExpr("doc_id", "CAST(lang = 'en' AS INT) AS english"), "english")
    facts = table(documents.selectExpr("doc_id", "lang", "source", "CAST(n_chars AS DOUBLE) AS n_chars"), "documents")
    model = Model.train(
        declare_key(Dataset([facts]).apply(Encode()), "documents", ["doc_id"]),
        known_columns=[known.column("doc_id")],
        prediction_method=RandomForest(),
        problem=Problem.classification,
        target_column=known.column("english"),
        training_data=known,
        rounds=_forest_rounds(),
    )
    return model.predict(documents.select("doc_id")).y.selectExpr("doc_id", "CAST(english AS INT) AS english")


@query()
def shap_importance(spark, sf_dir):
    return document_model(spark, sf_dir, _forest_rounds()).importance


@query()
def prediction_impacts(spark, sf_dir):
    model = document_model(spark, sf_dir, _forest_rounds())
    return model.predict(read(spark, sf_dir, "documents").select("doc_id")).impact


# a target made from two columns, so that it is known which features matter
_MADE = "CAST(l_quantity > 25 AS INT) + CAST(l_discount > 0.05 AS INT)"


def _made(spark, sf_dir) -> FeatureMatrix:
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    lines = read(spark, sf_dir, "lineitem").selectExpr(*names, f"{_MADE} AS made")
    # a price is a quantity times the price of a part; without the quantity in it, it tells nothing
    return feature_matrix(
        lines.withColumn("l_extendedprice", F.expr("l_extendedprice / l_quantity")), names, "made", Problem.classification,
    )


_KEPT = (
    "SELECT feature, feature IN ('l_quantity', 'l_discount') AS kept FROM (SELECT unnest("
    "['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_linenumber']) AS feature) WHERE (SELECT count(*) FROM lineitem) > 0"
)


def _kept(spark, selector, matrix):
    return spark.createDataFrame(list(zip(matrix.names, selector.select(matrix))), "feature string, kept boolean")


@query(_KEPT)
def perm_importance(spark, sf_dir):
    return _kept(spark, PermutationImportance(n=2, predictor=RandomForest()), _made(spark, sf_dir))


@query(_KEPT)
def shap_select(spark, sf_dir):
    return _kept(spark, ShapelyImpact(n=2, predictor=RandomForest()), _made(spark, sf_dir))


@query(
    "SELECT feature, true AS kept FROM (SELECT unnest(['p_size', 'p_retailprice']) AS feature) "
    "WHERE (SELECT count(*) FROM part) > 0",
)
def boruta_select(spark, sf_dir):
    """All trials, Shapley importance: the two columns that make the target are kept.  Whether
    the third is rejected or stays undecided is a matter of chance, so it is not listed."""
    parts = read(spark, sf_dir, "part").selectExpr(
        "p_size", "p_retailprice", "p_partkey % 7 AS rest",
        "CAST(p_size > 25 AS INT) + CAST(p_retailprice > 950 AS INT) AS made",
    )
    matrix = feature_matrix(parts, ["p_size", "p_retailprice", "rest"], "made", Problem.classification)
    kept = _kept(spark, Boruta(predictor=RandomForest(), problem=Problem.classification), matrix)
    return kept.where("kept AND feature <> 'rest'")


@query(_KEPT)
def importance_select(spark, sf_dir):
    """Features that matter to a forest at least as much as the mean one."""
    return _kept(spark, FeatureImportance(n=4, predictor=RandomForest()), _made(spark, sf_dir))


_STEPS = "CASE WHEN l_linenumber <= 2 THEN 'low' WHEN l_linenumber <= 4 THEN 'mid' ELSE 'top' END"


@query(
    "SELECT method, step, count(*) AS row_count, count(*) FILTER (method <> 'Baseline' OR step = ("
    f"SELECT {_STEPS} AS s FROM lineitem GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)) AS correct "
    f"FROM (SELECT unnest(['BoostedTrees', 'RandomForest', 'Baseline']) AS method), (SELECT {_STEPS} AS step FROM lineitem) GROUP BY ALL",
)
def predictors_by_name(spark, sf_dir):
    """Every registered method on three classes that a column decides: trees are always right."""
    lines = read(spark, sf_dir, "lineitem").selectExpr("l_linenumber", "l_quantity", f"{_STEPS} AS step")
    matrix = feature_matrix(lines, ["l_linenumber", "l_quantity"], "step", Problem.classification)
    parts = []
    for name, method in PREDICTION_METHODS.items():
        scored = method.fit(matrix).score(matrix.frame)
        step = F.get(F.array(*(F.lit(c) for c in matrix.classes)), F.col("label").cast("int"))
        right = F.count_if(F.col("prediction") == F.col("label"))
        counted = scored.groupBy(step.alias("step")).agg(F.count("*").alias("row_count"), right.alias("correct"))
        parts.append(counted.select(F.lit(name).alias("method"), "*"))
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "SELECT class, count(*) AS row_count, true AS additive FROM (SELECT unnest(['0', '1', '2']) AS class), "
    "(SELECT l_orderkey FROM lineitem) GROUP BY class",
)
def shap_additivity(spark, sf_dir):
    """Over all rows: the impacts of a row add up to what the forest answers, less one constant per class."""
    matrix = _made(spark, sf_dir)
    rows, _ = indexed(matrix.frame)
    rows = materialise(rows, "numbered")
    fitted = RandomForest().fit(matrix)
    impacts = explain(rows, fitted, matrix.names, keys=["index"], classes=matrix.classes)
    answer = fitted.model.transform(vectors(filled(rows, fitted.fills)))
    answer = answer.select("index", F.posexplode(vector_to_array("probability")).alias("place", "chance"))
    names = F.array(*(F.lit(str(c)) for c in matrix.classes))
    answer = answer.select("index", F.get(names, F.col("place")).alias("class"), "chance")
    total = impacts.groupBy("index", "class").agg(F.sum("impact").alias("impact"))
    rest = answer.join(total, ["index", "class"]).select("class", (F.col("chance") - F.col("impact")).alias("rest"))
    return rest.groupBy("class").agg(F.count("*").alias("row_count"), (F.max("rest") - F.min("rest") < 1e-6).alias("additive"))


_GRID = "concat('line ', l_linenumber, ' :: ', l_returnflag)"
_SHIFT = "l_discount - 0.01 * l_linenumber"


@query(
    "SELECT CAST(row_number() OVER (ORDER BY m DESC, id) - 1 AS BIGINT) AS position, split_part(id, ' :: ', 1) AS feature, "
    f"split_part(id, ' :: ', 2) AS source, {_r('m / max(m) OVER ()')} AS importance "
    f"FROM (SELECT {_GRID} AS id, avg(abs({_SHIFT})) AS m FROM lineitem GROUP BY id)",
)
def importance_table(spark, sf_dir):
    """Mean absolute impacts, relative to the largest, in order; names split into feature and source."""
    grid = importance_grid(read(spark, sf_dir, "lineitem").selectExpr(f"{_GRID} AS feature", f"{_SHIFT} AS impact"))
    rows = [(i, r["Feature"], r["Source"], round(r["Importance"], 6)) for i, r in enumerate(grid.collect())]  # one per feature
    return spark.createDataFrame(rows, "position long, feature string, source string, importance double")


@query(
    "SELECT CAST(row_number() OVER (ORDER BY abs(m) DESC, id) - 1 AS BIGINT) AS position, split_part(id, ' :: ', 1) AS feature, "
    f"split_part(id, ' :: ', 2) AS source, {_r('m')} AS impact "
    f"FROM (SELECT {_GRID} AS id, avg({_SHIFT}) AS m FROM lineitem GROUP BY id)",
)
def impact_table(spark, sf_dir):
    """Mean signed impacts, strongest first."""
    table = prediction_impact(read(spark, sf_dir, "lineitem").selectExpr(f"{_GRID} AS feature", f"{_SHIFT} AS impact"))
    rows = [(i, r["Feature"], r["Source"], round(r["Impact"], 6) + 0.0) for i, r in enumerate(table.collect())]  # one per feature
    return spark.createDataFrame(rows, "position long, feature string, source string, impact double")


def _english(spark, sf_dir) -> Model:
    """A model of a target that one dummy decides."""
    documents = read(spark, sf_dir, "documents")
    known = table(documents.selectExpr("doc_id", "CAST(lang = 'en' AS INT) AS english"), "english")
    facts = table(documents.selectExpr("doc_id", "lang", "CAST(n_chars AS DOUBLE) AS n_chars"), "documents")
    return Model.train(
        declare_key(Dataset([facts]).apply(Encode()), "documents", ["doc_id"]),
        known_columns=[known.column("doc_id")],
        prediction_method=RandomForest(),
        problem=Problem.classification,
        target_column=known.column("english"),
        training_data=known,
        rounds=[Round(generate=Identity(), selectors=[FeatureImportance(predictor=RandomForest(), n=1)])],
    )


@query(
    "SELECT doc_id, CAST(lang = 'en' AS INT) AS english, CAST(lang <> 'en' AS INT) AS what_if, "
    "CAST(lang = 'en' AS DOUBLE) AS feature FROM documents",
)
def what_if_documents(spark, sf_dir):
    """Predictions beside known columns and features, and again after every feature was turned over."""
    model = _english(spark, sf_dir)
    (name,) = model.names
    found = model.predict(read(spark, sf_dir, "documents").select("doc_id")).frame
    edited = found.select("doc_id", (1 - F.col(quote(name)).cast("double")).alias(name))
    edited = model.score(edited).select("doc_id", F.col("english").cast("int").alias("what_if"))
    beside = found.select("doc_id", F.col("english").cast("int").alias("english"), F.col(quote(name)).cast("double").alias("feature"))
    return beside.join(edited, "doc_id")


@query(
    "SELECT 'value' AS feature, " + _r("sum(n / total * ln(n * total / nb / ny))") + " AS information FROM ("
    "SELECT CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER () AS DOUBLE) AS total, CAST(sum(n) OVER (PARTITION BY b) AS DOUBLE) AS nb, "
    "CAST(sum(n) OVER (PARTITION BY y) AS DOUBLE) AS ny FROM (SELECT CASE WHEN l_linenumber > 2 THEN l_quantity ELSE 0 END AS b, "
    "l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY ALL))",
)
def mi_missing(spark, sf_dir):
    """NaN and null count as 0."""
    value = "CASE l_linenumber WHEN 1 THEN CAST('NaN' AS DOUBLE) WHEN 2 THEN NULL ELSE l_quantity END AS value"
    lines = read(spark, sf_dir, "lineitem").selectExpr("l_returnflag", value)
    scores = mutual_information(feature_matrix(lines, ["value"], "l_returnflag", Problem.classification))
    return scores.select(F.lit("value").alias("feature"), F.expr(f"{_r('information')} AS information"))
