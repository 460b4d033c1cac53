from __future__ import annotations

import pytest

from conftest import rows
from featloom import (
    AllOf,
    AnyOf,
    Attribute,
    Cast,
    Column,
    Combine,
    Encode,
    Identity,
    Rename,
    Table,
    drop_related,
    from_frames,
    into_dataset,
)
from featloom.functions import literal, quote


# How transforms have to combine.
@pytest.mark.parametrize(
    ("actual", "expected"),
    [
        (Identity().then(Identity()), Identity()),
        (Identity().then(Cast()), Cast()),
        (Cast().then(Identity()), Cast()),
        (Identity().then(Identity(), Cast()), AnyOf([Identity(), Cast()])),
        (Cast().then(Combine()).then(Encode()), AllOf([Cast(), Combine(), Encode()])),
        (Cast().then(Combine(), Identity()), AnyOf([AllOf([Cast(), Combine()]), Cast()])),
        (Cast().then(Combine().then(Encode())), (Cast().then(Combine())).then(Encode())),
    ],
)
def test_then(actual, expected):
    assert actual == expected


X = Column(name="x", attributes={Attribute.numeric})
Y = Column(name="y", attributes={Attribute.boolean})
MIN = Column(name="min(x)", derived_from=[(X, "t")])
MAX = Column(name="max(x)", derived_from=[(X, "t")])


@pytest.mark.parametrize("a", [X, Y, MIN, MAX])
@pytest.mark.parametrize("b", [X, Y, MIN, MAX])
def test_is_related(a, b):
    assert a.is_related(b) == ((a is Y) == (b is Y))


def test_select_and_lookup(spark):
    data = from_frames(spark, {"t": {"x": [1, 2, 3], "y": [True, False, True]}})
    table = data.table("t")
    chosen = table.select([table.column("x")])
    assert (chosen.name, [c.name for c in chosen.columns]) == ("t", ["x"])
    assert chosen.data.columns == ["x"]
    with pytest.raises(ValueError):
        data.table("unknown")
    with pytest.raises(ValueError):
        table.column("z")


def test_into_dataset_flattens(spark):
    a, b = from_frames(spark, {"a": {"x": [1]}, "b": {"x": [2]}})
    assert [t.name for t in into_dataset(a, [from_frames(spark, {"c": {"x": [1]}}), [b]])] == ["a", "c", "b"]


def test_names_that_need_quoting(spark):
    frame = spark.createDataFrame([(1, 2.0, "it's \\ok")], "`a.b` int, `x``y` double, `p (q, r)` string")
    data = from_frames(spark, {"t.csv": frame}).apply(Encode())
    table = data.table("t.csv")
    assert table.data.first()["p (q, r) == it's \\ok"] is True
    assert quote("x`y") == "`x``y`"
    assert spark.range(1).selectExpr(f"{literal(chr(39) + chr(92))} AS v").first()[0] == "'\\"


def test_case_collisions_are_reported(spark):
    with pytest.raises(ValueError, match="collide"):
        Table(name="t", columns=[Column(name="a"), Column(name="A")], data=spark.range(1))


def test_rename_keeps_lineage_and_taken_names(spark):
    data = from_frames(spark, {"t": {"a": [1], "b": [2]}}).apply(Rename(mapping={"a": "c", "b": "a"}))
    table = data.table("t")
    # "a" was still taken when "b" asked for it
    assert rows(table.data) == [(1, 2)] and table.data.columns == ["c", "b"]
    assert table.column("c").roots == {("a", "t")}


def test_drop_related_by_name_and_by_table(spark):
    data = from_frames(spark, {"t": {"a": [1, 1], "b": [2, 2]}, "u": {"a": [1, 1], "c": [3, 3]}})
    target = data.table("t").column("a")
    assert [[c.name for c in t.columns] for t in drop_related(data, target)] == [["b"], ["c"]]
    qualified = drop_related(data, target, table="t", qualified=True)
    assert [[c.name for c in t.columns] for t in qualified] == [["b"], ["a", "c"]]
