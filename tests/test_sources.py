from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from conftest import rows
from featloom import (
    Aggregate,
    Attribute,
    Filter,
    Identity,
    from_csv,
    from_csv_dir,
    from_frames,
    from_parquet,
    load_dataset,
    read_known,
    save_dataset,
)

CSV = "id,amount,day,flag\n1,1.5,2021-02-03,true\n2,NA,2021-02-04,false\n3,none,2021-02-05,true\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    (tmp_path / "b.csv").write_text("k,v\n1,x\n2,NA\n")
    (tmp_path / "notes.txt").write_text("no table")
    return tmp_path


def test_csv_types_and_names(spark, folder):
    table = from_csv(spark, f"{folder}/a.csv", null_values=["NA", "none"]).table("a.csv")
    assert [f.dataType.simpleString() for f in table.data.schema] == ["bigint", "double", "string", "boolean"]
    assert rows(table.data.select("id", "amount")) == [(1, 1.5), (2, None), (3, None)]
    assert Attribute.not_null not in table.column("amount").attributes
    single = from_csv(spark, [f"{folder}/b.csv"], null_values="NA").table("b.csv")
    assert rows(single.data) == [(1, "x"), (2, None)]
    plain = from_csv(spark, f"{folder}/a.csv").table("a.csv")
    assert dict(plain.data.dtypes)["day"] == "string" and dict(plain.data.dtypes)["amount"] == "string"


def test_csv_errors(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        from_csv(spark, f"{tmp_path}/bad.csv").table("bad.csv").data.collect()
    with pytest.warns(UserWarning, match="1 rows do not fit"):
        loose = from_csv(spark, f"{tmp_path}/bad.csv", ignore_errors=True).table("bad.csv").data
    assert sorted(loose.collect()) == [(1, 2), (3, 4)]


QUOTED = 'id,text,ok\n1,"say ""hi"", ok",Y\n2,"two\nlines",N\n3,"",Y\n'


@pytest.mark.parametrize("nulls", [None, "NA", ["NA", "-"]])
def test_csv_quotes_and_line_breaks(spark, tmp_path, nulls):
    (tmp_path / "q.csv").write_text(QUOTED)
    for data in (from_csv(spark, f"{tmp_path}/q.csv", null_values=nulls), from_csv_dir(spark, str(tmp_path))):
        frame = data.table("q.csv").data
        assert [f.dataType.simpleString() for f in frame.schema] == ["bigint", "string", "string"]
        assert sorted(frame.collect())[:2] == [(1, 'say "hi", ok', "Y"), (2, "two\nlines", "N")]
    known = read_known(spark, f"{tmp_path}/q.csv", spark.createDataFrame([("x", 1)], "text string, id int"))
    assert sorted(known.collect(), key=lambda r: r.id)[1] == ("two\nlines", 2)


def test_csv_types_do_not_depend_on_null_markers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c,d\n1,true,2.5,2021-01-01\n2,FALSE,NA,2021-01-02\n,true,3,-\n")
    kinds = [
        from_csv(spark, f"{tmp_path}/t.csv", null_values=nulls).table("t.csv").data.dtypes
        for nulls in ("NA", ["NA", "-"], ["NA", "-", "none"])
    ]
    assert kinds[0] == kinds[1] == kinds[2] == [("a", "bigint"), ("b", "boolean"), ("c", "double"), ("d", "string")]


def test_csv_folder(spark, folder):
    data = from_csv_dir(spark, str(folder))
    assert [t.name for t in data] == ["a.csv", "b.csv"]
    assert rows(data.table("b.csv").data) == [(1, "x"), (2, None)]


def test_parquet_and_frames(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/numbers.parquet")
    assert from_parquet(spark, f"{tmp_path}/numbers.parquet").table("numbers").max_rows == 5
    data = from_frames(spark, {"p": pd.DataFrame({"x": [1, 2]}), "d": {"y": ["a", "b"]}, "s": spark.range(2), "n": {"z": np.arange(3), "w": np.array([0.5, 1.5, 2.5])}})
    assert [t.data.count() for t in data] == [2, 2, 2, 3]
    assert sorted(data.table("n").data.collect()) == [(0, 0.5), (1, 1.5), (2, 2.5)]


def test_known_rows_are_matched_by_name(spark, tmp_path):
    (tmp_path / "known.csv").write_text("note,amount,k\nhi,2.50,7\n")
    known = spark.createDataFrame([(1, 1.0)], "k bigint, amount double")
    found = read_known(spark, f"{tmp_path}/known.csv", known)
    assert found.dtypes == known.dtypes and rows(found) == [(7, 2.5)]
    with pytest.raises(ValueError, match="lacks"):
        read_known(spark, f"{tmp_path}/known.csv", spark.createDataFrame([(1,)], "other int"))


def test_save_and_load(spark, tmp_path):
    data = from_frames(spark, {"t": {"k": [1, 1, 2], "x": [1.0, 2.0, 3.0], "f": [True, False, True]}})
    aggregate = Aggregate(is_pivotable=["k"])
    made = data.apply(Identity().then(Identity(), aggregate, Filter().then(aggregate)))
    save_dataset(made, f"{tmp_path}/saved")
    loaded = load_dataset(spark, f"{tmp_path}/saved")
    assert [t.name for t in loaded] == [t.name for t in made]
    for a, b in zip(made, loaded):
        assert rows(a.data) == rows(b.data)
        assert [(c.name, c.attributes, c.roots) for c in a.columns] == [(c.name, c.attributes, c.roots) for c in b.columns]


def test_only_columns_that_are_asked_for_are_profiled(spark, monkeypatch):
    """No job for rows and names, one profile of what is kept, and never the same column twice."""
    from featloom import Drop, Keep, from_frames
    from featloom.plans import profile as module

    asked = []

    def recorded(frame, *, exact=False, names=None):
        asked.append(sorted(names))
        return profile(frame, exact=exact, names=names)

    profile = module.profile
    monkeypatch.setattr(module, "profile", recorded)
    frame = spark.range(30).selectExpr("id AS a", "id % 3 AS b", "CAST(id AS STRING) AS c", "id / 2 AS d")
    data = from_frames(spark, {"t": frame})
    kept = data.apply(Keep(columns=[("a", "t"), ("b", "t"), ("d", "t")])).apply(Drop(columns=[("d", "t")]))
    assert kept.table("t").data.columns == ["a", "b"] and kept.table("t").data.count() == 30
    assert asked == []
    whole = data.tables[0]
    assert [sorted(map(str, c.attributes)) for c in kept.tables[0].columns] == [
        sorted(map(str, whole.column(n).attributes)) for n in "ab"
    ]
    assert asked == [["a", "b"], ["c", "d"]]
    assert kept.tables[0].unique_on == {"a"} and kept.tables[0].max_rows == 30


def test_files_are_split_unless_records_span_lines(spark, tmp_path):
    """The lines decide, and both ways of reading give the same rows."""
    from featloom import from_csv
    from featloom.sources.files import _spans_lines

    plain = "a,b\n" + "".join(f'{i},"x ""{i}"", y"\n' for i in range(4000))
    files = {
        "plain": (plain, False),
        "windows": (plain.replace("\n", "\r\n"), False),
        "spanning": (plain + '4000,"one\ntwo"\n', True),
        "inches": (plain + '4001,5" pipe\n', True),
        "returns": (plain + '4002,"one\rtwo"\n', True),
        "empty": ("a,b\n", False),
    }
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        for name, (text, spans) in files.items():
            path = str(tmp_path / f"{name}.csv")
            (tmp_path / f"{name}.csv").write_bytes(text.encode())
            assert _spans_lines(spark, path) is spans, name
            chosen = from_csv(spark, path).tables[0].data
            assert rows(chosen) == rows(from_csv(spark, path, multi_line=True).tables[0].data), name
            assert (chosen.rdd.getNumPartitions() > 3) is (not spans and name != "empty"), name
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
