"""CSV reading, limits, sinks and the catalog."""

import os

import pytest

from tablescope.operators import catalog
from tablescope.sources import csv, rows, sinks


def write(tmp_path, data, name="t.csv"):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_types_and_missing_tokens(spark, tmp_path):
    path = write(tmp_path, "i,d,b,s,e,m\n1,1.5,True,x,,1\n2,NA,False,1d,NaN,\n-3,1e3,true,NULL,null,2\n")
    df = csv.read_csv_typed(spark, path)
    assert dict(df.dtypes) == {"i": "bigint", "d": "double", "b": "boolean", "s": "string", "e": "double", "m": "bigint"}
    assert [r["d"] for r in df.orderBy("i").collect()] == [1000.0, 1.5, None]
    assert df.where("s is null").count() == 1


def test_header_repair(spark, tmp_path):
    df = csv.read_csv_typed(spark, write(tmp_path, "a,a,,a.1,a\n1,2,3,4,5\n"))
    assert df.columns == ["a", "a.2", "Unnamed: 2", "a.1", "a.3"]
    assert csv.header_names(["a", "a", None]) == ["a", "a.1", "Unnamed: 2"]


def test_headers_of_a_folder(spark, tmp_path):
    folder = tmp_path / "parts.csv"
    folder.mkdir()
    for name, data in (("a.csv", "a,b\n1,2\n"), ("b.csv", "\na,b\n3,4\n")):
        (folder / name).write_text(data)
    assert sorted(map(tuple, csv.read_csv_typed(spark, str(folder)).collect())) == [(1, 2), (3, 4)]
    (folder / "c.csv").write_text("b,a\n5,6\n")
    for known in ({}, {"encoding": "UTF-8", "multiline": False}):
        with pytest.raises(ValueError, match="different headers"):
            csv.read_csv_typed(spark, str(folder), **known)


def test_latin1_fallback(spark, tmp_path):
    df = csv.read_csv_typed(spark, write(tmp_path, "n,t\n1,né\n".encode("latin-1")))
    assert df.first()["t"] == "né"
    assert csv.read_csv_typed(spark, write(tmp_path, "n,t\n1,né\n", "u.csv")).first()["t"] == "né"


def test_short_and_long_rows(spark, tmp_path):
    path = write(tmp_path, 'a,b\n1,2\n3\n4,5,"6,7"\n')
    with pytest.raises(ValueError, match="more than 2 fields"):
        csv.read_csv_typed(spark, path)
    df = csv.read_csv_typed(spark, path, on_bad="skip")
    assert sorted(map(tuple, df.collect())) == [(1, 2), (3, None)]
    assert [tuple(r) for r in csv.bad_records(spark, path).collect()] == [("4", "5", "6,7")]


def test_rejected_files(spark, tmp_path):
    with pytest.raises(ValueError, match="CSV"):
        csv.read_csv_typed(spark, "t.xlsx")
    with pytest.raises(ValueError, match="empty"):
        csv.read_csv_typed(spark, write(tmp_path, "a,b\n"))


def test_limits(spark):
    df = spark.range(5)
    assert rows.limit_rows(df, "2", ["id"]).count() == 2
    assert rows.limit_rows(df, "all").count() == 5 and rows.limit_rows(df, "").count() == 5
    for wrong in (0, -1, "x", 1.5j):
        with pytest.raises(ValueError):
            rows.limit_rows(df, wrong)
    info = rows.sample_info(rows.limit_rows(df, 2, ["id"]), df, 2).first()
    assert info["mode"] == "limited" and info["percent"] == 40.0
    assert rows.sample_info(df).first()["mode"] == "full"


def test_sinks(spark, tmp_path):
    df = spark.range(3)
    paths = sinks.save_all({"x": df, "y": df}, str(tmp_path / "out"))
    assert spark.read.parquet(paths["y"]).count() == 3 and os.path.isdir(paths["x"])
    with pytest.raises(ValueError):
        sinks.save(df, str(tmp_path / "z"), "xml")


def test_dictionary_life_cycle(spark):
    entry = "username string, column_name string, description string, semantic_role string, " \
        "class_descriptions map<string,string>, source_column string, updated_at timestamp"
    raw = spark.sql(
        """SELECT 'u' username, ' a ' column_name, concat('\\t', repeat('x', 2000)) description, 'Target' semantic_role,
        map(' 1 ', 'one', '2', ' ', '1', 'uno') class_descriptions, 'b' source_column, timestamp'2024-01-01' updated_at
        UNION ALL SELECT 'u', 'a', '', 'boss', map(), '', timestamp'2024-01-01'
        UNION ALL SELECT 'u', 'a', '', 'target', map(), 'a', timestamp'2024-01-01'"""
    )
    good, bad = catalog.normalise_dictionary(raw, ["a", "b"])
    row = good.first()
    assert row["column_name"] == "a" and len(row["description"]) == 1500 and row["class_descriptions"] == {"1": "uno"}
    assert {r["reason"] for r in bad.collect()} == {"unknown_role", "source_is_the_column_itself"}
    newer = spark.createDataFrame([("u", "a", "new", "feature", {}, "", None)], entry)
    merged = catalog.upsert_dictionary(good, newer)
    assert [r["description"] for r in merged.collect()] == ["new"]
    assert catalog.prune_dictionary(merged, ["b"]).count() == 0


def test_state_of_another_dataset_is_hidden(spark):
    states = spark.sql(
        """SELECT 'u' username, 'k' state_key, '{"dataset_id": "1"}' payload, timestamp'2024-01-01' updated_at
        UNION ALL SELECT 'u', 'k', '{"dataset_id": "2"}', timestamp'2024-01-02'"""
    )
    assert catalog.current_states(states, "1").count() == 0 and catalog.current_states(states, "2").count() == 1


def test_quoted_line_breaks_are_found(spark, tmp_path):
    from tablescope.sources.csv import read_csv_typed

    path = tmp_path / "broken.csv"
    path.write_text('a,b,c\n1,"two\nlines",3\n2,plain,4\n')
    rows = read_csv_typed(spark, str(path)).orderBy("a").collect()
    assert [tuple(r) for r in rows] == [(1, "two\nlines", 3), (2, "plain", 4)]
