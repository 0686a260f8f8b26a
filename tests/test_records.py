"""CSV records cut split by split, beside Python's own CSV reader."""

from __future__ import annotations

import csv as plain_csv
import io
import random

import pytest

from tablescope.sources import csv, records, rows


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "64"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def plain(data: str) -> list[list[str]]:
    """Records of one file without the header; blank lines between records are none."""
    found = [r for r in plain_csv.reader(io.StringIO(data, newline="")) if r and any(f.strip() for f in r) or len(r) > 1]
    return found[1:]


CELLS = ["1", "plain", '"quoted"', '"two\nlines"', '"a ""b"" c"', '"x\n\n\ny"', '5" pipe', '""', "", '","', '"long\n' + "z" * 300 + '\nend"', '"\r\n"', '"é\n"']


def content(seed: int, n: int, newline: str) -> str:
    rng = random.Random(seed)
    out = ["a,b,c"]
    for i in range(n):
        out.append(",".join([str(i), rng.choice(CELLS), rng.choice(CELLS)]))
        if rng.random() < 0.05:
            out.append("")
    return newline.join(out) + (newline if seed % 2 else "")


@pytest.mark.parametrize("seed, broadcast", [(1, 200_000), (2, 200_000), (3, 0)])
def test_records_of_many_splits(spark, tmp_path, small_splits, monkeypatch, seed, broadcast):
    monkeypatch.setattr(records, "BROADCAST_SPLITS", broadcast)
    folder = tmp_path / "t.csv"
    folder.mkdir()
    want = []
    for name in ("a.csv", "b.csv", "c.csv"):
        data = content(seed, 30, "\r\n" if seed == 2 else "\n")
        (folder / name).write_bytes(data.encode())
        want += plain(data)
    found = records.csv_records(spark, str(folder))
    assert found.n_splits > 12
    df, names = csv._numbered(spark, str(folder), "auto", None)
    got = sorted(tuple(r) for r in df.collect())
    assert names == ["a", "b", "c"] and [r[0] for r in got] == list(range(len(want)))
    assert [["" if v is None else v for v in r[1:4]] for r in got] == want
    for limit in (17, 31):
        head = records.csv_records(spark, str(folder)).rows(limit).collect()
        assert sorted(r.row_id for r in head) == list(range(limit))


def test_states_of_lines():
    for line, out, inside in [
        (b"", False, True), (b"a,b", False, True), (b'"a', True, False), (b'a"', False, False), (b'"a""', True, False),
        (b'"a"",b"', False, False), (b'x,"y', True, False), (b'"a"b,"', True, True), (b'""', False, True), (b'"', True, False), (b'5" x,"', True, True),
    ]:
        assert records.ends_inside(line, False) == out, line
        assert records.ends_inside(line, True) == inside, line


def test_place_in_file_and_first_rows(spark, tmp_path, small_splits):
    path = tmp_path / "n.csv"
    path.write_text("v,t\n" + "".join(f'{i * 3},"t\n{i}"\n' for i in range(200)))
    df = csv.read_csv_typed(spark, str(path), row_id="row")
    assert df.dtypes == [("row", "bigint"), ("v", "bigint"), ("t", "string")]
    assert sorted(map(tuple, df.collect())) == [(i, i * 3, f"t\n{i}") for i in range(200)]
    assert sorted(map(tuple, csv.read_csv_typed(spark, str(path), limit=7).collect())) == [(i * 3, f"t\n{i}") for i in range(7)]
    with pytest.raises(ValueError, match="has a column"):
        csv.read_csv_typed(spark, str(path), row_id="v")
    with pytest.raises(ValueError, match="empty"):
        csv.read_csv_typed(spark, str(path), limit=0)


def test_latin1_with_line_breaks(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_bytes('n,t\n1,"né\nx"\n'.encode("latin-1"))
    assert csv.read_csv_typed(spark, str(path)).first()["t"] == "né\nx"


def test_headers_with_breaks_and_repeats(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text('\n"a\nb",a,,a\n1,2,3,4\n"x\ny",2,3,4,5\n')
    assert csv.read_csv_typed(spark, str(path), on_bad="skip").columns == ["a\nb", "a", "Unnamed: 2", "a.1"]
    assert [tuple(r) for r in csv.bad_records(spark, str(path)).collect()] == [("x\ny", "2", "3", "4", "5")]


def test_unclosed_quote_ends_with_the_file(spark, tmp_path, small_splits):
    path = tmp_path / "u.csv"
    path.write_text('a,b\n1,"open\n' + "rest\n" * 100)
    assert [r["row_id"] for r in records.csv_records(spark, str(path)).rows().collect()] == [0]


def test_unordered_limit_of_a_scan(spark, tmp_path):
    spark.range(1000).repartition(7).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    for n in (1, 150, 999, 1000, 5000):
        found = rows.limit_rows(df, n, top_rows=0)
        assert found.distinct().count() == min(n, 1000) and found.columns == ["id"]
    shuffled = df.groupBy((df["id"] % 100).alias("k")).count()
    assert rows.limit_rows(shuffled, 30, top_rows=0).count() == 30
