import pytest

from tablegauge.sources import tables as T
from tablegauge.sources.schema import columns_table


@pytest.fixture
def base(tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data_x").mkdir()
    (tmp_path / "data" / "a.csv").write_text("id,name,when,amount\n1,x,2024-01-01,1.5\n2,N/A,2024-01-02,\n3,null,2024-01-03,NA\n")
    (tmp_path / "data_x" / "b.csv").write_text("id\n1\n")
    return str(tmp_path / "data")


def test_read_csv_with_na_values(spark, base):
    df = T.read_table(spark, "a.csv", base, na_values=["NA", "N/A", "null"])
    assert dict(df.dtypes) == {"id": "int", "name": "string", "when": "date", "amount": "double"}
    assert [r["name"] for r in df.collect()] == ["x", None, None]


@pytest.mark.parametrize("name", ["../data_x/b.csv", "../../etc/passwd", "/etc/passwd", ".", "x/../../data_x/b.csv"])
def test_names_cannot_leave_the_folder(spark, base, name):
    with pytest.raises(ValueError):
        T.read_table(spark, name, base)


def test_missing_file_and_wrong_suffix(spark, base):
    with pytest.raises(FileNotFoundError):
        T.read_table(spark, "nope.csv", base)
    with pytest.raises(ValueError):
        T.read_table(spark, "a.txt", base)


def test_listing_and_columns(spark, base):
    assert [r["dataset"] for r in T.list_datasets(spark, base).collect()] == ["a.csv"]
    df = T.read_table(spark, "a.csv", base, na_values=[])
    meta = columns_table(spark, {"a": df}).collect()
    assert [(r["ordinal"], r["column"], r["kind"]) for r in meta] == [
        (0, "id", "numeric"), (1, "name", "string"), (2, "when", "temporal"), (3, "amount", "string")]


def test_write_round_trip(spark, base, tmp_path):
    df = T.read_table(spark, "a.csv", base)
    for fmt in ("csv", "parquet", "json"):
        path = T.write_result(df, str(tmp_path / f"out_{fmt}"), fmt)
        assert spark.read.format(fmt).option("header", True).load(path).count() == 3


def test_all_missing_texts_are_null_before_types_are_found(spark, base, tmp_path):
    (tmp_path / "data" / "m.csv").write_text("a,b,c,d,e,f\n1,2.5,true,y,2024-01-01 10:00:00,NA\nNA,N/A,NaN,n,#N/A,\nn/a,7,FALSE,None,2024-02-01 11:00:00,null\n3000000000,1e3,,y,,nan\n")
    df = T.read_table(spark, "m.csv", base)
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "timestamp", "f": "string"}
    assert [r["a"] for r in df.collect()] == [1, None, None, 3000000000] and df.where("f is not null").count() == 0
    assert dict(T.read_table(spark, "m.csv", base, na_values=[]).dtypes)["a"] == "string"


@pytest.mark.parametrize("base, path", [
    ("s3a://bucket", "s3a://bucket/x/a.csv"), ("s3a://bucket/dir/", "s3a://bucket/dir/x/a.csv"), ("hdfs://host:8020/d", "hdfs://host:8020/d/x/a.csv"),
    ("file:/d", "file:/d/x/a.csv"), ("/d/../e", "/e/x/a.csv"), ("viewfs://store/in", "viewfs://store/in/x/a.csv"),
])
def test_stores_keep_their_names(base, path):
    assert T.resolve(base, "x/a.csv") == path
    for out in ("../y/a.csv", "/a.csv", "..") if base.rstrip("/").count("/") > 2 else ():
        with pytest.raises(ValueError):
            T.resolve(base, out)


@pytest.fixture
def csv(spark, base):
    """text -> the table that a file with it gives."""
    from pathlib import Path

    def read(text, **options):
        (Path(base) / "t.csv").write_bytes(text.encode())
        return T.read_table(spark, "t.csv", base, **options)

    return read


def test_quoted_cells(csv):
    df = csv('a,b,c\n1,"two\nlines",3\n2,"say ""hi"", ok",4\n3,"","x ""y"""\n4,\'q\',\\"\n')
    assert dict(df.dtypes) == {"a": "int", "b": "string", "c": "string"}
    assert [tuple(r) for r in df.collect()] == [(1, "two\nlines", "3"), (2, 'say "hi", ok', "4"), (3, None, 'x "y"'), (4, "'q'", '\\"')]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_lines_without_text_are_skipped(csv, end):
    df = csv(end.join(["a,b", "1,x", "", "   ", "2,y", "", ""]))
    assert [tuple(r) for r in df.collect()] == [(1, "x"), (2, "y")]
    quoted = csv(end.join(["a,b", '1,"x', 'z"', "", "  ", "2,y", ""]))
    assert [tuple(r) for r in quoted.collect()] == [(1, "x\nz"), (2, "y")]


def test_uneven_records(spark, base, csv):
    with pytest.raises(ValueError, match="more cells"):
        csv("a,b\n1,2\n3,4,5\n")
    assert [tuple(r) for r in csv("a,b\n1,2\n3,4,5\n6\n", uneven="keep").collect()] == [(1, 2), (3, 4), (6, None)]
    assert tuple(T.record_account(spark, "t.csv", base).first()) == (3, 1, 1, 1)
    assert {tuple(r) for r in T.uneven_records(spark, "t.csv", base).collect()} == {("3,4,5", 3, 2), ("6", 1, 2)}
    # separators and line ends inside quotes are no cells
    csv('a,b\n1,"x,y"\n2,"p\nq",3,"r,s"\n', uneven="keep")
    assert tuple(T.record_account(spark, "t.csv", base).first()) == (2, 1, 0, 1)
    assert T.uneven_records(spark, "t.csv", base).first()["cells"] == 4
    with pytest.raises(ValueError):
        csv("a\n1\n", uneven="drop")


def test_a_given_schema_and_uneven_records(csv):
    typed = csv("a,b\n1,x\n2\n", schema="id long, name string")
    assert [tuple(r) for r in typed.collect()] == [(1, "x"), (2, None)]
    with pytest.raises(Exception, match="more cells"):
        csv("a,b\n1,x,9\n", schema="id long, name string").collect()
    assert csv("a,b\n1,x,9\n", schema="id long, name string", uneven="keep").count() == 1
    assert csv("a,b\nno,x\n", schema="id long, name string").first()["id"] is None
    with pytest.raises(ValueError):
        csv("a,b\n1,x\n", schema="id long")


def test_header_names(csv):
    df = csv("id,,id,ID,\n1,2,3,4,5\n")
    assert df.columns == ["id", "Unnamed: 1", "id.1", "ID", "Unnamed: 4"] and tuple(df.first()) == (1, 2, 3, 4, 5)
    assert csv("﻿a,b\n1,2\n").columns == ["a", "b"]
    with pytest.raises(ValueError, match="no header"):
        csv("")
    assert csv("a,b\n").count() == 0


def test_lines_that_close_their_quotes_are_split(spark, base, csv):
    plain = csv('a,b\n1,"x, ""y"""\n')
    assert "multiLine" not in plain._jdf.queryExecution().toString() or "multiLine=true" not in plain._jdf.queryExecution().toString()
    found, _ = T._records(spark, T.resolve(base, "t.csv"))
    assert found.collect()[0]["c1"] == 'x, "y"'


def test_against_the_usual_reader(spark, base, csv):
    import io
    import random

    import pandas as pd

    rng = random.Random(3)
    cell = lambda: rng.choice(["1", "2.5", "x", '"a,b"', '"l\nm"', '"q""r"', '""', "NA", " pad ", "null", "é", '"NaN"'])
    for _ in range(4):
        text = "k,u,v\n" + "".join(f"{i},{cell()},{cell()}\n" for i in range(30)) + "99,short\n"
        want = pd.read_csv(io.StringIO(text), dtype={"u": str, "v": str})
        got = csv(text, schema="k int, u string, v string").orderBy("k").collect()
        assert [tuple(r) for r in got] == [tuple(None if pd.isna(x) else x for x in row) for row in want.itertuples(index=False)]


def test_texts_survive_a_round_trip(spark, base):
    rows = [(1, "a\nb"), (2, 'say "x", y'), (3, "  padded  "), (4, "back\\slash\\"), (5, None), (6, "tab\there"), (7, "\r\nend")]
    T.write_result(spark.createDataFrame(rows, "id int, t string"), f"{base}/r.csv", "csv")
    assert sorted(map(tuple, T.read_table(spark, "r.csv", base).collect())) == rows
