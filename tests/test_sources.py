"""Sources and cleaning on small literal files."""

import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightline.sources import cleaning, records, sql
from sightline.sources.csv import csv_source, title_row_skip
from sightline.sources.json import json_flatten, json_source


def table(spark, **columns):
    return spark.createDataFrame(pa.table(columns))


def write(path, data, encoding="utf-8"):
    path.write_bytes(data.encode(encoding))
    return str(path)


def test_csv_falls_back_to_latin1(spark, tmp_path):
    notes = []
    df = csv_source(spark, write(tmp_path / "a.csv", "n,v\nCafé,1\n", "latin-1"), warnings=notes)
    assert df.collect()[0]["n"] == "Café" and len(notes) == 1
    plain = csv_source(spark, write(tmp_path / "b.csv", "n,v\nCafé,1\n"))
    assert plain.collect()[0]["n"] == "Café"


def test_title_line(spark, tmp_path):
    notes = []
    df = title_row_skip(spark, write(tmp_path / "t.csv", "x,y,z\nSales,,\n1,2,3\n4,5,6\n"), warnings=notes)
    assert df.columns == ["Sales", "Unnamed: 1", "Unnamed: 2"] and df.count() == 2 and notes
    same = title_row_skip(spark, write(tmp_path / "s.csv", "x,y\n1,2\n"))
    assert same.columns == ["x", "y"]


@pytest.mark.parametrize(
    "doc, columns, rows",
    [
        ('[{"a": 1}, {"a": 2, "b": "x"}]', {"a", "b"}, 2),
        ('{"meta": 1, "items": [{"a": 1}, {"a": 2}]}', {"a"}, 2),
        ('{"r1": {"a": 1}, "r2": {"a": 2}}', {"a"}, 2),
        ("[1, 2, 3]", {"value"}, 3),
    ],
)
def test_json_roots(spark, tmp_path, doc, columns, rows):
    df = json_source(spark, write(tmp_path / "d.json", doc))
    assert set(df.columns) == columns and df.count() == rows


def test_flatten_types_and_limits(spark):
    df = table(spark, j=['{"a": 1, "b": 2.5, "c": "x"}', '{"a": 3}', None], k=[1, 2, 3])
    out = json_flatten(df, ["j"])
    assert dict(out.dtypes) == {"k": "bigint", "j_a": "bigint", "j_b": "double", "j_c": "string"}
    assert [r["j_a"] for r in out.orderBy("k").collect()] == [1, 3, None]
    wide = table(spark, j=["{" + ",".join(f'"f{i}": {i}' for i in range(60)) + "}"])
    notes = []
    assert len(json_flatten(wide, ["j"]).columns) == 60
    assert json_flatten(wide, ["j"], notes, max_fields=50).columns == [] and "Dropped" in notes[0]
    assert json_flatten(wide, ["j"], max_columns=0).columns == ["j"]


def test_guarded_statements(spark):
    assert sql.status_of("select 1 -- DROP TABLE x") == "query"
    assert sql.status_of("SELECT 1; DROP TABLE x") == "blocked"
    log, result = sql.sql_guarded_batch(spark, ["SELECT 1 AS a", "SELECT 2 AS a UNION ALL SELECT 3", "SELEC"])
    assert [r["status"] for r in log.orderBy("statement_no").collect()] == ["query", "query", "ignored"]
    assert sorted(r["a"] for r in result.collect()) == [2, 3]


def test_dump_reports_what_it_cannot_read(spark, tmp_path):
    path = write(tmp_path / "d.sql", "CREATE TABLE t (a INT);\nINSERT INTO t (a, b) VALUES (1, 'x'), (2, 'y');\nINSERT INTO t VALUES (3, 'a;b');\n")
    notes = []
    df = sql.sql_dump_load(spark, path, warnings=notes)
    assert df.columns == ["a", "b"] and df.count() == 2
    assert sql.dump_leftovers(spark, path).first()["unsupported"] == 1 and "1 statement" in notes[0]


def test_dump_follows_each_column_list(spark, tmp_path):
    dump = """CREATE TABLE t (b TEXT, a INT, PRIMARY KEY (a));
/* ; */ INSERT INTO `t` (`a`, `b`) VALUES (1, 'p (q); -- '), (2, NULL);
insert into t (b, a) values ('NULL', -3), ('it''s \\'x\\'', 4);
INSERT INTO "t" VALUES ('d', 5);
INSERT INTO u VALUES (1, lower('X'));
UPDATE t SET a = 1;
"""
    notes = []
    got = sql.sql_dump_load(spark, write(tmp_path / "d.sql", dump), table="t", warnings=notes, dialect="mysql").select("a", "b").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("1", "p (q); -- "), ("2", None), ("-3", "NULL"), ("4", "it's 'x'"), ("5", "d")], key=str)
    assert len(notes) == 1
    assert sql.sql_dump_load(spark, str(tmp_path / "d.sql"), table="u", dialect="mysql").first()["c0"] == "1"


def test_csv_as_people_have_it(spark, tmp_path):
    notes = []
    df = csv_source(spark, write(tmp_path / "a.csv", 'a;b\n1;"x\ny"\n2;"p;q"\n3;r;s\n4\n5;t;\n'), warnings=notes, sep=";")
    assert sorted(map(tuple, df.collect()), key=str) == [(1, "x\ny"), (2, "p;q"), (4, None), (5, "t")]
    assert notes == ["Skipped 1 bad lines with more cells than columns"]
    with pytest.raises(ValueError):
        csv_source(spark, write(tmp_path / "e.csv", ""))


def test_title_lines_keep_rows_and_types(spark, tmp_path):
    df = title_row_skip(spark, write(tmp_path / "t.csv", "x,y,z\nSales,,\n1,2,a\nSales,,\n4,5.5,b\n"))
    assert df.count() == 3 and dict(df.dtypes)["Unnamed: 1"] == "double"


def test_json_shapes_in_one_folder(spark, tmp_path):
    notes = []
    for i, doc in enumerate(['[{"a": 1}, {"a": 2}]', '{"r": {"a": 3}}', '{"items": [{"a": 4}], "n": 1}', "[5, 6]", "{broken"]):
        write(tmp_path / f"{i}.json", doc)
    df = json_source(spark, str(tmp_path), warnings=notes)
    assert sorted(r["a"] for r in df.where("a is not null").collect()) == [1, 2, 3, 4]
    assert sorted(r["value"] for r in df.where("value is not null").collect()) == ["5", "6"]
    assert any("Skipped 1" in n for n in notes) and any("'items'" in n for n in notes)


def test_json_schema_covers_every_row(spark, tmp_path):
    """The schema comes from all rows in one pass, nothing is written for it."""
    before = set(tmp_path.iterdir())
    rows = ['{"a": 1, "my key": "x", "n": null, "l": []}', '{"a": 2.5, "o": {"d": [1, 2]}, "big": 123456789012345678901}', '{"a": 1e3, "o": {"z": "q"}, "VOID": true}', '{"a": "t"}']
    path = write(tmp_path / "d.json", "[" + ",".join(rows[:3]) + "]")
    df = json_source(spark, path)
    kinds = dict(df.dtypes)
    assert kinds["a"] == "double" and kinds["my key"] == "string" and kinds["n"] == "string" and kinds["l"] == "array<string>"
    assert kinds["o"] == "struct<d:array<bigint>,z:string>" and kinds["VOID"] == "boolean" and kinds["big"].startswith("decimal")
    assert sorted(r["a"] for r in df.collect()) == [1.0, 2.5, 1000.0] and [r["o"]["z"] for r in df.where("o.z is not null").collect()] == ["q"]
    mixed = json_source(spark, write(tmp_path / "m.json", "[" + ",".join(rows) + "]"))
    assert dict(mixed.dtypes)["a"] == "string" and sorted(r["a"] for r in mixed.collect()) == ["1", "1000.0", "2.5", "t"]
    odd = json_source(spark, write(tmp_path / "o.json", '{"r": {"a": 1}, "s": 5}'))
    assert sorted(map(str, ((r["a"], r["_corrupt_record"]) for r in odd.collect()))) == ["(1, None)", "(None, '5')"]
    assert len(set(tmp_path.iterdir()) - before) == 3


def test_cleaning_keeps_identifiers(spark):
    df = table(spark, customer_id=[f"{i:03d}" for i in range(30)], price=["$1", "$2", "$1"] * 10)
    assert dict(cleaning.clean(df).dtypes) == {"customer_id": "string", "price": "double"}


def test_drop_empty_rejects_nothing(spark):
    with pytest.raises(ValueError):
        cleaning.drop_empty(table(spark, a=pa.array([None, float("nan")], pa.float64())))


@pytest.mark.parametrize(
    "value, expected",
    [
        ("16-Mar-24", dt.datetime(2024, 3, 16)), ("March 16, 2024", dt.datetime(2024, 3, 16)),
        ("2024/03/16", dt.datetime(2024, 3, 16)), ("03/04/2024", dt.datetime(2024, 3, 4)),
        ("2024-03-16T10:11:12", dt.datetime(2024, 3, 16, 10, 11, 12)), ("1-Jan-95", dt.datetime(1995, 1, 1)),
        ("2024-03-16 10:11:12.500", dt.datetime(2024, 3, 16, 10, 11, 12, 500_000)), ("soon", None), ("2024-13-40", None),
    ],
)
def test_date_layouts(spark, value, expected):
    df = table(spark, d=[value])
    assert df.select(cleaning.parsed_date(F.col("d")).alias("t")).first()["t"] == expected


def test_numbers_in_texts(spark):
    df = table(spark, a=["$1,234", "12.5%", "€ 7", "-3", "n/a"], b=["1d", "2d", "3", "4", "5"], c=["1", None, None, None, None])
    out = cleaning.promote_numeric(df)
    assert [r["a"] for r in out.collect()] == [1234.0, 12.5, 7.0, -3.0, None]
    assert dict(out.dtypes)["b"] == "string" and dict(out.dtypes)["c"] == "string"


def test_clean_in_load_order(spark):
    df = table(spark, sale_date=["2024-01-01 ", " 2024-01-02", None], amount=["$1", "$2", None], empty=pa.array([None] * 3, pa.string()))
    out = cleaning.clean(df)
    assert dict(out.dtypes) == {"sale_date": "timestamp", "amount": "double"} and out.count() == 2


def test_sample_is_exact_and_stable(spark):
    df = spark.range(20_000)
    one = {r["id"] for r in records.sample_cap(df, ["id"], 300).collect()}
    two = {r["id"] for r in records.sample_cap(df.repartition(5), ["id"], 300).collect()}
    assert len(one) == 300 and one == two
    assert records.sample_cap(df, ["id"], 300, limit=30_000).count() == 20_000


def test_records_sink(spark, tmp_path):
    df = table(spark, d=[dt.datetime(2024, 1, 2, 3, 4, 5, 600)] * 3, x=[float("inf"), float("nan"), 1.5], k=[1, 2, 3])
    done = records.records_sink(df, str(tmp_path / "out"))
    assert done == {"sampled": False, "sample_size": 3}
    rows = spark.read.json(str(tmp_path / "out")).orderBy("k").collect()
    assert rows[0]["d"] == "2024-01-02T03:04:05" and rows[2]["x"] == 1.5
    assert records.records_sink(df, str(tmp_path / "two"), key=["k"], limit=2) == {"sampled": True, "sample_size": 2}
