"""Quoted CSV and SQL dumps read in many splits give the rows that one reader of the whole file gives."""

import csv
import io
import random

import pytest

from sightline.sources import dump, quoted, sql
from sightline.sources.csv import csv_source, title_row_skip
from sightline.sources.split_text import located


@pytest.fixture
def small_splits(spark):
    """Files are cut every few hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def save(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


# ---- delimited text -----------------------------------------------------------------


def cells(rng):
    kinds = ["plain", "12", "", "two\nlines", 'a "word", quoted', "semi;colon,comma", "\n\n", "x" * rng.randrange(1, 500), '"', "é漢\n", "with\r\nreturn"]
    return [rng.choice(kinds) for _ in range(3)]


def test_quoted_csv_in_many_splits(spark, tmp_path, small_splits):
    rng = random.Random(4)
    rows = [[f"k{i}", *cells(rng)] for i in range(400)]
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator="\n")
    writer.writerows([["k", "a", "b", "c"], *rows])
    path = save(tmp_path / "a.csv", out.getvalue())
    quoting = quoted.Quoting(",", '"', '"', "UTF-8")
    odd, over, opened = quoted.survey(spark, path, quoting)
    assert odd == 0 and over > 100 and sum(x is not None for ends in opened.values() for _, x in ends) > 20
    cut = quoted.records(spark, path, quoting, opened)
    assert cut.rdd.getNumPartitions() > 50
    got = csv_source(spark, path, schema="k string, a string, b string, c string")
    assert sorted(tuple(x or "" for x in r) for r in got.collect()) == sorted(map(tuple, rows))
    inferred = csv_source(spark, path)
    assert inferred.columns == ["k", "a", "b", "c"] and inferred.count() == 400


def test_lines_without_spanning_quotes_go_to_the_reader(spark, tmp_path, small_splits):
    text = "k,a\n" + "".join(f'{i},"x, ""{i}"""\n' for i in range(300))
    got = csv_source(spark, save(tmp_path / "b.csv", text))
    assert got.rdd.getNumPartitions() > 10 and dict(got.dtypes) == {"k": "int", "a": "string"}
    assert sorted(map(tuple, got.collect())) == [(i, f'x, "{i}"') for i in range(300)]


@pytest.mark.parametrize(
    "line, inside, after",
    [
        ('a,"b', False, True), ('b",c', True, False), ('5" pipe,x', False, False), ('a"b,"c', False, True), ('""', True, True), ('"",', True, True),
        ('x""",', True, False), ('"a"b,"c"', False, False), ('"a","b""', False, True), ("", True, True), ('a,"",b', False, False), ('","', True, True),
    ],
)
def test_quotes_like_the_reader(spark, tmp_path, line, inside, after):
    assert quoted.Quoting(",", '"', '"', "UTF-8").open_after(line.encode(), inside) == after
    # the reader agrees: a cell is open if the next line still belongs to the record
    text = ('"z\n' if inside else "") + line + "\nq\n"
    rows = spark.read.options(multiLine=True, quote='"', escape='"').schema("a string, b string, c string, d string").csv(save(tmp_path / "x.csv", text)).collect()
    assert any(r["a"] == "q" for r in rows) != after


def test_escapes_and_encodings_in_splits(spark, tmp_path, small_splits):
    text = "k;a\n" + "".join(f'{i};"é \\"{i}\\";\nnext"\n' for i in range(100))
    notes = []
    got = csv_source(spark, save(tmp_path / "l.csv", text, "latin-1"), warnings=notes, sep=";", escape="\\")
    assert sorted(map(tuple, got.collect())) == [(i, f'é "{i}";\nnext') for i in range(100)] and len(notes) == 1
    wide = csv_source(spark, save(tmp_path / "w.csv", 'k,a\n1,"x\ny"\n', "utf-16"), encoding="UTF-16")
    assert [tuple(r) for r in wide.collect()] == [(1, "x\ny")]


def test_a_cell_that_nothing_closes(spark, tmp_path, small_splits):
    text = "k,a\n" + "".join(f"{i},v\n" for i in range(200)) + '7,"open\n' + "more\n" * 100
    got = csv_source(spark, save(tmp_path / "o.csv", text))
    rows = got.collect()
    assert len(rows) == 201 and max(len(r["a"]) for r in rows) > 400


def test_titles_are_decided_for_each_file(spark, tmp_path, small_splits):
    folder = tmp_path / "many"
    folder.mkdir()
    save(folder / "a.csv", "x,y\nSales,\n1,2\nSales,\n" + "5,6\n" * 200)
    save(folder / "b.csv", "x,y\n3,4\nx,y\n")
    save(folder / "c.csv", 'x,y\nSales,\n"7\n8",9\n')
    got = sorted(map(str, map(tuple, title_row_skip(spark, str(folder)).collect())))
    want = [("1", "2"), ("Sales", None), *[("5", "6")] * 200, ("3", "4"), ("x", "y"), ("7\n8", "9")]
    assert got == sorted(map(str, want))


# ---- dumps --------------------------------------------------------------------------


def quote(value, dialect):
    if value is None:
        return "NULL"
    if dialect == "mysql":
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    return "'" + value.replace("'", "''") + "'"


def texts(rng):
    return rng.choice([None, "", "it's", "a;b", "(x), (y)", "C:\\temp", "back\\", 'say "hi"', "`tick`", "-- no comment", "/* nor this", "line\nbreak", "VALUES (1)", "é" * rng.randrange(200)])


@pytest.mark.parametrize("dialect", ["standard", "mysql"])
@pytest.mark.parametrize("per_statement", [1, 7, 1000])
def test_dump_in_many_splits(spark, tmp_path, small_splits, dialect, per_statement):
    """Statements of any length, even one over the whole file, and values that run over splits."""
    rng = random.Random(per_statement)
    rows = [(str(i), texts(rng), texts(rng)) for i in range(300)]
    parts = ["/* a dump; with (marks */ CREATE TABLE t (a INT, b TEXT DEFAULT 'x;y', c TEXT, PRIMARY KEY (a));\n"]
    for low in range(0, 300, per_statement):
        listed = rng.choice([" (a, b, c)", "", " (`a`, b,\n c)"])
        values = ",\n".join(f"({a}, {quote(b, dialect)},\n {quote(c, dialect)})" for a, b, c in rows[low : low + per_statement])
        parts.append(rng.choice(["", "-- it's next\n", "/* don't */\n"]) + f"INSERT INTO t{listed} VALUES\n{values};\n")
    path = save(tmp_path / "d.sql", "".join(parts))
    assert located(spark, path).rdd.getNumPartitions() > 20
    notes = []
    got = sql.sql_dump_load(spark, path, warnings=notes, dialect=dialect, schema="a string, b string, c string").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows))
    assert notes == []


def test_dump_work_is_shared(spark, tmp_path, small_splits):
    path = save(tmp_path / "one.sql", "INSERT INTO t VALUES\n" + ",\n".join(f"({i}, 'v{i}')" for i in range(2000)) + ";\n")
    found = dump.units(spark, path, dump.Lexer())
    from pyspark.sql import functions as F

    tasks = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == 2000 and len(tasks) > 40 and max(r["count"] for r in tasks) < 100


def test_backslashes_are_text_unless_mysql(spark, tmp_path):
    text = "INSERT INTO t VALUES (1,'C:\\temp');\nINSERT INTO t VALUES (2,'C:\\');\nINSERT INTO t VALUES (3,'x');\nINSERT INTO t VALUES (4,'it''s');\n"
    path, notes = save(tmp_path / "b.sql", text), []
    got = sql.sql_dump_load(spark, path, schema="a int, b string", warnings=notes).collect()
    assert sorted(map(tuple, got)) == [(1, "C:\\temp"), (2, "C:\\"), (3, "x"), (4, "it's")] and notes == []
    text = "# it's a comment\nINSERT IGNORE INTO `t` VALUES (1,'a\\tb\\n\\'\\\\\\%'), (2, \"d\\\"q\"\"r\");\n"
    got = sql.sql_dump_load(spark, save(tmp_path / "m.sql", text), schema="a int, b string", dialect="mysql").collect()
    assert sorted(map(tuple, got)) == [(1, "a\tb\n'\\\\%"), (2, 'd"q"r')]
    with pytest.raises(ValueError):
        sql.dump_rows(spark, path, "other")


def test_what_a_dump_cannot_give_is_counted(spark, tmp_path, small_splits):
    text = (
        "CREATE TABLE t (a INT, b INT);\n"
        + "INSERT INTO t VALUES\n" + ",\n".join(f"({i}, 1)" for i in range(100)) + ",\n(1, 2, 3),\n" + ",\n".join(f"({i}, 2)" for i in range(100)) + ";\n"
        + "INSERT INTO t VALUES (1, 2) ON CONFLICT DO UPDATE SET b = 'x" + "y" * 400 + "\n';\n"
        + "INSERT INTO t SELECT a, b FROM u;\nGRANT ALL ON t TO x;\nBEGIN;\nCOMMIT;\n"
        + "INSERT INTO t (a, b) VALUES (1.5e-3, -4), (lower('X') || 'y', + 5);\n"
        + "INSERT INTO t VALUES (7, 8), (9, 'not closed\n" + "z\n" * 300
    )
    notes = []
    got = sql.sql_dump_load(spark, save(tmp_path / "x.sql", text), warnings=notes).collect()
    assert sorted(map(tuple, got)) == [("1.5e-3", "-4"), ("lower ( 'X' ) || 'y'", "+5"), ("7", "8")][:2]
    assert notes == ["Skipped 5 statements that could not be read"]


def test_statement_without_end(spark, tmp_path):
    got = sql.sql_dump_load(spark, save(tmp_path / "e.sql", "INSERT INTO t (a) VALUES (1), (2)"))
    assert sorted(r["a"] for r in got.collect()) == ["1", "2"]
    notes = []
    rows = sql.dump_rows(spark, save(tmp_path / "f.sql", "-- nothing\nCREATE TABLE t (a INT)"))
    assert rows.count() == 0 and notes == []
