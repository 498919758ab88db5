"""Plain tuples of a dump are cut in runs, and its lines are read twice."""

import pytest

from sightline.sources import dump, sql


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_strings_over_splits_need_no_further_scan(spark, tmp_path, small_splits, monkeypatch):
    path, scans, located = tmp_path / "one.sql", [], dump.located
    rows = [(i, f"line\n(R{i});", None if i % 3 else "it's") for i in range(1000)]
    text = ",\n".join(f"({i}, '{a}', {'NULL' if b is None else "'it''s'"})" for i, a, b in rows)
    path.write_text(f"INSERT INTO t (a, b, c) VALUES\n{text};\n")
    monkeypatch.setattr(dump, "located", lambda *a: scans.append(a) or located(*a))
    found = dump.stored(spark, str(path), dump.Lexer())
    assert len(scans) == 2
    assert found.count() < 100 and found.agg({"n": "sum"}).first()[0] == 1000
    got = sql.sql_dump_load(spark, str(path), schema="a int, b string, c string")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rows))


def test_plain_tuples_are_not_taken_apart_singly(monkeypatch):
    lexer = dump.Lexer()
    reader = dump.Reader(lexer, 0, None)
    singly, of = [], lexer.tuple
    monkeypatch.setattr(lexer, "tuple", lambda text: singly.append(text) or of(text))
    reader.feed(b"INSERT INTO t (a, b) VALUES " + b",\n".join(b"(%d, 'x''y')" % i for i in range(500)) + b",\n(lower('A'), 2), (7, 8);\n")
    assert singly == [b"(lower('A'), 2)"]
    assert [c for r in reader.rows for c in r[5]] == [*([str(i), "x'y"] for i in range(500)), ["lower ( 'A' )", "2"], ["7", "8"]]
    assert max(len(r[5]) for r in reader.rows) == dump.TOGETHER


@pytest.mark.parametrize("dialect", dump.DIALECTS)
def test_runs_give_what_single_tuples_give(dialect):
    lexer = dump.Lexer(dialect)
    back = [rb"('C:\\x', 1)", rb"('\'', '\n')"] if dialect == "mysql" else [rb"('C:\', 1)"]
    for t in [b"(1, -5, +6)", b"( 'a''b' ,'' )", b"(NULL, null, 'NULL')", b"('\xff\xfe', \xe9)", "('é;(\n', 1.5e3)".encode(), *back]:
        assert lexer.run(t).end() == len(t) and lexer.plain(t) == [lexer.tuple(t)], t
    for t in [b"()", b"(1,,2)", b"(1e5.2, 1)", b"(1.5e-3)", b"(a-b)", b"('a' 'b')", b"(f(1))", b"(1 /* ) */)", b'("a")', b"(--5\n)"]:
        assert lexer.run(t).end() == 0, t


def test_a_wrong_length_is_found_within_a_run():
    reader = dump.Reader(dump.Lexer(), 0, None)
    reader.feed(b"INSERT INTO t (a, b) VALUES (1, 2), (3, 4, 5), (6, 7);")
    assert [(r[0], r[5] or r[6]) for r in reader.rows] == [("row", [["1", "2"]]), ("bad", "( 3 , 4 , 5 )"), ("row", [["6", "7"]])]


def test_comments_inside_tuples():
    reader = dump.Reader(dump.Lexer(), 0, None)
    reader.feed(b"INSERT INTO t VALUES (a, -- )\n b), (c, /* ) */ d);")
    assert [c for r in reader.rows for c in r[5]] == [["a", "b"], ["c", "d"]]


def test_summaries_skip_what_is_over():
    lexer = dump.Lexer()
    for before in (b"", b"INSERT INTO t VALUES ('a;b', 1), (f(2), 3); -- ;\n"):
        summary = dump.Summary(lexer, dump.BETWEEN)
        summary.feed(before + b"INSERT INTO t (x, y) VALUES (1, 'values (;'), ((2), 3), (4, (")
        assert summary.row() == {"statements": bool(before), "depth": 2, "low": 0, "rows": True, "header": (b" -- ;\n" if before else b"") + b"INSERT INTO t (x, y) VALUES"}
