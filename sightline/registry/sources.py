"""Source, sink and cleaning queries.

Files are written by Spark from the given tables to shared storage and read
back, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import profile
from sightline.plans.shared import scratch_path
from sightline.registry.base import query, shown, table
from sightline.registry.profiles import union_sql
from sightline.sources import cleaning, records, sql
from sightline.sources.csv import csv_source, title_row_skip
from sightline.sources.json import json_flatten, json_source

BLOCK = 100


@query(
    "csv_source",
    "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, round(c_acctbal, 4) AS c_acctbal, c_mktsegment FROM customer",
)
def read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    table(spark, sf_dir, "customer").write.option("header", True).csv(path)
    return shown(csv_source(spark, path))


@query("csv_latin1", "SELECT c_custkey, 'Café ' || c_mktsegment AS label FROM customer")
def read_latin1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that is no UTF-8 is read again as latin-1."""
    path = scratch_path(spark, "latin1")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("Café "), "c_mktsegment").alias("label")
    )
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return shown(csv_source(spark, path))


@query(
    "json_source",
    union_sql(
        [
            f"SELECT '{shape}' AS shape, c_custkey, {name} AS c_name, {balance} AS c_acctbal FROM customer"
            for shape, name, balance in (
                ("list", "c_name", "round(c_acctbal, 4)"),
                ("keyed list", "c_name", "round(c_acctbal, 4)"),
                ("index", "c_name", "round(c_acctbal, 4)"),
                ("values", "CAST(NULL AS VARCHAR)", "CAST(NULL AS DOUBLE)"),
            )
        ]
    ),
)
def read_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the four root shapes, each holding at most a hundred customers."""
    customer = table(spark, sf_dir, "customer").withColumn("block", F.floor(F.col("c_custkey") / BLOCK))
    item = F.struct("c_custkey", "c_name", "c_acctbal")
    blocks = customer.groupBy("block").agg(F.collect_list(item).alias("rows"))
    docs = {
        "list": F.to_json("rows"),
        "keyed list": F.to_json(F.struct("rows", F.col("block").alias("page"))),
        "index": F.to_json(F.map_from_entries(F.transform("rows", lambda r: F.struct(r["c_name"], r)))),
        "values": F.to_json(F.transform("rows", lambda r: r["c_custkey"])),
    }
    out = None
    for shape, doc in docs.items():
        path = scratch_path(spark, "docs")
        blocks.select(doc.alias("value")).write.text(path)
        rows = json_source(spark, path, whole_file=False)
        if shape == "values":
            rows = rows.select(
                F.col("value").cast("long").alias("c_custkey"),
                F.lit(None).cast("string").alias("c_name"),
                F.lit(None).cast("double").alias("c_acctbal"),
            )
        one = rows.select(F.lit(shape).alias("shape"), "c_custkey", "c_name", "c_acctbal")
        out = one if out is None else out.unionByName(one)
    return shown(out)


@query(
    "json_flatten",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS props_k, event_type AS detail_type, round(value, 4) AS "detail_inner.value"
    FROM events""",
)
def flatten_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of JSON text, a nested struct and a list, which is dropped."""
    events = table(spark, sf_dir, "events").select(
        "event_id",
        "props",
        F.struct(F.col("event_type").alias("type"), F.struct("value").alias("inner")).alias("detail"),
        F.array("user_id").alias("users"),
    )
    return shown(json_flatten(events, ["props"]))


STATEMENTS = [
    "-- all customers\nSELECT c_custkey, c_name FROM sightline_customer",
    "DROP TABLE sightline_customer",
    "SELECT n_nationkey /* key only */ FROM sightline_nation",
    "SELECT * FROM no_such_table_here",
    "UPDATE sightline_nation SET n_name = ''",
    "SELECT name FROM sqlite_master",
    "INSERT INTO sightline_nation VALUES (1)",
    "SELECT c_nationkey, count(*) AS n FROM sightline_customer GROUP BY c_nationkey",
]


@query(
    "sql_guarded_batch",
    union_sql(
        [
            f"SELECT CAST({i} AS BIGINT) AS statement_no, '{status}' AS status, {rows} AS n_rows"
            for i, (status, rows) in enumerate(
                [
                    ("query", "(SELECT count(*) FROM customer)"),
                    ("blocked", "CAST(-1 AS BIGINT)"),
                    ("query", "(SELECT count(*) FROM nation)"),
                    ("failed", "CAST(-1 AS BIGINT)"),
                    ("blocked", "CAST(-1 AS BIGINT)"),
                    ("blocked", "CAST(-1 AS BIGINT)"),
                    ("ignored", "CAST(-1 AS BIGINT)"),
                    ("query", "(SELECT count(DISTINCT c_nationkey) FROM customer)"),
                ]
            )
        ]
    ),
)
def guarded_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("sightline_customer")
    table(spark, sf_dir, "nation").createOrReplaceTempView("sightline_nation")
    return sql.sql_guarded_batch(spark, STATEMENTS)[0]


@query("sql_longest_result", "SELECT c_custkey, c_name FROM customer")
def longest_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("sightline_customer")
    table(spark, sf_dir, "nation").createOrReplaceTempView("sightline_nation")
    return sql.sql_guarded_batch(spark, STATEMENTS)[1]


@query("sql_dump_load", "SELECT c_custkey, c_name, round(c_acctbal, 4) AS c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer")
def load_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump of two tables; the larger one is loaded."""
    path = scratch_path(spark, "dump")
    customer = table(spark, sf_dir, "customer")
    row = F.format_string(
        "(%d, '%s', %s, %s)",
        "c_custkey",
        "c_name",
        F.col("c_acctbal").cast("string"),
        F.coalesce(F.concat(F.lit("'"), F.expr("nullif(c_mktsegment, 'BUILDING')"), F.lit("'")), F.lit("NULL")),
    )
    blocks = customer.groupBy(F.floor(F.col("c_custkey") / BLOCK).alias("block")).agg(F.collect_list(row).alias("rows"))
    inserts = blocks.select(
        F.concat(
            F.lit("-- next block\nINSERT INTO customer (c_custkey, c_name, c_acctbal, c_mktsegment) VALUES\n"),
            F.array_join("rows", ",\n"),
            F.lit(";"),
        ).alias("value")
    )
    nation = table(spark, sf_dir, "nation").select(
        F.format_string("INSERT INTO nation VALUES (%d, '%s');", "n_nationkey", "n_name").alias("value")
    )
    created = spark.range(1).select(F.lit("CREATE TABLE customer (c_custkey INT, c_name TEXT, c_acctbal REAL, c_mktsegment TEXT);").alias("value"))
    created.unionByName(inserts).unionByName(nation).write.text(path)
    schema = "c_custkey long, c_name string, c_acctbal double, c_mktsegment string"
    return shown(sql.sql_dump_load(spark, path, schema=schema))


CANDIDATES = ["orders", "supplier", "customer", "nation", "events"]


@query(
    "pick_largest",
    "SELECT candidate, n_rows, n_rows = max(n_rows) OVER () AND position = min(CASE WHEN n_rows = m THEN position END) OVER () AS chosen FROM "
    "(SELECT *, max(n_rows) OVER () AS m FROM ("
    + union_sql([f"SELECT {i} AS position, '{t}' AS candidate, count(*) AS n_rows FROM {t}" for i, t in enumerate(CANDIDATES)])
    + "))",
)
def largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = {t: table(spark, sf_dir, t) for t in CANDIDATES}
    name, _ = sql.pick_largest(candidates)
    counts = sql.candidate_rows(candidates)
    return counts.select("candidate", "n_rows", (F.col("candidate") == F.lit(name)).alias("chosen"))


@query("title_row_skip", 'SELECT s_suppkey, s_name, round(s_acctbal, 4) AS s_acctbal FROM supplier')
def skip_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV with a line above the title line, which becomes the header."""
    path = scratch_path(spark, "title")
    names = ["report", "of", "suppliers"]
    rows = table(spark, sf_dir, "supplier").select(
        *[F.col(c).cast("string").alias(n) for c, n in zip(("s_suppkey", "s_name", "s_acctbal"), names)]
    )
    title = spark.range(1).select(F.lit("Supplier list").alias("report"), *[F.lit(None).cast("string").alias(n) for n in names[1:]])
    title.coalesce(1).unionByName(rows).write.option("header", True).csv(path)
    read = title_row_skip(spark, path)
    return shown(
        read.select(
            F.col("Supplier list").cast("long").alias("s_suppkey"),
            F.col("`Unnamed: 1`").alias("s_name"),
            F.col("`Unnamed: 2`").cast("double").alias("s_acctbal"),
        )
    )


@query(
    "drop_empty",
    "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, round(c_acctbal, 4) AS c_acctbal FROM customer WHERE customer.c_acctbal >= 0",
)
def without_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debtors' rows are blanked, one column holds NaN and one nothing."""
    kept = F.col("c_acctbal") >= 0
    rows = table(spark, sf_dir, "customer").select(
        F.when(kept, F.col("c_custkey")).alias("c_custkey"),
        F.when(kept, F.expr("nullif(c_mktsegment, 'BUILDING')")).alias("c_mktsegment"),
        F.when(kept, F.col("c_acctbal")).otherwise(F.lit(float("nan"))).alias("c_acctbal"),
        F.lit(float("nan")).alias("not_a_number"),
        F.lit(None).cast("string").alias("nothing"),
    )
    return shown(cleaning.drop_empty(rows))


@query("trim_strings", "SELECT c_custkey, c_name || ' x' AS c_name, c_mktsegment FROM customer")
def trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(F.lit(" \t"), "c_name", F.lit(" x\n ")).alias("c_name"),
        F.concat("c_mktsegment", F.lit("\u000b\r\n")).alias("c_mktsegment"),
    )
    return cleaning.trim_strings(rows)


@query(
    "parse_dates",
    """SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS order_date,
      CASE WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'unknown' END AS note_date,
      CAST(year(o_orderdate) AS BIGINT) AS order_year FROM orders""",
)
def dates_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four layouts and a text in one column; a column with too few dates stays text."""
    d, p = F.col("o_orderdate"), F.col("o_orderpriority")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(p == "1-URGENT", F.date_format(d, "d-MMM-yy"))
        .when(p == "2-HIGH", F.date_format(d, "MMMM d, yyyy"))
        .when(p == "3-MEDIUM", F.date_format(d, "yyyy/MM/dd"))
        .when(p == "5-LOW", F.lit("to be agreed"))
        .otherwise(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"))
        .alias("order_date"),
        F.when(p == "1-URGENT", F.date_format(d, "yyyy-MM-dd")).otherwise("unknown").alias("note_date"),
        F.year(d).alias("order_year"),
    )
    return shown(cleaning.parse_dates(rows))


@query(
    "promote_numeric",
    """SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' OR o_orderstatus = 'F' THEN round(o_totalprice, 2) END AS price,
      round(o_orderkey / 4.0::DOUBLE, 2) AS share, CASE WHEN o_orderpriority = '1-URGENT' THEN '12' ELSE '1d' END AS lead FROM orders""",
)
def numbers_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices with marks and a few words, percentages, and a text that only looks numeric."""
    amount = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    words = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") != "F")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(words, "on request").otherwise(amount).alias("price"),
        F.concat((F.col("o_orderkey") / 4.0).cast("string"), F.lit(" %")).alias("share"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "12").otherwise("1d").alias("lead"),
    )
    return shown(cleaning.promote_numeric(rows), 2)


@query(
    "sample_cap",
    """SELECT 'sampled' AS kind, least(count(*), 500) AS n_rows, least(count(*), 500) AS n_keys FROM orders
    UNION ALL SELECT 'whole', count(*), count(*) FROM orders""",
)
def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly 500 different orders, and all of them below the limit."""
    orders = table(spark, sf_dir, "orders")
    out = None
    for kind, rows in (
        ("sampled", records.sample_cap(orders, ["o_orderkey"], 500)),
        ("whole", records.sample_cap(orders, ["o_orderkey"], 500, limit=10**12)),
    ):
        one = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_orderkey").alias("n_keys"))
        one = one.withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "records_sink",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, event_type,
      CASE WHEN event_type NOT IN ('click', 'view') THEN round(value, 4) END AS value FROM events""",
)
def sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infinity and NaN become null; written as JSON and read back."""
    odd = F.when(F.col("event_type") == "click", F.lit(float("inf"))).when(
        F.col("event_type") == "view", F.lit(float("nan"))
    )
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", odd.otherwise(F.col("value")).alias("value"))
    path = scratch_path(spark, "records")
    records.records_sink(events, path)
    return shown(spark.read.schema(records.to_records(events).schema).json(path))


@query(
    "csv_multiline",
    "SELECT c_custkey, 'first' || chr(10) || 'second; \"' || c_mktsegment || '\"' AS note, round(c_acctbal, 4) AS c_acctbal FROM customer",
)
def read_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted line breaks, delimiters and quotes, with another delimiter."""
    path = scratch_path(spark, "multiline")
    note = F.concat(F.lit('first\nsecond; "'), "c_mktsegment", F.lit('"'))
    rows = table(spark, sf_dir, "customer").select("c_custkey", note.alias("note"), "c_acctbal")
    rows.write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    return shown(csv_source(spark, path, sep=";"))


@query(
    "csv_bad_lines",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 <> 1 THEN c_name END AS c_name, (SELECT count(*) FROM customer WHERE c_custkey % 5 = 0) AS n_skipped
      FROM customer WHERE c_custkey % 5 <> 0""",
)
def read_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth line has a cell too many, another fifth one too few."""
    path, notes = scratch_path(spark, "ragged"), []
    key = F.col("c_custkey")
    line = F.when(key % 5 == 0, F.concat(key, F.lit(","), "c_name", F.lit(",surplus"))).when(key % 5 == 1, key.cast("string"))
    lines = table(spark, sf_dir, "customer").select(line.otherwise(F.concat(key, F.lit(","), "c_name")).alias("value"))
    lines.write.text(path)
    read = csv_source(spark, path, warnings=notes, schema="c_custkey long, c_name string", header=False)
    return read.withColumn("n_skipped", F.lit(int(notes[0].split()[1]) if notes else 0).cast("long"))


@query(
    "json_mixed_roots",
    "SELECT c_custkey, CASE WHEN floor(c_custkey / 100) % 4 <> 3 THEN c_name END AS c_name FROM customer",
)
def read_mixed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all four shapes, and one that is no JSON, in one folder."""
    customer = table(spark, sf_dir, "customer").withColumn("block", F.floor(F.col("c_custkey") / BLOCK))
    blocks = customer.groupBy("block").agg(F.collect_list(F.struct("c_custkey", "c_name")).alias("rows"))
    shape = F.col("block") % 4
    doc = (
        F.when(shape == 0, F.to_json("rows"))
        .when(shape == 1, F.to_json(F.struct("rows", F.col("block").alias("page"))))
        .when(shape == 2, F.to_json(F.map_from_entries(F.transform("rows", lambda r: F.struct(r["c_name"], r)))))
        .otherwise(F.to_json(F.transform("rows", lambda r: r["c_custkey"])))
    )
    path = scratch_path(spark, "mixed")
    blocks.select(doc.alias("value")).unionByName(spark.range(1).select(F.lit("{no json").alias("value"))).write.text(path)
    rows = json_source(spark, path, whole_file=False)
    value = F.col("value").cast("long") if "value" in rows.columns else F.lit(None).cast("long")
    return rows.select(F.coalesce("c_custkey", value).alias("c_custkey"), "c_name")


@query(
    "sql_dump_quoted",
    """SELECT c_custkey, 'it''s (' || c_mktsegment || '); "x", ' || c_name AS note, CASE WHEN c_custkey % 3 = 0 THEN 'NULL' WHEN c_custkey % 3 = 1 THEN c_name END AS c_name
      FROM customer""",
)
def load_quoted_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted semicolons, parentheses, quotes and the word NULL; column lists in different orders."""
    key, name = F.col("c_custkey"), F.concat(F.lit("'"), "c_name", F.lit("'"))
    note = F.concat(F.lit("'it''s ("), "c_mktsegment", F.lit('); "x", '), "c_name", F.lit("'"))
    text = F.when(key % 3 == 0, F.lit("'NULL'")).when(key % 3 == 1, name).otherwise("NULL")
    one = F.concat(F.lit("INSERT INTO customer (c_custkey, note, c_name) VALUES ("), key, F.lit(", "), note, F.lit(", "), text, F.lit(");"))
    other = F.concat(F.lit("insert into customer (c_name, c_custkey, note)\nvalues ("), text, F.lit(", "), key, F.lit(", "), note, F.lit("); -- ';"))
    path = scratch_path(spark, "quoted")
    table(spark, sf_dir, "customer").select(F.when(key % 2 == 0, one).otherwise(other).alias("value")).write.text(path)
    return sql.sql_dump_load(spark, path, schema="c_custkey long, note string, c_name string")


@query("title_row_types", "SELECT s_suppkey, s_name, round(s_acctbal, 4) AS s_acctbal FROM supplier UNION ALL SELECT NULL, 'Supplier', NULL FROM supplier")
def typed_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types are inferred below the title, and rows that read like the header are kept."""
    path = scratch_path(spark, "titles")
    names = ["a", "b", "c"]
    supplier = table(spark, sf_dir, "supplier")
    cells = (F.col("s_suppkey").cast("string"), F.col("s_name"), F.col("s_acctbal").cast("string"))
    rows = supplier.select(*[c.alias(n) for c, n in zip(cells, names)])
    like = spark.range(1).select(F.lit(None).cast("string").alias("a"), F.lit("Supplier").alias("b"), F.lit(None).cast("string").alias("c"))
    repeated = supplier.select(*[c.alias(n) for c, n in zip((F.lit(None).cast("string"), F.lit("Supplier"), F.lit(None).cast("string")), names)])
    like.coalesce(1).unionByName(repeated).unionByName(rows).coalesce(1).write.option("header", True).csv(path)
    read = title_row_skip(spark, path)
    return shown(read.select(F.col("`Unnamed: 0`").alias("s_suppkey"), F.col("Supplier").alias("s_name"), F.col("`Unnamed: 2`").alias("s_acctbal")))


def first_in_file() -> Column:
    """Whether a row is the first of its partition, thus of the file written from it."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0


@query(
    "sql_dump_backslash",
    union_sql(
        [
            "SELECT 'standard' AS dialect, c_custkey, 'C:' || chr(92) || c_name || '''s' || chr(92) AS path FROM customer",
            "SELECT 'mysql' AS dialect, c_custkey, 'C:' || chr(92) || c_name || '''s' || chr(10) AS path FROM customer",
        ]
    ),
)
def load_backslashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backslash is plain text in one dialect and escapes the next character in the other."""
    customer, out, back = table(spark, sf_dir, "customer"), None, chr(92)
    for dialect, before, after in (("standard", f"'C:{back}", f"''s{back}'"), ("mysql", f"'C:{back}{back}", f"{back}'s{back}n'")):
        path = scratch_path(spark, "backslash")
        line = F.concat(F.lit("INSERT INTO files VALUES ("), "c_custkey", F.lit(", " + before), "c_name", F.lit(after + ");"))
        customer.select(line.alias("value")).write.text(path)
        rows = sql.sql_dump_load(spark, path, schema="c_custkey long, path string", dialect=dialect)
        one = rows.select(F.lit(dialect).alias("dialect"), "c_custkey", "path")
        out = one if out is None else out.unionByName(one)
    return out


@query("sql_dump_one_statement", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, 'line' || chr(10) || '(' || l_returnflag || ');' AS note FROM lineitem")
def load_one_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file is a single INSERT over many lines, with values that run over line ends."""
    path = scratch_path(spark, "statement")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", first_in_file().alias("first"))
    begin = F.when(F.col("first"), F.lit("INSERT INTO lines (l_orderkey, l_linenumber, note) VALUES" + chr(10))).otherwise(F.lit(","))
    cells = F.concat(F.lit("("), "l_orderkey", F.lit(", "), "l_linenumber", F.lit(", 'line" + chr(10) + "("), "l_returnflag", F.lit(");')"))
    lines.select(F.concat(begin, cells).alias("value")).write.text(path)
    return sql.sql_dump_load(spark, path, schema="l_orderkey long, l_linenumber long, note string")


@query(
    "duplicate_rows_events",
    "SELECT sum(n - 1)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM (SELECT event_type, date_trunc('day', ts) + to_microseconds(event_id % 7) AS moment FROM events) GROUP BY event_type, moment)",
)
def near_equal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments that differ by microseconds are different."""
    moment = F.timestamp_add("MICROSECOND", F.col("event_id") % 7, F.date_trunc("day", "ts")).cast("timestamp_ntz")
    return profile.duplicate_rows(table(spark, sf_dir, "events").select("event_type", moment.alias("moment")))
