"""Guarded statement lists, rows of SQL dumps, and the largest of several tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.errors import (
    AnalysisException, ArithmeticException, DateTimeException, IllegalArgumentException, NumberFormatException, ParseException,
    SparkRuntimeException,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.sources.dump import dump_rows, dump_runs

# A statement holding one of these is never run.
FORBIDDEN = (
    "DROP ", "DELETE ", "TRUNCATE ", "UPDATE ", "ALTER ", "SQLITE_MASTER", "SQLITE_TEMP_MASTER",
)
SKIP_WARNING = "Skipped potentially dangerous statement or system table reference"
# End of fixed values.


def bare(statement: str) -> str:
    """A statement without comments."""
    text = re.sub(r"(?m)--.*$", "", statement)
    return re.sub(r"(?s)/\*.*?\*/", "", text).strip()


def status_of(statement: str) -> str:
    upper = bare(statement).upper()
    if any(word in upper for word in FORBIDDEN):
        return "blocked"
    return "query" if upper.startswith("SELECT ") else "ignored"


def sql_guarded_batch(
    spark: SparkSession, statements: Sequence[str], warnings: list[str] | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Run the SELECTs of a statement list over the session's views.

    Returns one row per statement (no, status, rows) and the longest result.
    Failing statements are recorded and passed over.
    """
    log, results = [], {}
    for no, statement in enumerate(statements):
        status, rows = status_of(statement), None
        if status == "blocked" and warnings is not None:
            warnings.append(SKIP_WARNING)
        if status == "query":
            try:
                result = spark.sql(bare(statement))
                rows = result.count()
                results[no] = (rows, result)
            except (AnalysisException, ParseException, ArithmeticException, NumberFormatException, IllegalArgumentException, DateTimeException, SparkRuntimeException):
                status = "failed"
        log.append({"statement_no": no, "status": status, "n_rows": -1 if rows is None else rows})
    table = spark.createDataFrame(pa.Table.from_pylist(log, pa.schema(
        [("statement_no", pa.int64()), ("status", pa.string()), ("n_rows", pa.int64())]
    )))
    if not results:
        return table, None
    longest = min(results, key=lambda no: (-results[no][0], no))
    return table, results[longest][1]


def candidate_rows(candidates: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each candidate table, counted in one job."""
    counts = None
    for i, (name, df) in enumerate(candidates.items()):
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(i).alias("position"), F.lit(name).alias("candidate"), "n_rows"
        )
        counts = one if counts is None else counts.unionByName(one)
    return counts


def pick_largest(candidates: Mapping[str, DataFrame]) -> tuple[str, DataFrame]:
    """The candidate with most rows, the first one among equals."""
    best = candidate_rows(candidates).orderBy(F.desc("n_rows"), "position").first()
    return best["candidate"], candidates[best["candidate"]]


def dump_leftovers(spark: SparkSession, path: str, dialect: str = "standard") -> DataFrame:
    """Number of statements that are neither complete INSERTs nor known others."""
    return dump_rows(spark, path, dialect).agg(F.count("rest").alias("unsupported"))


def sql_dump_load(
    spark: SparkSession, path: str, table: str | None = None, schema: str | None = None, warnings: list[str] | None = None, dialect: str = "standard"
) -> DataFrame:
    """Rows of one table of a dump; without a name, of the table with most rows.

    By default a backslash in a quoted value is plain text; ``dialect="mysql"`` takes it as an escape.

    Each statement's values go by its own column list; columns it doesn't list are
    null. Statements that cannot be read are counted in a warning.
    """
    rows = dump_runs(spark, path, dialect)
    left = rows.where("rest is not null").count()
    if left and warnings is not None:
        warnings.append(f"Skipped {left} statements that could not be read")
    rows = rows.where("rest is null")
    if table is None:
        sizes = rows.groupBy("table_name").agg(F.sum("n").alias("n"))
        best = sizes.orderBy(F.desc("n"), "table_name").first()
        if best is None:
            raise ValueError("SQL produced no data rows")
        table = best["table_name"]
    chosen = rows.where(F.col("table_name") == table)
    if schema is None:
        # Lists of column names: as many as the dump has different ones.
        lists = chosen.groupBy("names").agg(F.sum("n").alias("n"), F.max("width").alias("width"))
        lists = lists.orderBy(F.desc("n"), "names").collect()
        names = list(dict.fromkeys(n for r in lists for n in (r["names"] or [f"c{i}" for i in range(r["width"])])))
        schema = ", ".join(f"`{n}` string" for n in names)
    fields = T.StructType.fromDDL(schema).fields
    # Without any list, values go by position.
    places = F.transform(F.coalesce("names", F.array(*[F.lit(f.name) for f in fields])), F.lower)
    at = [F.when(F.array_contains(places, f.name.lower()), (F.array_position(places, f.name.lower()) - 1).cast("int")).alias(f"at{i}") for i, f in enumerate(fields)]
    tuples = chosen.select(*at, F.explode("tuples").alias("cells"))
    return tuples.select(*[F.get("cells", F.col(f"at{i}")).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])
