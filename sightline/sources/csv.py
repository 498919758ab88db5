"""Delimited text files with a header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.types import quoted
from sightline.sources.quoted import quoting_of, records, survey

FALLBACK_WARNING = "Failed to read with detected encoding. Fell back to latin-1."
TITLE_WARNING = "Skipped first row (detected as title)"
BAD_LINES_WARNING = "Skipped {} bad lines with more cells than columns"
SURPLUS = "_surplus_cell"
NO_NULL = "\u0001\u0002"


def _options(encoding: str, options: dict) -> dict:
    return {"header": True, "encoding": encoding, "mode": "PERMISSIVE", "quote": '"', "escape": '"', **options}


def csv_source(
    spark: SparkSession, path: str, encoding: str = "UTF-8", warnings: list[str] | None = None, schema=None, **options
) -> DataFrame:
    """Read CSV with a header; undecodable text is re-read as latin-1, lines with surplus cells are skipped and counted.

    Shorter lines are filled with nulls. ``options`` go to the reader (``sep`` and
    so on). Quoted line breaks are read as they are meant: a first scan finds out
    whether there are any, and if so, records are cut in parallel with the quotes of
    all splits taken into account; large files are read in splits either way. A
    second scan infers types and counts bad lines; a ``schema`` spares the inference.
    Options that move line ends (``lineSep``, ``comment``, ``multiLine``), encodings that are
    not ASCII byte for byte and delimiters of several characters leave all of that to the reader.
    """
    settings = _options(encoding, options)
    quoting = quoting_of(settings, encoding)
    if quoting is None:
        settings = {"multiLine": True, **settings}
        if _undecodable(spark, path, encoding):
            settings = _latin1(settings, warnings)
        return _read(spark, path, settings, schema, warnings, None)
    odd, over, opened = survey(spark, path, quoting)
    if odd and encoding.upper() in ("UTF-8", "UTF8"):
        settings = _latin1(settings, warnings)
    return _read(spark, path, settings, schema, warnings, records(spark, path, quoting, opened) if over else None)


def _latin1(settings: dict, warnings: list[str] | None) -> dict:
    if warnings is not None:
        warnings.append(FALLBACK_WARNING)
    return {**settings, "encoding": "ISO-8859-1"}


def _decoded(record: Column, encoding: str) -> Column:
    return record.cast("string") if encoding.upper() in ("UTF-8", "UTF8", "US-ASCII") else F.decode(record, encoding)


def _cells(cut: DataFrame, settings: dict, schema: T.StructType) -> DataFrame:
    """The cells of cut records as columns."""
    if str(settings["header"]).lower() == "true":
        cut = cut.where("place > 0")
    spared = ("header", "encoding", "inferSchema", "enforceSchema")
    parse = {k: str(v) for k, v in settings.items() if k not in spared} | {"multiLine": "true"}
    ddl = ", ".join(f"{quoted_name(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    return cut.select(F.from_csv(_decoded(F.col("record"), settings["encoding"]), ddl, parse).alias("cells")).select("cells.*")


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _read(spark: SparkSession, path: str, settings: dict, schema, warnings: list[str] | None, cut: DataFrame | None) -> DataFrame:
    def rows(kind: T.StructType, **more) -> DataFrame:
        if cut is not None:
            return _cells(cut, {**settings, **more}, kind)
        return spark.read.options(**settings).options(**more).schema(kind).csv(path)

    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    # the header alone is read here
    names = [f.name for f in schema.fields] if schema else spark.read.options(**settings, **({"multiLine": True} if cut is not None else {})).csv(path).columns
    if not names:
        raise ValueError("File is empty")
    width = len(names)
    texts = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width + 1)])
    raw, surplus = rows(texts), F.col(f"c{width}").isNotNull()
    bad = F.count_if(surplus).alias("bad")
    if schema is not None:
        # The extreme keeps a data column in the plan, else the reader would parse no cells.
        n_bad, found = raw.agg(bad, F.max("c0")).first()["bad"], rows(schema)
        if n_bad:
            wide = T.StructType([*schema.fields, T.StructField(SURPLUS, T.StringType())])
            found = rows(wide).where(F.col(SURPLUS).isNull()).drop(SURPLUS)
    else:
        kinds = [F.bit_or(F.when(~surplus, _kind(F.col(f"c{i}")))).alias(f"k{i}") for i in range(width)]
        seen = raw.agg(bad, F.max("c0"), *kinds).first()
        n_bad = seen["bad"]
        kept = raw.where(~surplus) if n_bad else raw
        typed = [_typed(F.col(f"c{i}"), seen[f"k{i}"] or 0).alias(name) for i, name in enumerate(names)]
        found = kept.select(*typed)
    if n_bad and warnings is not None:
        warnings.append(BAD_LINES_WARNING.format(n_bad))
    return found


# What a cell can be, as bits, from narrow to wide; a column gets the narrowest type that holds all its cells.
INT, BIGINT, DOUBLE, DATE, TIMESTAMP, BOOLEAN, TEXT = (1 << i for i in range(7))
TYPES = {
    INT: "int", INT | BIGINT: "bigint", BIGINT: "bigint", DATE: "date", DATE | TIMESTAMP: "timestamp", TIMESTAMP: "timestamp", BOOLEAN: "boolean",
}


def _kind(cell: Column) -> Column:
    whole = cell.rlike(r"^\s*[+-]?\d+\s*$")
    number = cell.rlike(r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|Infinity|NaN)\s*$")
    day = r"^\d{4}-\d{1,2}-\d{1,2}"
    return (
        F.when(cell.isNull() | (cell == ""), 0)
        .when(whole & cell.try_cast("int").isNotNull(), INT)
        .when(whole & cell.try_cast("bigint").isNotNull(), BIGINT)
        .when(number, DOUBLE)
        .when(cell.rlike(day + "$") & cell.try_cast("date").isNotNull(), DATE)
        .when(cell.rlike(day + "[ T]") & cell.try_cast("timestamp").isNotNull(), TIMESTAMP)
        .when(cell.rlike("^(?i)(true|false)$"), BOOLEAN)
        .otherwise(TEXT)
    )


def _typed(cell: Column, kinds: int) -> Column:
    number = kinds and not kinds & ~(INT | BIGINT | DOUBLE)
    name = TYPES.get(kinds, "double" if number else None)
    return cell.try_cast(name) if name else cell


def _undecodable(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether any line holds bytes that the encoding cannot express."""
    if encoding.upper() not in ("UTF-8", "UTF8"):
        return False
    lines = spark.read.text(path)
    return not lines.where(~F.is_valid_utf8("value")).isEmpty()


def inferred(rows: DataFrame) -> DataFrame:
    """Text columns with the narrowest of the types bigint, double, boolean and timestamp that all their values have."""
    kinds = ("bigint", "double", "boolean", "timestamp")
    texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return rows
    seen = rows.agg(
        *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(texts)],
        *[F.count(quoted(c).try_cast(k)).alias(f"{k}{i}") for i, c in enumerate(texts) for k in kinds],
    ).first()
    types = {c: next((k for k in kinds if seen[f"n{i}"] and seen[f"{k}{i}"] == seen[f"n{i}"]), None) for i, c in enumerate(texts)}
    return rows.select(*[(quoted(c).cast(types[c]) if types.get(c) else quoted(c)).alias(c) for c in rows.columns])


def title_row_skip(
    spark: SparkSession, path: str, encoding: str = "UTF-8", warnings: list[str] | None = None, **options
) -> DataFrame:
    """Read CSV whose header may sit one line below a title.

    A first data row with a single value in a table of several columns means that
    the line taken for the header was not one: the row after it is the header. That
    is decided for each file by its first two records; all other records are data
    whatever they look like. Columns are named by the first file's header and go by place.
    """
    settings = _options(encoding, options)
    quoting = quoting_of(settings, encoding)
    if quoting is None:
        raise ValueError("title rows need an encoding that is ASCII byte for byte, single delimiters and the usual line ends")
    odd, _, opened = survey(spark, path, quoting)
    if odd and encoding.upper() in ("UTF-8", "UTF8"):
        settings = _latin1(settings, warnings)
    cut = records(spark, path, quoting, opened).withColumn("record", _decoded(F.col("record"), settings["encoding"]))
    parse = {k: str(v) for k, v in settings.items() if k in ("sep", "delimiter", "quote", "escape")} | {"multiLine": "true", "emptyValue": ""}
    # The first two records of each file: two rows a file, of which the first file's come to the driver.
    tops = cut.where("place < 2").groupBy("file").agg(
        F.max(F.when(F.col("place") == 0, F.col("record"))).alias("first"), F.max(F.when(F.col("place") == 1, F.col("record"))).alias("second")
    )
    top = tops.orderBy("file").first()
    if top is None:
        raise ValueError("File is empty")
    width = _width(spark, [x for x in (top["first"], top["second"]) if x is not None], parse)
    texts = ", ".join(f"c{i} string" for i in range(width + 1))
    filled = F.aggregate(F.array(*[F.when(F.from_csv("second", texts, parse).getField(f"c{i}").isNotNull(), 1).otherwise(0) for i in range(width)]), F.lit(0), lambda a, b: a + b)
    titled = F.coalesce((filled == 1) & F.lit(width > 1), F.lit(False))
    tops = tops.withColumn("titled", titled)
    named = tops.orderBy("file").select(F.when(F.col("titled"), F.col("second")).otherwise(F.col("first")).alias("header"), "titled").first()
    cells = spark.range(1).select(F.from_csv(F.lit(named["header"]), texts, parse).alias("c")).first()["c"]
    n_titled = tops.where("titled").count()
    if n_titled and warnings is not None:
        warnings.append(TITLE_WARNING)
    names = _safe([cells[f"c{i}"] for i in range(width)], "Unnamed: {}" if named["titled"] else "_c{}")
    body = cut.where("place = 2").select("record").unionByName(tops.where("not titled and second is not null").select(F.col("second").alias("record")))
    raw = body.select(F.from_csv("record", texts, parse).alias("c")).select("c.*")
    surplus = F.col(f"c{width}").isNotNull()
    n_bad = raw.where(surplus).count()
    if n_bad and warnings is not None:
        warnings.append(BAD_LINES_WARNING.format(n_bad))
    return inferred(raw.where(~surplus).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)]))


def _width(spark: SparkSession, lines: list[str], parse: dict) -> int:
    """Cells of the first line, or of the second if that has more and both are known."""
    most = max(line.count(parse.get("sep", parse.get("delimiter", ","))) for line in lines) + 1
    ddl = ", ".join(f"c{i} string" for i in range(most))
    marked = {**parse, "nullValue": NO_NULL}
    found = spark.createDataFrame([(line,) for line in lines], "line string").select(F.from_csv("line", ddl, marked).alias("c")).collect()
    sizes = [max((i + 1 for i, v in enumerate(r["c"]) if v is not None), default=1) for r in found]
    return max(sizes)


def _safe(names: list[str | None], unnamed: str) -> list[str]:
    """Names for all columns; repeated ones get their place."""
    known = [n if n else unnamed.format(i) for i, n in enumerate(names)]
    lower = [n.lower() for n in known]
    return [n if lower.count(n.lower()) == 1 else f"{n}{i}" for i, n in enumerate(known)]
