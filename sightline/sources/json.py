"""JSON documents of four root shapes, and flattening of nested columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.types import quoted
from sightline.sources.cleaning import NUMBER


CORRUPT = "_corrupt_record"
# Parts of a variant schema: quoted names, plain names, and the types that a table writes otherwise.
_PART = re.compile(r"(?P<name>`(?:[^`]|``)*`|\w+(?=\s*:))|OBJECT<|\bVOID\b|\bVARIANT\b|\bDECIMAL\(\d+,\s*(?P<scale>\d+)\)")


def _struct_of(schema: str) -> str:
    """The DDL type of a variant schema: nothing known and mixed kinds are texts, broken numbers doubles."""

    def usual(m: re.Match) -> str:
        if m["name"]:
            return m[0] if m[0].startswith("`") else f"`{m[0]}`"
        if m["scale"]:
            return m[0] if m["scale"] == "0" else "DOUBLE"
        return "STRUCT<" if m[0] == "OBJECT<" else "STRING"

    return _PART.sub(usual, schema)


def _table(lines: DataFrame) -> DataFrame:
    """One JSON text per row to a table whose schema covers every row; what is no object goes to a column of its own."""
    whole = F.startswith(F.ltrim("value"), F.lit("{"))
    seen = lines.agg(F.schema_of_variant_agg(F.when(whole, F.try_parse_json("value"))).alias("schema"), F.count_if(~whole).alias("others")).first()
    others = [F.when(~whole, F.col("value")).alias(CORRUPT)] if seen["others"] else []
    if seen["schema"] is None or not seen["schema"].startswith("OBJECT<") or seen["schema"] == "OBJECT<>":
        return lines.select(*others)
    row = F.from_json(F.when(whole, F.col("value")), _struct_of(seen["schema"])).alias("row")
    return lines.select(*others, row).select(*[c for c in (CORRUPT,) if others], "row.*")


def json_source(
    spark: SparkSession, path: str, whole_file: bool = True, warnings: list[str] | None = None
) -> DataFrame:
    """Read JSON documents: one per file, or one per line with ``whole_file=False``.

    Each document has one of four shapes: a list of objects; an object with exactly
    one list, whose elements are objects; another object, each key being a row; a
    list with plain values, which become column ``value``. Documents of different
    shapes give the rows of all. What is no JSON is left out and counted in a warning.
    """
    notes = warnings if warnings is not None else []
    docs = spark.read.text(path, wholetext=whole_file).where(F.trim("value") != "")
    is_list = F.regexp_extract("value", r"^\s*(.)", 1) == "["
    read = docs.select(
        "value",
        F.when(is_list, F.from_json("value", "array<string>")).alias("items"),
        F.when(~is_list, F.from_json("value", "map<string,string>")).alias("cells"),
    )
    listed = F.map_filter("cells", lambda _, v: F.startswith(v, F.lit("[")))
    inner = F.from_json(F.get(F.map_values(listed), F.lit(0)), "array<string>")
    objects = lambda a: F.forall(a, lambda x: F.startswith(x, F.lit("{")))
    one_list = (F.size(listed) == 1) & objects(inner)
    shaped = read.select(
        F.when(F.col("cells").isNotNull() & one_list, F.get(F.map_keys(listed), F.lit(0))).alias("root"),
        F.when(F.col("items").isNotNull(), F.col("items")).when(one_list, inner).otherwise(F.map_values("cells")).alias("rows"),
        F.coalesce(~objects("items"), F.lit(False)).alias("plain"),
    )
    seen = shaped.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("rows").isNull()).alias("unread"),
        F.coalesce(F.bool_or("plain"), F.lit(False)).alias("plain"),
        F.coalesce(F.bool_or(~F.col("plain") & F.col("rows").isNotNull()), F.lit(False)).alias("objects"),
    ).first()
    if not seen["n"]:
        raise ValueError("File is empty")
    if seen["unread"]:
        notes.append(f"Skipped {seen['unread']} documents that are no JSON.")
    for r in shaped.where("root is not null").select("root").distinct().limit(10).collect():
        notes.append(f"Used object key '{r['root']}' as root array.")
    plain = shaped.where("plain").select(F.explode("rows").alias("value"))
    if not seen["objects"]:
        return plain
    table = _table(shaped.where(~F.col("plain")).select(F.explode("rows").alias("value")))
    return table.unionByName(plain, allowMissingColumns=True) if seen["plain"] else table


def _struct_fields(dtype: T.StructType, prefix: str, name: str) -> list[tuple[str, str]]:
    found = []
    for f in dtype.fields:
        if isinstance(f.dataType, T.StructType):
            found += _struct_fields(f.dataType, f"{prefix}.`{f.name}`", f"{name}.{f.name}")
        else:
            found.append((f"{prefix}.`{f.name}`", f"{name}.{f.name}"))
    return found


def _text_fields(df: DataFrame, column: str, max_fields: int | None) -> list[tuple[str, str]]:
    """Keys of a JSON text column over all rows, each with the narrowest type that fits.

    The keys become columns, so there are as many as the result is wide.
    """
    keys = df.select(F.explode(F.json_object_keys(quoted(column))).alias("k")).distinct()
    names = sorted(r["k"] for r in (keys if max_fields is None else keys.limit(max_fields + 1)).collect())
    if not names or (max_fields is not None and len(names) > max_fields):
        return [(n, "string") for n in names]
    parsed = F.from_json(quoted(column), "map<string,string>")
    cells = df.select(parsed.alias("m"))
    checks = []
    for i, n in enumerate(names):
        v = F.col("m")[n]
        checks += [
            F.count(v).alias(f"n{i}"),
            F.count(v.try_cast("bigint")).alias(f"i{i}"),
            F.count_if(v.rlike(NUMBER)).alias(f"d{i}"),
        ]
    seen = cells.agg(*checks).first()
    out = []
    for i, n in enumerate(names):
        if seen[f"n{i}"] and seen[f"i{i}"] == seen[f"n{i}"] == seen[f"d{i}"]:
            out.append((n, "bigint"))
        elif seen[f"n{i}"] and seen[f"d{i}"] == seen[f"n{i}"]:
            out.append((n, "double"))
        else:
            out.append((n, "string"))
    return out


def json_flatten(
    df: DataFrame,
    json_columns: Sequence[str] = (),
    warnings: list[str] | None = None,
    max_columns: int | None = None,
    max_fields: int | None = None,
) -> DataFrame:
    """Expand nested columns to ``<column>_<field>``; lists and maps are dropped with a warning.

    ``json_columns`` names string columns that hold JSON objects. With limits, only
    nested columns among the first ``max_columns`` are expanded, and those with more
    than ``max_fields`` fields are dropped with a warning.
    """
    notes = warnings if warnings is not None else []
    kept, added = [], []
    for i, f in enumerate(df.schema.fields):
        nested = isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) or f.name in json_columns
        if (max_columns is not None and i >= max_columns) or not nested:
            kept.append(quoted(f.name))
            continue
        if f.name in json_columns:
            fields = _text_fields(df, f.name, max_fields)
            struct = "struct<" + ",".join(f"`{n}`:{t}" for n, t in fields) + ">"
            parsed = F.from_json(quoted(f.name), struct)
            columns = [parsed.getField(n).alias(f"{f.name}_{n}") for n, _ in fields]
        elif isinstance(f.dataType, T.StructType):
            fields = _struct_fields(f.dataType, f"`{f.name}`", "")
            columns = [F.col(path).alias(f"{f.name}_{name[1:]}") for path, name in fields]
        else:
            notes.append(f"Skipped un-flattenable column '{f.name}'")
            continue
        if max_fields is not None and len(columns) > max_fields:
            notes.append(f"Dropped deeply nested column '{f.name}' (>{len(columns)} sub-fields)")
            continue
        added += columns
        notes.append(f"Flattened nested column '{f.name}'")
    return df.select(*kept, *added)
