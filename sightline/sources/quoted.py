"""Records of delimited text whose quoted cells may hold line breaks, cut in parallel."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.sources.split_text import in_order, located, stretches

#: Encodings in which every ASCII byte is that ASCII character, so that bytes tell where lines and cells end.
BYTEWISE = re.compile(r"(?i)utf-?8|us-ascii|(iso-8859|latin-?|windows-125)[-\d]*")


class Quoting:
    """How a line leaves the reader: inside a quoted cell or not.

    A cell is quoted if it begins with the quote. In it, the escape character in front
    of a quote (or the quote doubled, if it is its own escape) stands for a quote. What
    follows the closing quote up to the delimiter belongs to the cell.
    """

    def __init__(self, sep: str, quote: str, escape: str, encoding: str):
        s, q, e = (re.escape(x.encode(encoding)) for x in (sep, quote, escape))
        inner = rb"(?:[^%b]++|%b%b)*+" % (q, q, q) if e == q else rb"(?:[^%b%b]++|%b[%b%b]?+)*+" % (q, e, e, q, e)
        cell = rb"(?:%b%b%b[^%b]*+|(?!%b)[^%b]*+)" % (q, inner, q, s, q, s)
        rest = rb"(?:%b%b)*+\Z" % (s, cell)
        self.quote = quote.encode(encoding)
        self._outside = re.compile(cell + rest, re.S).match
        self._inside = re.compile(rb"%b%b[^%b]*+%b" % (inner, q, s, rest), re.S).match

    def open_after(self, line: bytes, inside: bool) -> bool:
        """Whether a quoted cell is open behind the line."""
        if self.quote not in line:
            return inside
        return (self._inside if inside else self._outside)(line) is None


def quoting_of(options: dict, encoding: str) -> Quoting | None:
    """The reader's options as a ``Quoting``, or None where lines have to be left to the reader."""
    sep = str(options.get("sep", options.get("delimiter", ",")))
    plain = all(len(str(x)) == 1 for x in (sep, options["quote"], options["escape"]))
    if not plain or not BYTEWISE.fullmatch(encoding) or {"lineSep", "comment", "multiLine"} & set(options):
        return None
    return Quoting(sep, options["quote"], options["escape"], encoding)


def survey(spark: SparkSession, path: str, quoting: Quoting) -> tuple[int, int, dict]:
    """One scan: lines that are no UTF-8, cells that run over a line's end, and the splits that begin inside a cell.

    The last is {(file, start): split in which the record began}. Only lines with
    a quote or with bytes that are no UTF-8 leave the JVM.
    """
    lines = located(spark, path).withColumn("odd", ~F.is_valid_utf8(F.col("line").cast("string")))
    told = lines.where(F.col("odd") | F.contains(F.col("line"), F.lit(quoting.quote)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for file, start, rows in stretches(batches):
            # open after the split if it began outside or inside a cell; whether a record ended that began before; runs over; odd lines
            now = found.setdefault((file, start), [False, True, False, 0, 0])
            for line, odd in zip(rows.column(0).to_pylist(), rows.column(3).to_pylist()):
                now[4] += odd
                same = now[0] == now[1]
                now[0] = quoting.open_after(line, now[0])
                now[1] = now[0] if same else quoting.open_after(line, now[1])
                now[2] |= not now[1]
                now[3] += now[0]
        columns = list(zip(*[(*k, *v) for k, v in found.items()])) or [()] * 7
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
        names = ["file", "start", "outside", "inside", "ended", "over", "odd"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    kind = "file string, start bigint, outside boolean, inside boolean, ended boolean, over bigint, odd bigint"
    splits = told.mapInArrow(sums, kind).persist()  # one small row a split
    try:
        seen = splits.agg(F.sum("odd").alias("odd"), F.sum("over").alias("over")).first()
        if not seen["over"]:
            return seen["odd"] or 0, 0, {}

        def step(before: dict, split: dict) -> tuple[dict | None, dict]:
            began = before["began"]
            if not split["inside" if began is not None else "outside"]:
                after = None
            else:
                after = split["start"] if began is None or split["ended"] else began
            return {"after": after}, {"began": after}

        # splits without a quote are in none of the rows; what holds behind a row holds up to the next
        ends = in_order(splits, ["outside", "inside", "ended"], lambda: {"began": None}, step, "after: bigint")
    finally:
        splits.unpersist()
    opened: dict = {}
    for r in ends:
        opened.setdefault(r["file"], []).append((r["start"], r["after"]))
    return seen["odd"] or 0, seen["over"], opened


def records(spark: SparkSession, path: str, quoting: Quoting, opened: dict) -> DataFrame:
    """(record binary, place, file): one row per record, without its line end.

    place is 0 and 1 for the first two records of a file and 2 for all others; file
    is told for the first two. Blank lines are no records. ``opened`` comes from ``survey``.
    """
    import bisect

    def began(file: str, start: int) -> int | None:
        """The split in which the record began that is open where this split begins."""
        known = opened.get(file, [])
        at = bisect.bisect_left(known, (start,)) - 1
        return known[at][1] if at >= 0 else None

    def cut(batches: Iterator[pa.RecordBatch], parts: bool) -> Iterator[pa.RecordBatch]:
        key, held, from_, place = None, [], None, 2
        out: list = []

        def done(line_end: bool) -> None:
            """The held lines are a record, or a part of one that another split shares."""
            nonlocal held, from_, place
            text = b"\n".join(held)
            shared = from_ is not None or not line_end
            if parts and shared:
                out.append((key[0], key[1] if from_ is None else from_, key[1], text))
            elif not parts and (text.strip() or len(held) > 1) and not shared:
                out.append((text.removesuffix(b"\r"), place, key[0] if place < 2 else None))
                place = min(place + 1, 2)
            elif not parts and shared and place < 2:  # a record over splits is no header
                place = 2
            held, from_ = [], None

        def flush() -> pa.RecordBatch:
            nonlocal out
            columns = list(zip(*out)) or [()] * (4 if parts else 3)
            kinds, names = (
                ([pa.string(), pa.int64(), pa.int64(), pa.binary()], ["file", "began", "start", "part"])
                if parts
                else ([pa.binary(), pa.int32(), pa.string()], ["record", "place", "file"])
            )
            out = []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for file, start, rows in stretches(batches):
            if (file, start) != key:
                if held:
                    done(False)
                key, from_, place = (file, start), began(file, start), 0 if start == 0 else 2
            inside = bool(held) or from_ is not None
            for line in rows.column(0).to_pylist():
                held.append(line)
                inside = quoting.open_after(line, inside)
                if not inside:
                    done(True)
            yield flush()
        if held:
            done(False)
        yield flush()

    lines = located(spark, path)
    whole = lines.mapInArrow(lambda batches: cut(batches, False), "record binary, place int, file string")
    if not any(began_at is not None for ends in opened.values() for _, began_at in ends):
        return whole
    # The few records that splits share: their parts by the split in which they began. A cell that nothing closes ends with its file.
    parts = lines.mapInArrow(lambda batches: cut(batches, True), "file string, began bigint, start bigint, part binary")
    joined = parts.groupBy("file", "began").agg(F.sort_array(F.collect_list(F.struct("start", "part"))).alias("parts"))
    text = F.aggregate("parts", F.lit(None).cast("binary"), lambda a, p: F.when(a.isNull(), p["part"]).otherwise(F.concat(a, F.lit(b"\n"), p["part"])))
    ended = F.when(F.endswith(text, F.lit(b"\r")), F.substring(text, F.lit(1), F.octet_length(text) - 1)).otherwise(text)
    return whole.unionByName(joined.select(ended.alias("record"), F.lit(2).alias("place"), F.lit(None).cast("string").alias("file")))
