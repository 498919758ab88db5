"""Removal of long repeats with a logarithmic family of tables of chosen suffixes.

Texts come in batches. A batch gets its own table of suffixes, bucketed by the hash of their
first bytes, which is hash-joined to the tables of the existing levels; two levels of
one size merge into one of the next size, so that an entry is rewritten a logarithmic
number of times. Nothing is scanned in suffix order, and bytes are compared by fingerprints of
64 bits: this is not the suffix-array method by the letter (see the README).

The tables are sparse. Every string of LENGTH bytes belongs to one suffix, its
anchor: the place of the least hash among its first WINDOW places. Equal strings
have their anchors at equal offsets, so two strings can only be equal if their
anchors' suffixes share at least RIGHT bytes (``key``). For each anchor an entry holds
the range of offsets of its strings and a fingerprint ``cls`` of all bytes that these
strings cover. Equal anchors of a text that follow each other closely, as in a phrase said
over and over, are one entry with its first and last place. If all entries of a key have one fingerprint, all their strings are
repeated; otherwise the bytes around one entry of each fingerprint are compared.

Texts are known by hash and length of their content. A text that stands in several
rows repeats itself as a whole, so repeated rows need no entries of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm import words as W
from sightline.plans.shared import reliable, scratch_path

#: Bytes of a repeated string, places among which its anchor is chosen, bytes hashed at a place.
LENGTH, WINDOW, GRAM = 400, 301, 16
RIGHT = LENGTH - WINDOW + 1
#: Bytes of text whose anchors a task finds at once (about 100 bytes of arrays each); a longer text is worked on alone.
SLICE = 1 << 18
#: Bytes of an Arrow batch of texts; by rows alone, 10,000 texts would be one, in several copies on either side.
ARROW_BYTES = 4 << 20
#: Batches that a whole corpus is cut into, by hash.
BATCHES = 4
#: Entries of one key with different fingerprints that one task compares; more are compared string by string.
GROUP = 20_000
#: Groups up to this size are compared pair by pair.
PAIRS = 48
#: Bits of the filter of entries whose bytes are compared: 4 MB, however many there are.
FILTER_BITS = 1 << 25

ENTRY = "head long, key long, cls long, text_key long, size int, pos int, last int, times int, low int, high int"
ENTRY_NAMES = [x.split()[0] for x in ENTRY.split(", ")]
IDENTITY = ["key", "cls", "low", "high"]


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each stretch of ``width`` values."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    ahead = np.minimum.accumulate(padded.reshape(blocks, width), axis=1).reshape(-1)
    back = np.minimum.accumulate(padded.reshape(blocks, width)[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = n - width + 1
    return np.minimum(back[:m], ahead[width - 1 : width - 1 + m])


def anchors(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Entries of some texts: text index, places of the anchor, offsets of its strings, key and fingerprint.

    Anchors of a text that are equal in all but place, each at most LENGTH behind the one
    before, are one entry with first and last place and number: what their strings cover has no gap.
    """
    sizes = np.diff(offsets)
    none = np.zeros(0, np.int64)
    if not (sizes >= LENGTH).any():
        return {k: none for k in ("text", "pos", "last", "times", "low", "high", "key", "cls", "head")}
    prefix = W.prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    hashes = W.range_hash(prefix, at, at + GRAM)
    least = _sliding_least((hashes >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64), WINDOW)
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.zeros(len(data) + 1, np.int64)  # where a string begins
    whole = np.flatnonzero(sizes >= LENGTH)
    np.add.at(start, offsets[whole], 1)
    np.subtract.at(start, offsets[whole + 1] - LENGTH + 1, 1)
    begins = np.flatnonzero(np.cumsum(start)[:-1])
    own = anchor[begins]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (begins[1:] != begins[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begins)) - 1
    p, low, high = own[first], own[first] - begins[last], own[first] - begins[first]
    text = np.searchsorted(offsets, p, "right") - 1
    key, cls = W.range_hash(prefix, p, p + RIGHT), W.range_hash(prefix, p - high, p - low + LENGTH)
    order = np.lexsort((p, high, low, cls, key))
    near = (np.diff(p[order]) <= LENGTH) & (np.diff(text[order]) == 0)
    for same in (key, cls, low, high):
        near &= same[order[1:]] == same[order[:-1]]
    run = np.flatnonzero(np.concatenate([[True], ~near]))
    times = np.diff(np.append(run, len(p)))
    end = p[order[run + times - 1]]
    back = np.argsort(order[run])  # in the order of places
    one, end, times = order[run][back], end[back], times[back]
    p, low, high, text, key, cls = (x[one] for x in (p, low, high, text, key, cls))
    head = np.zeros(len(p), np.int64)
    for j in range(7):  # seven bytes keep the order of suffixes in a signed number
        head = head << 8 | data[p + j]
    return {
        "text": text, "pos": p - offsets[text], "last": end - offsets[text], "times": times, "low": low, "high": high, "head": head,
        "key": key.view(np.int64), "cls": cls.view(np.int64),
    }


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """(text_key, size, text) with text as bytes, empty for null."""
    plain = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    return docs.select(plain.alias("text")).select(F.xxhash64("text").alias("text_key"), F.length("text").alias("size"), "text")


def entries(texts: DataFrame) -> DataFrame:
    """Suffix entries of (text_key, size, text)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for a, b, data, offsets in W.slices(batch.column(2), SLICE):
                e = anchors(data, offsets)
                columns = [e["head"], e["key"], e["cls"], keys[a:b][e["text"]], sizes[a:b][e["text"]]] + [e[c].astype(np.int32) for c in ENTRY_NAMES[5:]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ENTRY_NAMES)

    return texts.where(F.col("size") >= LENGTH).mapInArrow(find, ENTRY)


class SuffixFamily:
    """Levels of entries in the session's warehouse, bucketed and matched by key.

    ``add`` puts a batch in and returns nothing; what matched lies in ``matches``.
    ``drop`` removes the arrays. A level is a complete table: a task or executor that
    is lost only repeats its part.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None) -> None:
        self.spark = spark
        self.name = f"suffix_levels_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, str] = {}
        self.fresh: str | None = None
        self.made = 0
        self.folder = scratch_path(spark, "suffix-matches")
        self.found: list[str] = []

    def _store(self, rows: DataFrame) -> str:
        self.made += 1
        table = f"{self.name}_{self.made}"
        rows.write.bucketBy(self.buckets, "key").sortBy("head", "key", "cls").saveAsTable(table)
        return table

    def _merge(self) -> None:
        """Give the last batch its level; equal levels merge into the next."""
        level, carry = 0, self.fresh
        while level in self.levels:
            other = self.levels.pop(level)
            merged = self._store(self.spark.table(other).unionByName(self.spark.table(carry)).repartition(self.buckets, "key"))
            for old in (other, carry):
                self.spark.sql(f"DROP TABLE {old}")
            level, carry = level + 1, merged
        self.levels[level], self.fresh = carry, None

    def add(self, texts: DataFrame) -> None:
        """Put (text_key, size, text) in as a batch and record all matches within it and with earlier ones."""
        if self.fresh:
            self._merge()
        rows = entries(texts).repartition(self.buckets, "key").dropDuplicates(["key", "text_key", "size", "pos"])
        self.fresh = self._store(rows)
        fresh = self.spark.table(self.fresh)
        keys = fresh.groupBy("key").agg(F.sum("times").alias("n"))
        partners = [keys.where("n > 1").select("key")]
        parts = []
        for table in self.levels.values():
            level = self.spark.table(table)
            parts.append(level.join(keys.select("key"), "key", "left_semi"))
            partners.append(keys.select("key").join(level.select("key"), "key", "left_semi"))
        known = partners[0]
        for p in partners[1:]:
            known = known.unionByName(p)
        parts.append(fresh.join(known.distinct(), "key", "left_semi"))
        for i, part in enumerate(parts):
            path = f"{self.folder}/{self.made}-{i}"
            part.select(*ENTRY_NAMES[1:]).write.parquet(path)
            self.found.append(path)

    def matches(self) -> DataFrame:
        """Entries whose key another entry has; some may come several times."""
        return self.spark.read.schema(", ".join(ENTRY.split(", ")[1:])).parquet(*self.found)

    def drop(self) -> None:
        for table in [*self.levels.values(), *([self.fresh] if self.fresh else [])]:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.levels, self.fresh = {}, None


def _bit() -> Column:
    return F.col("cls").bitwiseXOR(F.col("text_key")).bitwiseXOR(F.shiftleft(F.col("pos").cast("long"), 11)).bitwiseAND(F.lit(FILTER_BITS - 1))


def _filter(chosen: DataFrame) -> bytes:
    maps = (
        chosen.select((_bit() + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map")).collect()
    )
    out = bytearray(FILTER_BITS // 8)
    for row in maps:
        at = (row["part"] - 1) * 4096
        out[at : at + len(row["map"])] = row["map"]
    return bytes(out)


def contexts(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen entries with the bytes of their strings before (``left``, reversed) and from (``right``) the anchor."""
    bitmap = _filter(chosen)
    kind = f"{', '.join(ENTRY.split(', ')[1:])}, left binary, right binary"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap, np.uint8)
        for batch in batches:
            keys, sizes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for a, b, data, offsets in W.slices(batch.column(2), SLICE):
                e = anchors(data, offsets)
                key = keys[a:b][e["text"]]
                bit = (e["cls"] ^ key ^ (e["pos"] << 11)) & (FILTER_BITS - 1)
                take = np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                at = offsets[e["text"][take]] + e["pos"][take]
                raw = data.tobytes()
                left = [raw[p - h : p][::-1] for p, h in zip(at.tolist(), e["high"][take].tolist())]
                right = [raw[p : p - low + LENGTH] for p, low in zip(at.tolist(), e["low"][take].tolist())]
                columns = [pa.array(c) for c in (e["key"][take], e["cls"][take], key[take], sizes[a:b][e["text"]][take])]
                columns += [pa.array(e[c][take].astype(np.int32)) for c in ENTRY_NAMES[5:]] + [pa.array(left, pa.binary()), pa.array(right, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*ENTRY_NAMES[1:], "left", "right"])

    rows = texts.where(F.col("size") >= LENGTH).mapInArrow(find, kind)
    same = [*IDENTITY, "text_key", "size", "pos"]
    return rows.join(chosen.select(*same), same, "left_semi").dropDuplicates(same)


RANGE = "key long, cls long, low int, high int, least int, most int"


def _matrix(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = W.bytes_of(values)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), LENGTH), np.uint8)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(data)) - offsets[row]] = data
    return out, sizes


def _agree(matrix: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that rows a and b have in common from their beginning."""
    differ = matrix[a] != matrix[b]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    return np.minimum(first, np.minimum(sizes[a], sizes[b]))


def _ranges(group: np.ndarray, low: np.ndarray, high: np.ndarray, left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest offset at which an entry's string equals another entry's of its group; least > most if none does."""
    n = len(group)
    least, most = np.full(n, LENGTH, np.int64), np.full(n, -1, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    counts = np.diff(np.append(starts, n))
    lefts, left_sizes = _matrix(left)
    rights, right_sizes = _matrix(right)
    for m in np.unique(counts[(counts > 1) & (counts <= PAIRS)]):
        these = starts[counts == m]
        i, j = np.triu_indices(m, 1)
        step = max(1, (1 << 14) // len(i))
        for k in range(0, len(these), step):
            a, b = ((these[k : k + step, None] + x[None]).reshape(-1) for x in (i, j))
            bottom = np.maximum(LENGTH - _agree(rights, right_sizes, a, b), np.maximum(low[a], low[b]))
            top = np.minimum(_agree(lefts, left_sizes, a, b), np.minimum(high[a], high[b]))
            ok = bottom <= top
            for side in (a[ok], b[ok]):
                np.minimum.at(least, side, bottom[ok])
                np.maximum.at(most, side, top[ok])
    for s, m in zip(starts[counts > PAIRS], counts[counts > PAIRS]):
        _by_offset(s, m, lefts, left_sizes, rights, right_sizes, low, high, least, most)
    return least, most


def _by_offset(s, m, lefts, left_sizes, rights, right_sizes, low, high, least, most) -> None:
    """A large group: sort by either side; at each offset, equal neighbours in both orders are equal strings."""
    orders, shared = [], []
    for matrix, sizes in ((lefts, left_sizes), (rights, right_sizes)):
        order = np.lexsort(matrix[s : s + m].T[::-1])
        orders.append(order + s)
        shared.append(_agree(matrix, sizes, order[:-1] + s, order[1:] + s))
    for o in range(int(low[s : s + m].min()), int(high[s : s + m].max()) + 1):
        valid = np.flatnonzero((low[s : s + m] <= o) & (o <= high[s : s + m])) + s
        if len(valid) < 2:
            continue
        ids = []
        for order, lcp, need in ((orders[0], shared[0], o), (orders[1], shared[1], LENGTH - o)):
            name = np.zeros(m, np.int64)
            name[order - s] = np.concatenate([[0], np.cumsum(lcp < need)])
            ids.append(name[valid - s])
        _, back, n = np.unique(ids[0] * m + ids[1], return_inverse=True, return_counts=True)
        twice = valid[n[back] > 1]
        least[twice] = np.minimum(least[twice], o)
        most[twice] = np.maximum(most[twice], o)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated offsets for rows in the order of keys; a key that goes on in the next batch waits for it."""
    held: pa.Table | None = None

    def done(table: pa.Table) -> pa.RecordBatch:
        c = {x: table[x].to_numpy() for x in IDENTITY}
        least, most = _ranges(c["key"], c["low"], c["high"], table["left"].combine_chunks(), table["right"].combine_chunks())
        take = np.flatnonzero(least <= most)
        columns = [c[x][take] for x in IDENTITY] + [least[take].astype(np.int32), most[take].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [*IDENTITY, "least", "most"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        if not table.num_rows:
            continue
        keys = table["key"].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        held = table.slice(cut)
        for at in range(0, cut, 1 << 14):  # whole keys, some rows at a time
            low = int(np.searchsorted(keys, keys[at])) if at else 0
            high = cut if at + (1 << 14) >= cut else int(np.searchsorted(keys, keys[at + (1 << 14)]))
            if high > low:
                yield done(table.slice(low, high - low).combine_chunks())
    if held is not None and held.num_rows:
        yield done(held.combine_chunks())


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A fingerprint for each string of each entry."""
    for batch in batches:
        c = {x: batch[x].to_numpy() for x in IDENTITY}
        for i, (left, right) in enumerate(zip(batch["left"].to_pylist(), batch["right"].to_pylist())):
            data = np.frombuffer(left[::-1] + right, np.uint8)
            o = np.arange(c["low"][i], c["high"][i] + 1)
            begin = len(left) - o
            hashes = W.range_hash(W.prefix_hash(data), begin, begin + LENGTH).view(np.int64)
            same = [np.full(len(o), c[x][i]) for x in IDENTITY]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in [*same, o.astype(np.int32), hashes]], [*IDENTITY, "o", "string"])


def repeated_ranges(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(key, cls, low, high, least, most) of all entries some of whose strings occur elsewhere; offsets of those strings.

    ``found``: distinct matching entries. Strings at offsets between least and most
    cover the same bytes whether each of them is repeated or not.
    """
    classes = found.groupBy(*IDENTITY).agg(F.sum("times").alias("n"), F.min(F.struct("text_key", "size", "pos")).alias("one"))
    classes = reliable(classes.select(*IDENTITY, "n", "one.*"))
    kinds = classes.groupBy("key").agg(F.count("*").alias("kinds"))
    full = classes.where("n > 1").select(*IDENTITY, F.col("low").alias("least"), F.col("high").alias("most"))
    mixed = classes.join(kinds.where("kinds > 1"), "key")
    around = reliable(contexts(texts, mixed).join(kinds, "key"))
    small = around.where(F.col("kinds") <= GROUP).drop("kinds")
    compared = small.repartition("key").sortWithinPartitions("key").mapInArrow(_compare, RANGE)
    strings = around.where(F.col("kinds") > GROUP).drop("kinds").mapInArrow(_strings, "key long, cls long, low int, high int, o int, string long")
    again = strings.groupBy("key", "string").agg(F.count("*").alias("m")).where("m > 1")
    large = strings.join(again, ["key", "string"]).groupBy(*IDENTITY).agg(F.min("o").alias("least"), F.max("o").alias("most"))
    every = full.unionByName(compared).unionByName(large)
    return every.groupBy(*IDENTITY).agg(F.min("least").alias("least"), F.max("most").alias("most"))


CUT = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("kept", T.BinaryType()),
    ]
)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """What Spark runs within this sends texts to Python by ARROW_BYTES; the session's setting returns afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(ARROW_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def runs(ranges: DataFrame) -> DataFrame:
    """(text_key, size, n_removed, spans) of each text: the maximal runs of its ranges in order."""
    text = ["text_key", "size"]
    order = Window.partitionBy(*text).orderBy("begin")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = ranges.withColumn("opens", F.when(F.col("begin") <= before, 0).otherwise(1))
    rows = opens.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = rows.groupBy(*text, "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return merged.groupBy(*text).agg(F.sum(F.col("end") - F.col("begin")).alias("n_removed"), F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def _cut(text: Column, removed: Column, spans: Column) -> Column:
    """Struct CUT of a text as bytes and its maximal runs; Spark cuts it, so no task holds more than one row's pieces."""
    spans = F.coalesce(spans, F.array().cast("array<struct<begin int, end int>>"))
    begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["begin"]), F.array(F.length(text)))
    pieces = F.zip_with(begins, ends, lambda a, b: F.substring(text, a + 1, b - a).cast("string"))
    kept = F.array_join(pieces, "").cast("binary")  # joined byte by byte, whatever the pieces hold
    columns = [F.length(text), F.coalesce(removed, F.lit(0)), F.size(spans), F.transform(spans, lambda s: F.array(s["begin"], s["end"])), kept]
    return F.struct(*[c.alias(n) for c, n in zip(columns, CUT.names)]).cast(CUT)


def remove_repeats(docs: DataFrame, text: str = "text", out: str = "repeats", batches: int = BATCHES) -> DataFrame:
    """Append struct ``out`` of n_bytes, n_removed, n_spans, spans and the kept bytes to every row.

    A byte goes if a string of LENGTH bytes that covers it also starts anywhere
    else, in the same text or in another; every occurrence goes, judged on the texts
    as they came. Texts are UTF-8 bytes, null is empty; matches never cross texts.
    Repeated rows repeat each other; shorter texts keep all; a column already named
    ``out`` is replaced. spans are the maximal removed runs, as [begin, end).
    """
    spark = docs.sparkSession
    texts = _texts(docs, text)
    with _small_batches(spark):  # every pass over texts is run here
        family = SuffixFamily(spark)
        for i in range(batches):
            family.add(texts.where(F.pmod("text_key", F.lit(batches)) == i))
        found = reliable(family.matches().dropDuplicates(["key", "text_key", "size", "pos"]))
        family.drop()
        ranges = repeated_ranges(texts, found)
    hits = found.join(ranges, IDENTITY).select(
        "text_key", "size", (F.col("pos") - F.col("most")).alias("begin"), (F.col("last") - F.col("least") + LENGTH).alias("end")
    )
    copies = texts.where(F.col("size") >= LENGTH).groupBy("text_key", "size").count().where("count > 1")
    copies = copies.select("text_key", "size", F.lit(0).alias("begin"), F.col("size").alias("end"))
    spans = runs(hits.unionByName(copies))
    columns = [c for c in docs.columns if c.lower() != out.lower()]
    plain = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), plain.alias("bytes"))
    rows = rows.withColumn("text_key", F.xxhash64("bytes")).withColumn("size", F.length("bytes")).drop("bytes")
    joined = rows.join(spans, ["text_key", "size"], "left")
    content = F.coalesce(F.col(f"row.`{text}`").cast("binary"), F.lit(b""))
    cut = joined.select("row", _cut(content, F.col("n_removed"), F.col("spans")).alias("cut"))
    return cut.select("row.*", F.col("cut").alias(out))
