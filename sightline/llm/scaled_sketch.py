"""Operator 11: fingerprints of documents by threshold-scaled sketches.

A text's shingles are its strings of 20 bytes, with A-Z in lower case and each run of
white space as one space; a shorter text is one shingle. The sketch keeps every
shingle hash below a sixteenth of all hashes, and of a text without any such hash the
smallest one. So a sketch grows with its text, the sketch of several texts together is the union
of theirs, and the share of a sketch that lies in another estimates how much of
one text the other holds, however unequal their lengths are.

A fingerprint is the sorted sketch in hexadecimal, 8 digits a hash. Equal texts have equal
fingerprints; a text without anything but white space, and null, has an empty one.

Cases: rows never depend on each other but in ``with_next``, which orders rows by id
(null first) and text hash; several rows under one id are distinct documents. Empty
tables give empty results. Columns are read by the names given, others ride along.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from sightline.llm.words import SLICE, bytes_of, mix, per_text, powers, prefix_hash, range_hash, slices

#: Bytes of a shingle, and how many hashes there are to one that is kept.
SHINGLE = 20
SCALE = 16
#: Bytes of text that one bucket of the order by id holds, about.
BUCKET = 16 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
_ODD = np.uint64(0xD6E8FEB86659FD93)


# ---- sketches -----------------------------------------------------------------------


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in lower case, runs of white space as one space, none at a text's ends."""
    if not len(data):
        return data, offsets
    data = _FOLD[data]
    space = data == 32
    keep = ~space
    keep[1:] |= ~space[:-1]  # a space stays behind anything but a space ...
    begins = offsets[:-1][np.diff(offsets) > 0]
    keep[begins] = ~space[begins]  # ... and not where a text begins
    offsets = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[offsets]
    data = data[keep]
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    ends = ends[data[ends] == 32]  # nor where it ends
    return np.delete(data, ends), offsets - np.searchsorted(ends, offsets)


def sketches(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted 32-bit sketch of each text."""
    data, offsets = folded(data, offsets)
    n, lengths, prefix = len(offsets) - 1, np.diff(offsets), prefix_hash(data)
    # the hashes of all strings of 20 bytes; those over a text's end are left out below
    hashes = prefix[SHINGLE:] - prefix[:-SHINGLE] if len(data) >= SHINGLE else prefix[:0].copy()
    hashes *= powers(len(prefix))[1][: len(hashes)]
    hashes *= _ODD
    kept = np.flatnonzero(hashes < np.uint64(2**64 // SCALE))
    text = np.searchsorted(offsets, kept, "right") - 1
    whole = kept + SHINGLE <= offsets[text + 1]
    kept, text = kept[whole], text[whole]
    values = mix(hashes[kept])
    none = lengths > 0
    none[text] = False
    short = np.flatnonzero(none & (lengths < SHINGLE))
    more = [range_hash(prefix, offsets[short], offsets[short + 1])]
    other = np.flatnonzero(none & (lengths >= SHINGLE))  # nothing below the threshold: the smallest hash
    more.append(mix(np.array([hashes[offsets[i] : offsets[i + 1] - SHINGLE + 1].min() for i in other], np.uint64)))
    text, values = np.concatenate([text, short, other]), np.concatenate([values, *more]) >> np.uint64(32)
    pairs = np.unique(text.astype(np.uint64) << np.uint64(32) | values)
    parts = np.searchsorted(pairs >> np.uint64(32), np.arange(1, n, dtype=np.uint64))
    return np.split(pairs.astype(np.uint32), parts)


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the shorter text's shingles that the other text holds; 1 for two texts without any."""
    least = min(len(a), len(b))
    if least == 0:
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / least


def sketch(text: Column) -> Column:
    """struct(fingerprint string, hashes array of long) of each text."""

    def made(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        found = sketches(data, offsets)
        return [pa.array([written(s) for s in found], pa.string()), pa.array([s.astype(np.int64) for s in found], pa.list_(pa.int64()))]

    return per_text(made, [("fingerprint", T.StringType()), ("hashes", T.ArrayType(T.LongType()))], text)


def merged(docs: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by..., hash): sketches of all texts of each group together, one row per hash so that no group is ever one row."""
    made = docs.select(*by, sketch(F.col(text)).alias("sketch"))
    return made.select(*by, F.explode("sketch.hashes").alias("hash")).distinct()


def containment(parts: DataFrame, wholes: DataFrame, part: str, whole: str) -> DataFrame:
    """(part, whole, shared, containment): estimated share of each part that each whole holds, where they share a hash.

    Both are (key, hash) as ``merged`` gives them. A hash that many keys share meets
    only the other side's keys for it, and counts are summed before the shuffle.
    """
    sizes = parts.groupBy(part).agg(F.count("*").alias("size"))
    shared = parts.select(part, "hash").join(wholes.select(whole, "hash"), "hash").groupBy(part, whole).agg(F.count("*").alias("shared"))
    return shared.join(sizes, part).select(part, whole, "shared", (F.col("shared") / F.col("size")).alias("containment"))


# ---- each document beside the next one ----------------------------------------------


def in_buckets(docs: DataFrame, doc_id: str, text: str, bucket_bytes: int = BUCKET) -> DataFrame:
    """Rows with ``__bucket`` and ``__borrowed``; buckets follow each other in the order of id (null first) and text hash.

    The head of each bucket also goes to the bucket before it, as a borrowed row, and the first
    one of all to the last bucket. So texts move once and no bucket needs another.
    """
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, int(total // bucket_bytes))
    keys = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"))
    if n > 1:
        laid = keys.repartitionByRange(n, "id", "h").withColumn("at", F.spark_partition_id())
        low = laid.groupBy("at").agg(F.min_by(F.struct("id", "h"), F.struct(F.col("id").isNotNull(), "id", "h")).alias("low"))
        heads = [(r.low.id, r.low.h) for r in low.collect()]  # one a bucket
    else:
        heads = [(r.id, r.h) for r in keys.orderBy("id", "h").limit(1).collect()]

    def key(i, h) -> tuple:
        return i is not None, i if i is not None else 0, h

    ranks = sorted({key(*x) for x in heads})
    last = len(ranks) - 1

    @F.arrow_udf("array<int>")
    def buckets(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        """The bucket of a row; for a head also the bucket before, as -1 - bucket."""
        places = []
        for i, h in zip(ids.to_pylist(), hashes.to_pylist()):
            k = key(i, h)
            b = max(bisect.bisect_right(ranks, k) - 1, 0)
            places.append([b, -1 - (b - 1 if b else last)] if ranks and ranks[b] == k else [b])
        return pa.array(places, pa.list_(pa.int32()))

    place = F.col("__place")
    dealt = docs.withColumn("__places", buckets(F.col(doc_id), F.xxhash64(text))).withColumn("__place", F.explode("__places"))
    dealt = dealt.withColumn("__borrowed", place < 0).withColumn("__bucket", F.when(place < 0, -1 - place).otherwise(place))
    return dealt.drop("__places", "__place")


def with_next(docs: DataFrame, doc_id: str, text: str, out: str, bucket_bytes: int = BUCKET) -> DataFrame:
    """Each row with the text of the row next in order of id, the first one's for the last, as column ``out``."""
    order = Window.partitionBy("__bucket").orderBy("__borrowed", F.asc_nulls_first(doc_id), F.xxhash64(text))
    following = in_buckets(docs, doc_id, text, bucket_bytes).withColumn(out, F.lead(F.col(text)).over(order))
    return following.where(~F.col("__borrowed")).drop("__borrowed", "__bucket")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they and the next document's are.

    The edited text has the document's last half (rounded down, in code points)
    replaced by as much of the next document's beginning. Columns: ``doc_id``,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Documents stream through the buckets in order, each beside the next one.
    """
    fields = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    kind = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), *T.StructType.fromDDL(fields).fields])
    schema = to_arrow_schema(kind)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # the last row so far: bucket, borrowed, id, text, sketch
        for batch in batches:
            marks = [batch.column(i).to_pylist() for i in range(3)]
            for low, high, *_ in slices(batch.column(3), SLICE // 2):
                texts = [t or "" for t in batch.column(3).slice(low, high - low).to_pylist()]
                own = sketches(*bytes_of(pa.array(texts, pa.large_string())))
                rows = held + list(zip(*[m[low:high] for m in marks], texts, own))
                held = rows[-1:]
                pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1]]  # what follows a borrowed row is of another bucket
                edited = [a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in pairs]
                found = sketches(*bytes_of(pa.array(edited, pa.large_string())))
                out = [
                    (a[2], len(a[3]), hashlib.sha256(e.encode()).hexdigest(), written(a[4]), written(f), likeness(a[4], f), likeness(a[4], b[4]))
                    for (a, b), e, f in zip(pairs, edited, found)
                ]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    known = docs.select(F.col(doc_id), F.col(text).alias("__text"))
    dealt = in_buckets(known, doc_id, "__text", bucket_bytes)
    laid = dealt.repartition("__bucket").sortWithinPartitions("__bucket", "__borrowed", F.asc_nulls_first(doc_id), F.xxhash64("__text"))
    return laid.select("__bucket", "__borrowed", doc_id, "__text").mapInArrow(compare, kind)
