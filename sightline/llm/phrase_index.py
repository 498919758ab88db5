"""Benchmark decontamination on a distributed positional inverted index.

The index holds postings (term, text_key, pos) of training texts. A test window is
found from its rarest terms: their postings, shifted by the term's place in the
item, must agree on one alignment of item and text. Alignments that remain are
compared word by word with the text, so the result is exact.

Texts are known by a hash of their content, not by an id: equal texts share their
postings, null and repeated ids do no harm, and should two texts share a hash, the
comparison with the text itself still decides.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm import words as W
from sightline.plans.shared import reliable

#: Bits of the filter of wanted terms, 512 KB whatever the number of terms.
FILTER_BITS = 1 << 22

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())), T.StructField("items_sha256", T.StringType()),
    ]
)


def text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def word_hashes(text: Column) -> Column:
    """Array of the word hashes of a text; empty for null."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def column(texts: pa.Array) -> pa.Array:
        parts = []
        for _, _, data, offsets in W.slices(texts):
            w = W.tokenize(data, offsets, W.ALNUM)
            parts.append(pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), pa.array(w.hashes.view(np.int64))))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    return column.asNondeterministic()(text)


def term_filter(terms: DataFrame) -> bytes:
    """Bitmap of hashed terms: FILTER_BITS bits, gathered as at most 128 partial maps of 4 KB."""
    bit = F.pmod(F.col("term"), F.lit(FILTER_BITS)) + 1
    maps = (
        terms.select(bit.alias("bit"))
        .groupBy(F.bitmap_bucket_number("bit").alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
        .collect()
    )
    out = bytearray(FILTER_BITS // 8)
    for row in maps:
        at = (row["part"] - 1) * 4096
        out[at : at + len(row["map"])] = row["map"]
    return bytes(out)


def _wanted(bitmap: bytes):
    bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").astype(bool)
    return lambda hashes: bits[(hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)]


def term_counts(docs: DataFrame, text: str, bitmap: bytes) -> DataFrame:
    """(term, n) of the words in the filter over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _wanted(bitmap)
        for batch in batches:
            found = []
            for _, _, data, offsets in W.slices(batch.column(0)):
                hashes = W.tokenize(data, offsets, W.ALNUM).hashes
                found.append(hashes[wanted(hashes)])
            terms, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

    parts = docs.select(F.col(f"`{text}`")).mapInArrow(count, "term long, n long")
    return parts.groupBy("term").agg(F.sum("n").alias("n"))


def build_index(docs: DataFrame, text: str = "text", bitmap: bytes | None = None) -> DataFrame:
    """Postings (term, text_key, pos) of every word of every text, or of the words in a filter."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _wanted(bitmap) if bitmap is not None else None
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in W.slices(batch.column(1)):
                w = W.tokenize(data, offsets, W.ALNUM)
                at = np.flatnonzero(wanted(w.hashes)) if wanted else np.arange(len(w.hashes))
                pos = at - np.repeat(w.first[:-1], w.counts)[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.hashes[at].view(np.int64)), pa.array(keys[a:b][w.text_of[at]]), pa.array(pos)],
                    ["term", "text_key", "pos"],
                )

    return docs.select(text_key(text).alias("text_key"), F.col(f"`{text}`")).mapInArrow(
        post, "term long, text_key long, pos long"
    )


def items_of(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_id, words): distinct items with at least one word."""
    rows = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item_id"), word_hashes(F.col(f"`{text}`")).alias("words"))
    return (
        rows.where(F.size("words") > 0)
        .withColumn("item", F.xxhash64(F.coalesce("item_id", F.lit("")), F.col("item_id").isNull(), "words"))
        .dropDuplicates(["item"])
    )


def rarest(items: DataFrame, counts: DataFrame, window: int, terms: int) -> DataFrame:
    """(item, low, high, picks): for each window that can occur at all, the places of its rarest terms.

    Windows of the same words count once, at their first place, so an item that
    repeats itself has no more picks than it has different windows. These windows lie in the
    item's words ``low`` to ``high``.
    """
    placed = items.select("item", F.posexplode("words").alias("at", "term")).join(counts, "term", "left")
    place = F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), "term")
    whole = placed.groupBy("item").agg(F.array_sort(F.collect_list(place)).alias("places"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("places") - window, F.lit(0)))
    windows = whole.select("item", F.explode(F.transform(starts, lambda s: F.slice("places", s + 1, window))).alias("w"))
    possible = windows.where(~F.exists("w", lambda p: p["n"] == 0))
    first = possible.groupBy("item", F.col("w.term").alias("words")).agg(F.min_by("w", F.col("w")[0]["at"]).alias("w"))
    by_count = F.array_sort(F.transform("w", lambda p: F.struct(p["n"], p["at"])))
    picks = first.select("item", "w", F.transform(F.slice(by_count, 1, terms), lambda p: p["at"]).alias("pick"))
    return picks.groupBy("item").agg(
        F.min(F.col("w")[0]["at"]).alias("low"),
        F.max(F.element_at("w", -1)["at"] + 1).alias("high"),
        F.collect_set("pick").alias("picks"),
    )


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))


def alignments(index: DataFrame, items: DataFrame, picks: DataFrame) -> DataFrame:
    """(text_key, item, shift): item placed at word ``shift`` of a text, with all rarest terms of a window in place.

    Places met are kept as bits by their number modulo 64, which tells the places of one
    window apart; places of other windows may stand in for each other, so a few more alignments
    come back than there are, and none less.
    """
    wanted = picks.select("item", F.explode(F.array_distinct(F.flatten("picks"))).alias("at"))
    places = items.select("item", F.posexplode("words").alias("at", "term")).join(wanted, ["item", "at"])
    shifted = index.join(places, "term").select("text_key", "item", (F.col("pos") - F.col("at")).alias("shift"), _bit(F.col("at")).alias("place"))
    met = shifted.groupBy("text_key", "item", "shift").agg(F.bit_or("place").alias("found"))
    bits = F.transform("picks", lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda have, at: have.bitwiseOR(_bit(at))))
    needed = picks.select("item", F.array_distinct(bits).alias("needed"))
    return (
        met.join(needed, "item")
        .where(F.exists("needed", lambda n: n.bitwiseAND(F.col("found")) == n))
        .select("text_key", "item", "shift")
    )


def proximity_matches(index: DataFrame, terms: DataFrame, within: int, every: bool = False) -> DataFrame:
    """(query, text_key, start, end): stretches of at most ``within`` words with all terms of a query.

    ``terms`` has (query, term), terms as word hashes; a term asked twice counts once.
    Each text gives its narrowest stretch, of equally narrow ones the first, or with ``every`` all that
    hold no narrower one. Queries without terms give nothing. Postings of one text
    and query meet in one row, as many as the text has words at most.
    """
    asked = terms.distinct()
    total = asked.groupBy("query").agg(F.count("term").alias("n"))
    lists = (
        index.join(asked, "term").groupBy("query", "text_key").agg(F.array_sort(F.collect_set(F.struct("pos", "term"))).alias("seen"))
    )

    @F.arrow_udf("array<struct<start: long, end: long>>")
    def stretches(seen: pa.Array, n: pa.Array) -> pa.Array:
        out = []
        for places, need in zip(seen.to_pylist(), n.to_pylist()):
            # terms by their last place, the earliest first
            last, found = OrderedDict(), []
            for p in places:
                last.pop(p["term"], None)
                last[p["term"]] = p["pos"]
                low = next(iter(last.values()))
                if len(last) == need and p["pos"] - low < within and (not found or found[-1]["start"] != low):
                    found.append({"start": low, "end": p["pos"] + 1})
            if found and not every:
                found = [min(found, key=lambda s: s["end"] - s["start"])]
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))

    found = lists.join(total, "query").select("query", "text_key", stretches.asNondeterministic()("seen", "n").alias("found"))
    return found.select("query", "text_key", F.inline("found"))


def phrase_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    out: str = "leak",
    window: int = 10,
    terms: int = 3,
) -> DataFrame:
    """Append struct ``out`` of n_words, n_hit, n_items, items and items_sha256 to every row of ``docs``.

    Words are runs of a-z, A-Z, 0-9 and characters outside ASCII, in lower case by
    A-Z. A window is ``window`` consecutive words of an item, or a whole shorter
    item. A word inside any occurrence of a window is hit. Null and wordless texts
    have no words and no hits, wordless items occur nowhere, an item without id
    hits but isn't listed, and without items nothing is hit. Repeated rows are
    treated alike; a column already named ``out`` is replaced.
    """
    items = reliable(items_of(benchmark, item_id, item_text))
    vocabulary = items.select(F.explode("words").alias("term"))
    counts = term_counts(docs, text, term_filter(vocabulary))
    picks = reliable(rarest(items, counts, window, terms))
    wanted = items.join(picks, "item").select(
        F.explode(F.transform(F.array_distinct(F.flatten("picks")), lambda at: F.element_at("words", at + 1))).alias("term")
    )
    index = build_index(docs, text, term_filter(wanted))
    # An item goes to a text once, however often it is met there, and only the words that windows to be found lie in.
    hulls = items.join(picks, "item").select("item", "item_id", "low", F.slice("words", F.col("low") + 1, F.col("high") - F.col("low")).alias("words"))
    met = alignments(index, items, picks).groupBy("text_key", "item").agg(F.collect_list("shift").alias("shifts"))
    placed = met.join(hulls, "item").withColumn("shifts", F.transform("shifts", lambda x: x + F.col("low")))
    found = placed.groupBy("text_key").agg(F.collect_list(F.struct("item_id", "shifts", "words")).alias("placed"))

    @F.arrow_udf(RESULT)
    def compare(texts: pa.Array, placed: pa.Array) -> pa.Array:
        rows = []
        for a, b, data, offsets in W.slices(texts):
            w = W.tokenize(data, offsets, W.ALNUM)
            hashes = w.hashes.view(np.int64)
            for i in range(b - a):
                own = hashes[w.first[i] : w.first[i + 1]]
                hit, ids = np.zeros(len(own) + 1, np.int64), set()
                seen = False
                for p in placed[a + i].as_py() or ():
                    item = np.array(p["words"], np.int64)
                    size = min(window, len(item))
                    occurs = False
                    for shift in p["shifts"]:
                        low, high = max(0, -shift), min(len(item), len(own) - shift)
                        if high - low < size:
                            continue
                        same = np.zeros(high - low + 1, np.int64)
                        np.cumsum(own[shift + low : shift + high] == item[low:high], out=same[1:])
                        full = np.flatnonzero(same[size:] - same[:-size] == size) + (shift + low)
                        if len(full):
                            occurs = True
                            hit[full] += 1
                            hit[full + size] -= 1
                    if occurs:
                        seen = True
                        if p["item_id"] is not None:
                            ids.add(p["item_id"])
                n_hit = int((np.cumsum(hit) > 0).sum()) if seen else 0
                ids = sorted(ids)
                rows.append((len(own), n_hit, len(ids), ids, hashlib.sha256(",".join(ids).encode()).hexdigest()))
        columns = list(zip(*rows)) or [()] * 5
        kinds = [pa.int64()] * 3 + [pa.list_(pa.string()), pa.string()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], RESULT.names)

    columns = [c for c in docs.columns if c.lower() != out.lower()]
    keyed = docs.select(*[F.col(f"`{c}`") for c in columns]).select(F.struct("*").alias("row"))
    keyed = keyed.withColumn("text_key", F.xxhash64(F.coalesce(F.col(f"row.`{text}`"), F.lit(""))))
    joined = keyed.join(found, "text_key", "left").select("row", compare.asNondeterministic()(F.col(f"row.`{text}`"), "placed").alias("result"))
    return joined.select("row.*", F.col("result").alias(out))
