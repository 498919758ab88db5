"""Byte-level BPE: Spark folds the ranked merges of distinct words, texts look their words up.

Texts are cut into words by the usual pattern of byte-level tokenizers, in NumPy. The
distinct words of all texts, counted, go through a fold of higher-order functions
over their bytes with a literal rank map. The most frequent encoded words, at most
``dictionary``, lie in a folder that each task reads; texts with other words get those
by a join. Decoding concatenates the bytes of the tokens.
"""

from __future__ import annotations

import base64
import hashlib
import json
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm import words as W
from sightline.plans.shared import reliable, scratch_path

#: The only pattern that pieces() cuts by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded words that a task reads at most; 64-bit hash, offset and about four ids each, 120 MB.
DICTIONARY = 4_000_000
#: Buckets of the literal rank map; an entry is found by its checksum, not by a scan of all entries.
BUCKETS = 1 << 14
NONE = 2**31 - 1

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Code points with the property White_Space.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 token and rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _class_runs() -> tuple[np.ndarray, np.ndarray]:
    """Classes of all code points as run lengths."""
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    for cp in range(sys.maxunicode + 1):
        major = unicodedata.category(chr(cp))[0]
        kinds[cp] = LETTER if major == "L" else NUMBER if major == "N" else OTHER
    kinds[WHITE_SPACE] = SPACE
    starts = np.concatenate([[0], np.flatnonzero(np.diff(kinds)) + 1, [len(kinds)]])
    return kinds[starts[:-1]], np.diff(starts)


def pieces(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pattern's matches in texts (they tile the texts), and of each text its first match."""
    cp = np.frombuffer(data.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = kinds[cp]
    width = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
    width[(cp >= 0xDC80) & (cp <= 0xDCFF)] = 1  # bytes that are not UTF-8
    byte_at = np.concatenate([[0], np.cumsum(width)])
    edge = np.zeros(n + 1, dtype=bool)
    edge[np.searchsorted(byte_at, offsets)] = True
    run = np.ones(n + 1, dtype=bool)  # a run of one class begins here
    run[1:n] = (kind[1:] != kind[:-1]) | edge[1:n]
    blank = kind == SPACE
    start = run[:n].copy()
    behind = np.zeros(n, dtype=bool)  # the character before is a space of the same text
    behind[1:] = (cp[:-1] == 0x20) & ~edge[1:n]
    start[run[:n] & ~blank & behind] = False
    last = np.zeros(n, dtype=bool)  # last of a blank run that text follows
    last[:-1] = blank[:-1] & ~blank[1:] & ~edge[1:n]
    start |= last
    # contractions: an apostrophe that is a match's first character, alone in its class
    quote = np.flatnonzero((cp == 0x27) & run[:n] & run[1:] & ~behind)
    quote = quote[quote + 1 < n]
    quote = quote[~edge[quote + 1]]
    one = cp[quote + 1]
    after = np.where(quote + 2 < n, cp[np.minimum(quote + 2, n - 1)], 0)
    after = np.where(edge[np.minimum(quote + 2, n)], 0, after)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long_ = ((one == ord("r")) | (one == ord("v"))) & (after == ord("e")) | (one == ord("l")) & (after == ord("l"))
    start[quote[short | long_] + 1] = False
    rest = np.concatenate([quote[short] + 2, quote[long_] + 3])
    start[rest[rest < n]] |= kind[rest[rest < n]] == LETTER
    starts = byte_at[np.flatnonzero(start)]
    return starts, np.searchsorted(starts, offsets)


def distinct_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, hash, n): the distinct words of all texts with their numbers of occurrences."""
    runs, lengths = _class_runs()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = np.repeat(runs, lengths)
        for batch in batches:
            for _, _, data, offsets in W.slices(batch.column(0)):
                starts, _ = pieces(data, offsets, kinds)
                ends = np.append(starts[1:], len(data))[: len(starts)]
                h, at, n = np.unique(W.range_hash(W.prefix_hash(data), starts, ends), return_index=True, return_counts=True)
                sizes = ends[at] - starts[at]
                found = W.binary_array(data[_gather(starts[at], sizes)], np.concatenate([[0], np.cumsum(sizes)]))
                yield pa.RecordBatch.from_arrays([found, pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "hash", "n"])

    parts = docs.select(F.col(f"`{text}`")).mapInArrow(split, "word binary, hash long, n long")
    return parts.groupBy("word", "hash").agg(F.sum("n").alias("n"))


def rank_table(ranks: dict[bytes, int]) -> Column:
    """The ranks as one literal: an array of maps, a token's map found by its checksum."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        key = token.decode("latin-1")
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,int>>")


def fold(word: Column, ranks: dict[bytes, int]) -> Column:
    """Token ids of a word (binary): merges the pair of lowest rank, leftmost first, until no pair has a rank."""
    chars = F.decode(word, "ISO-8859-1")

    def let(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def folded(table: Column) -> Column:
        def rank(part: Column) -> Column:
            return F.coalesce(F.element_at(F.get(table, F.crc32(part) % BUCKETS), part), F.lit(NONE))

        def merge(state: Column) -> Column:
            parts, pairs = state["parts"], state["pairs"]
            best = F.array_min(pairs)

            def at(p: Column) -> Column:
                joined = F.concat(F.get(parts, p - 1), F.get(parts, p))

                def apply(new: Column) -> Column:
                    kept = F.concat(F.slice(parts, F.lit(1), p - 1), F.array(new), F.slice(parts, p + 2, F.size(parts)))
                    left = F.when(p > 1, F.array(rank(F.concat(F.get(parts, p - 2), new)))).otherwise(F.array().cast("array<int>"))
                    right = F.when(p < F.size(pairs), F.array(rank(F.concat(new, F.get(parts, p + 1))))).otherwise(F.array().cast("array<int>"))
                    ranked = F.concat(
                        F.slice(pairs, F.lit(1), F.greatest(p - 2, F.lit(0))), left, right, F.slice(pairs, p + 2, F.size(pairs))
                    )
                    return F.struct(kept.alias("parts"), ranked.alias("pairs"))

                return let(joined, apply)

            merged = let(F.array_position(pairs, best).cast("int"), at)
            return F.when(F.coalesce(best, F.lit(NONE)) == NONE, state).otherwise(merged)

        single = F.transform(F.sequence(F.lit(1), F.length(chars)), lambda i: F.substring(chars, i, F.lit(1)))
        pairs = F.transform(
            F.when(F.length(chars) > 1, F.sequence(F.lit(1), F.length(chars) - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: rank(F.substring(chars, i, F.lit(2))),
        )
        start = F.struct(single.alias("parts"), pairs.alias("pairs"))
        end = F.aggregate(F.sequence(F.lit(1), F.length(chars)), start, lambda state, _: merge(state), lambda s: F.transform(s["parts"], rank))
        return F.when(rank(chars) != NONE, F.array(rank(chars))).otherwise(end)

    # the literal stands in the plan once, as a lambda's variable; written out at each use, its text fills the driver
    return let(rank_table(ranks), folded)


@dataclass
class Encoder:
    """All words of a corpus encoded, and the folder with the most frequent ones in the order of their hashes."""

    words: DataFrame  # word, hash, n, ids
    folder: str
    complete: bool
    runs: tuple[np.ndarray, np.ndarray]


def encoder(docs: DataFrame, ranks: dict[bytes, int], text: str = "text", dictionary: int = DICTIONARY) -> Encoder:
    """Encode the distinct words of ``docs``; at most ``dictionary`` of them, the most frequent, go to every task."""
    coded = reliable(distinct_words(docs, text).withColumn("ids", fold(F.col("word"), ranks)))
    total, floor = coded.count(), 0
    if total > dictionary:
        floor, held = NONE, 0
        for row in coded.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
            held += row["count"]
            if held > dictionary:
                break
            floor = row["n"]
    folder = scratch_path(docs.sparkSession, "words")
    coded.where(F.col("n") >= floor).select("hash", "ids").orderBy("hash").write.parquet(folder)
    return Encoder(coded, folder, total <= dictionary, _class_runs())


def _dictionary(folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, offsets and ids of the words in a folder; each task reads it from the shared storage."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    store, base = fs.FileSystem.from_uri(folder)
    names = sorted(f.path for f in store.get_file_info(fs.FileSelector(base)) if f.base_name.startswith("part-"))
    hashes, counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint16)]
    for name in names:
        with store.open_input_file(name) as f:
            part = pq.read_table(f, use_threads=False)
        hashes.append(part["hash"].to_numpy())
        counts.append(pa.compute.list_value_length(part["ids"]).to_numpy())
        own = pa.compute.list_flatten(part["ids"]).to_numpy()
        ids.append(own.astype(np.uint16) if not len(own) or own.max() < 1 << 16 else own)  # half the memory where ranks allow
        del part, own
    where = np.zeros(sum(map(len, counts)) + 1, np.int32)  # fewer than 2^31 ids by the bound on words
    np.cumsum(np.concatenate(counts), out=where[1:])
    return np.concatenate(hashes), where, np.concatenate(ids)


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of ranges put one behind the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


CODED = T.StructType(
    [
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("missing", T.ArrayType(T.BinaryType())),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ]
)
CODED_ARROW = pa.struct(
    [("ids", pa.list_(pa.int32())), ("missing", pa.list_(pa.binary())), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def _token_bytes(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes in the order of ids, and where each begins."""
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    return np.frombuffer(b"".join(by_id), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in by_id])])


def _digests(data: bytes, ends: np.ndarray) -> list[str]:
    return [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _encode(texts: pa.Array, extra: pa.Array | None, flat, kinds: np.ndarray, tokens_of, keep: bool) -> pa.Array:
    """Coded texts, some at a time; the ids themselves only if they are to be kept."""
    hashes, where, ids = flat
    piece, piece_at = tokens_of
    out = []
    for a, b, data, offsets in W.slices(texts):
        starts, first = pieces(data, offsets, kinds)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        own = W.range_hash(W.prefix_hash(data), starts, ends).view(np.int64)
        at = np.searchsorted(hashes, own)
        at[at == len(hashes)] = 0
        found = hashes[at] == own if len(hashes) else np.zeros(len(own), bool)
        lengths = np.where(found, where[at + 1] - where[at], 0) if len(hashes) else np.zeros(len(own), np.int64)
        begin = where[at] if len(hashes) else lengths
        pool = ids
        lost = np.flatnonzero(~found)
        raw = data.tobytes() if len(lost) else b""
        missing: list[list[bytes]] = [[] for _ in range(b - a)]
        if len(lost):
            doc = np.searchsorted(first, lost, "right") - 1
            added, known = [], {}
            size = len(ids)
            for i, d in zip(lost.tolist(), doc.tolist()):
                word = raw[starts[i] : ends[i]]
                if extra is None:
                    missing[d].append(word)
                    continue
                if d not in known:
                    known[d] = {e["word"]: e["ids"] for e in extra[a + d].as_py() or ()}
                begin[i], lengths[i] = size, len(known[d][word])
                added += known[d][word]
                size += lengths[i]
            pool = np.concatenate([ids.astype(np.int32), np.array(added, np.int32)])
        tokens = pool[_gather(begin, lengths)]
        ends_of = np.concatenate([[0], np.cumsum(lengths)])[first]
        sizes = piece_at[tokens + np.int64(1)] - piece_at[tokens]
        decoded = piece[_gather(piece_at[tokens], sizes)].tobytes()
        kept = pa.ListArray.from_arrays(pa.array(ends_of.astype(np.int32)), pa.array(tokens.astype(np.int32))) if keep else pa.nulls(b - a, pa.list_(pa.int32()))
        columns = [
            kept, pa.array([sorted(set(m)) for m in missing], pa.list_(pa.binary())), pa.array(np.diff(ends_of)),
            pa.array(_digests(tokens.astype("<u4").tobytes(), 4 * ends_of)), pa.array(_digests(decoded, np.concatenate([[0], np.cumsum(sizes)])[ends_of])),
        ]
        out.append(pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, CODED_ARROW)], CODED_ARROW.names))
    return pa.concat_arrays(out) if out else pa.array([], CODED_ARROW)


def encode(
    docs: DataFrame, ranks: dict[bytes, int], text: str = "text", out: str = "ids", dictionary: int = DICTIONARY, keep_ids: bool = True
) -> DataFrame:
    """Append struct ``out`` of every whole text: token ids, n_tokens, ids_sha256 and decoded_sha256.

    ids_sha256 is of the ids as little-endian unsigned 32-bit integers; decoded_sha256
    of the bytes that the ids decode to, piece by piece. Without ``keep_ids``, ids is
    null, for those who need the digests only.

    Each match of PATTERN is encoded by itself and no special token exists, as with
    a rank-file tokenizer. Null and empty texts have no ids. Every row gives one
    row, repeated rows alike; a column already named ``out`` is replaced. Every byte
    must have a rank.
    """
    if any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError("the ranks lack single bytes")
    e = encoder(docs, ranks, text, dictionary)
    folder, (runs, lengths), tokens_of = e.folder, e.runs, _token_bytes(ranks)

    @F.arrow_udf(CODED)
    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, kinds = _dictionary(folder), np.repeat(runs, lengths)
        for texts in batches:
            yield _encode(texts, None, words, kinds, tokens_of, keep_ids)

    @F.arrow_udf(CODED)
    def completed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        words, kinds = _dictionary(folder), np.repeat(runs, lengths)
        for texts, extra in batches:
            yield _encode(texts, extra, words, kinds, tokens_of, keep_ids)

    columns = [c for c in docs.columns if c.lower() != out.lower()]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    coded = rows.withColumn("coded", known.asNondeterministic()("text"))
    if not e.complete:
        key = F.xxhash64(F.coalesce("text", F.lit("")))
        asked = coded.where(F.size("coded.missing") > 0).select(key.alias("key"), F.explode("coded.missing").alias("word")).distinct()
        extra = asked.join(e.words.select("word", "ids"), "word").groupBy("key").agg(F.collect_list(F.struct("word", "ids")).alias("extra"))
        coded = rows.withColumn("key", key).join(extra, "key", "left").withColumn("coded", completed.asNondeterministic()("text", "extra"))
    fields = [f"coded.{f}" for f in ("ids", "n_tokens", "ids_sha256", "decoded_sha256")]
    return coded.select("row.*", F.struct(*fields).alias(out))


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """Bytes of token ids, piece by piece; empty for null or no ids. An id without a token is an error."""
    data, where = _token_bytes(ranks)
    size = len(where) - 1

    @F.arrow_udf(T.BinaryType())
    def joined(lists: pa.Array) -> pa.Array:
        sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        tokens = pa.compute.list_flatten(lists).to_numpy(zero_copy_only=False)
        if len(tokens) and (tokens.min() < 0 or tokens.max() >= size):
            raise ValueError("an id has no token")
        parts, at = [], 0
        while at < len(lists):  # some lists at a time
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + W.SLICE // 8, "right")) - 1)
            own = tokens[ends[at] : ends[to]]
            lengths = where[own + 1] - where[own]
            cuts = np.concatenate([[0], np.cumsum(lengths)])[ends[at : to + 1] - ends[at]]
            parts.append(W.binary_array(data[_gather(where[own], lengths)], cuts))
            at = to
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    return joined.asNondeterministic()(ids)
