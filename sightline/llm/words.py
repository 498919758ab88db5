"""Vectorised words, lines and hashes of whole texts in Arrow batches.

Texts are taken as UTF-8 bytes; every class of separators used here is ASCII, so
bytes and code points split alike. Hashes are 64-bit polynomials over random byte
values, mixed at the end: equal words have equal hashes, different ones differ but
for a chance of about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: list[np.ndarray] = []


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << n.bit_length()
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = made
    return _powers[0], _powers[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, at least n of each."""
    return _table(n)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial of the bytes; range_hash cuts hashes of ranges from it."""
    power, _ = _table(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * power[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inverse = _table(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _BASE)


def word_table(separators: bytes, lower: bool) -> np.ndarray:
    """Byte to folded byte; 0 marks a separator."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[list(separators)] = 0
    return table


#: Words between ASCII white space, as they are and with A-Z in lower case.
PLAIN = word_table(b"\x20\x09\x0a\x0b\x0c\x0d", lower=False)
LOWER = word_table(b"\x20\x09\x0a\x0b\x0c\x0d", lower=True)
#: Runs of a-z, 0-9 and everything outside ASCII, A-Z in lower case.
ALNUM = word_table(bytes(i for i in range(128) if not chr(i).isalnum()), lower=True)


@dataclass
class Words:
    """Words of some texts: byte ranges in data, hashes, and where each text's words begin."""

    data: np.ndarray
    offsets: np.ndarray  # of texts in data, one more than texts
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # of each text, index of its first word, one more than texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def tokenize(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    folded = table[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    inside = folded != 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    hashes = range_hash(prefix_hash(folded), starts, ends)
    return Words(data, offsets, starts, ends, hashes, np.searchsorted(starts, offsets))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array and the offsets of its values; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, where, values = texts.buffers()
    n = len(texts)
    if n == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if texts.null_count:  # bytes under a null are not text
        missing = texts.is_null().to_numpy(zero_copy_only=False)
        lengths = np.diff(offsets)
        if lengths[missing].any():
            data = data[np.repeat(~missing, lengths)]
            offsets = np.concatenate([[0], np.cumsum(np.where(missing, 0, lengths))])
    return data, offsets


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of consecutive texts of about ``limit`` bytes together."""
    data, offsets = bytes_of(texts)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def window_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``size`` words inside one text, and their first words' indices."""
    if size > len(words.hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = np.repeat(words.first[1:], words.counts)
    at = np.flatnonzero(np.arange(len(words.hashes)) + size <= last)
    return combine(words.hashes[at + j] for j in range(size)), at


def combine(parts) -> np.ndarray:
    """Hash of a sequence of hashes, elementwise over arrays."""
    out = None
    for p in parts:
        out = mix(p) if out is None else mix(out * _BASE + p)
    return out


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]
    )


def per_text(fn: Callable[[np.ndarray, np.ndarray], list[pa.Array]], fields: list[tuple[str, T.DataType]], text: Column) -> Column:
    """A struct column of ``fields`` computed from whole texts.

    fn gets the bytes and offsets of a slice of texts and returns one Arrow array
    for each field. Rows never meet, so any number of equal or null rows is fine.
    """
    kind = T.StructType([T.StructField(n, t) for n, t in fields])
    names = [n for n, _ in fields]

    @F.arrow_udf(kind)
    def column(texts: pa.Array) -> pa.Array:
        parts = [pa.StructArray.from_arrays(fn(data, offsets), names) for _, _, data, offsets in slices(texts)]
        if not parts:
            from pyspark.sql.pandas.types import to_arrow_type

            return pa.array([], to_arrow_type(kind))
        return pa.concat_arrays(parts)

    return column.asNondeterministic()(text)  # else the optimizer may run it once for each use
