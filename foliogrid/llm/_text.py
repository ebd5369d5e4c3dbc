"""Words, word hashes and word n-grams of Arrow text columns, vectorised over their bytes.

All word patterns in use are classes over ASCII; every byte of a longer UTF-8 character is a word
byte, so words of characters are runs of bytes. Hashes are 64-bit sums over bytes with a random value
for each byte, times a power of an odd base, then mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, StructField, StructType

from foliogrid.session import importable

U = np.uint64
#: Bytes of rows that Spark hands to a Python worker at once; a longer row comes alone.
BATCH = "4m"
#: Bytes that one step works on; a longer row is a step of its own, hashed in blocks.
STEP = 1 << 19
BLOCK = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """True for bytes outside the spans (ends included)."""
    out = np.ones(256, bool)
    for a, b in spans:
        out[a : b + 1] = False
    return out


#: ``[^\x20\x09-\x0D]+``
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, after lower-casing A-Z
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
ALNUM_ANY = ALNUM.copy()
ALNUM_ANY[65:91] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_VALUES = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_VALUES_LOWER = _VALUES[LOWER]
with np.errstate(over="ignore"):
    _POW = np.cumprod(np.concatenate([[U(1)], np.full(BLOCK, U(BASE))]))
    _INV = np.cumprod(np.concatenate([[U(1)], np.full(BLOCK, U(pow(BASE, -1, 1 << 64)))]))


@dataclass
class Words:
    """Words of rows: byte bounds, hashes, and the first word of each row (one longer than rows)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def text_steps(column: pa.Array, step: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) of a text column, some rows at a time. Null: no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + step, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def split_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = True, hashed: bool = True) -> Words:
    """The runs of ``kind`` bytes in each row."""
    m = kind[data]
    n = len(m)
    inner = offsets[(offsets > 0) & (offsets < n)]
    s, e = m.copy(), m.copy()
    s[1:] &= ~m[:-1]
    e[:-1] &= ~m[1:]
    s[inner] = m[inner]
    e[inner - 1] = m[inner - 1]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    hashes = hash_spans(data, starts, ends, lower) if hashed else np.zeros(0, U)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans in ascending order that don't overlap."""
    out = np.empty(len(starts), U)
    values = _VALUES_LOWER if lower else _VALUES
    i, n = 0, len(starts)
    while i < n:
        a = starts[i]
        j = int(np.searchsorted(ends, a + BLOCK, "right"))
        if j <= i:  # one span longer than a block: Horner over its blocks
            h, b = 0, int(ends[i])
            for p in range(int(a), b, BLOCK):
                part = values[data[p : min(b, p + BLOCK)]]
                h = (h * int(_POW[len(part)]) + int(np.sum(part * _POW[: len(part)], dtype=U))) % (1 << 64)
            out[i] = U(h)
            i += 1
            continue
        c = np.empty(ends[j - 1] - a + 1, U)
        c[0] = 0
        part = values[data[a : ends[j - 1]]]
        part *= _POW[: len(part)]
        np.cumsum(part, out=c[1:])
        x, y = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (c[y] - c[x]) * _INV[x]
        i = j
    return mix(out + (ends - starts).astype(U) * U(0x632BE59BD9B4E019))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words from each word on, regardless of rows; shorter by k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    h = np.full(n, U(k))
    for i in range(k):
        h *= U(0xA24BAED4963EE407)
        h += hashes[i : i + n]
        h ^= h >> U(29)
    return mix(h)


def inside(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """For each word at which k words start: whether they stay in its row."""
    n = max(0, total - k + 1)
    end = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + k <= end


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def wider(schema: StructType, **fields: str) -> StructType:
    """A copy of the schema with further fields."""
    return StructType([*schema.fields, *(StructField(name, DataType.fromDDL(kind)) for name, kind in fields.items())])


def release() -> None:
    """Give memory that is free back to the system: workers live on from task to task, and what one step needed most would stay theirs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` over texts, in batches of bounded size: rows may be long."""
    importable(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(released, schema)
