"""Token ids as binary files with Elias-Fano document boundaries.

Format: a folder of Parquet files, one row per segment of consecutive documents. A segment holds

* ``shard, segment``: its place; segments in this order hold all documents in ascending id;
* ``doc_ids``: ids of its documents;
* ``ids``: all token ids, one after the other, little-endian, 2 bytes each if the vocabulary has at most 65536 ids, else 4 (``width``);
* ``n_docs, n_ids``: documents and ids in it;
* ``low_bits, low, high, hints``: Elias-Fano code of the n_docs + 1 boundaries: the low bits packed, the
  high bits in unary, and the place of every 64th one of ``high``, from which select starts.

Spark's own writer makes the files, so a task that is lost is run again and leaves no half-written
segment, and any store that Spark reaches will do. A segment closes at ``SEGMENT`` ids or after the document
that passes it.

Documents are found through select alone: a reader decodes the bounds of those that it asks for, never a segment's whole code.

Defined results: a null text is an empty one and has only the end id; rows with equal ids stand next to
each other in order of their texts' hashes (``xxhash64``), then texts; null ids come first; an empty table gives no segment.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliogrid.llm import _text as T
from foliogrid.session import cut, small

SEGMENT = 1 << 20
HINT = 64
#: Words whose ids a worker remembers (some 40 bytes each); past it, it starts anew.
REMEMBERED = 500_000
_STEP = 1 << 20


class EliasFano:
    """A monotone sequence in about 2 + log2(last / n) bits a value."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, hints: bytes):
        self.n, self.low_bits, self.low, self.high = n, low_bits, np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.hints = np.frombuffer(hints, "<u4")

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
        """(low_bits, low, high, hints) of ascending values from 0 on."""
        values = values.astype(np.int64)
        n = len(values)
        bits = max(0, int(values[-1] // n).bit_length() - 1) if n else 0
        low = ((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8)
        ones = (values >> bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return bits, np.packbits(low.reshape(-1), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::HINT].astype("<u4").tobytes()

    def select(self, i: int) -> int:
        """Value i: from the last hint before it, by the ones of each byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.hints[i // HINT]), i % HINT
        byte = place // 8
        left += int(np.unpackbits(self.high[byte : byte + 1], bitorder="little")[: place % 8].sum())
        while (ones := int(self.high[byte]).bit_count()) <= left:
            left -= ones
            byte += 1
        place = byte * 8 + int(np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))[left])
        low = 0
        for b in range(self.low_bits):
            at = i * self.low_bits + b
            low |= ((int(self.low[at // 8]) >> (at % 8)) & 1) << b
        return ((place - i) << self.low_bits) | low

    def span(self, a: int, b: int) -> np.ndarray:
        """Values a to b - 1: select for all of them, reading the high bits from the hint before a to the one behind b alone."""
        if not 0 <= a <= b <= self.n:
            raise IndexError((a, b))
        if a == b:
            return np.zeros(0, np.int64)
        first, last = a // HINT, -(-b // HINT)
        begin = int(self.hints[first]) // 8
        end = int(self.hints[last]) // 8 + 1 if last < len(self.hints) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin:end], bitorder="little")) + begin * 8
        skipped = int(np.searchsorted(ones, int(self.hints[first])))
        ones = ones[skipped + a - first * HINT :][: b - a]
        bit, count = a * self.low_bits, (b - a) * self.low_bits
        low = np.unpackbits(self.low[bit // 8 : -(-(bit + count) // 8)], bitorder="little")[bit % 8 :][:count].reshape(b - a, self.low_bits).astype(np.int64)
        return ((ones - np.arange(a, b)) << self.low_bits) + (low << np.arange(self.low_bits)).sum(axis=1)

    def all(self) -> np.ndarray:
        return self.span(0, self.n)


#: A pre-tokenizer's pattern, which ends a piece between an ASCII letter and other ASCII characters but digits, either way round but behind "'".
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes by kind: white space, letter, other character of ASCII, "'", what has no sure bound.
_KIND = np.full(256, 4, np.uint8)
_KIND[0x21:0x30] = _KIND[0x3A:0x41] = _KIND[0x5B:0x61] = _KIND[0x7B:0x7F] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
_KIND[0x27], _KIND[0x20], _KIND[0x09:0x0E] = 3, 0, 0


def _pieces(data: np.ndarray, offsets: np.ndarray, lower: bool) -> T.Words:
    """Words cut further where any tokenizer of ``_PIECES`` ends a piece."""
    kind = _KIND[data]
    n = len(kind)
    last, now = kind[:-1], kind[1:]
    cut = np.zeros(n + 1, bool)  # a bound before this byte
    cut[1:n] = ((last == 1) & ((now == 2) | (now == 3))) | ((last == 2) & (now == 1))
    cut[offsets] = True
    word = kind != 0
    s, e = word.copy(), word.copy()
    s[1:] &= cut[1:n] | ~word[:-1]
    e[:-1] &= cut[1:n] | ~word[1:]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return T.Words(data, starts, ends, T.hash_spans(data, starts, ends, lower), np.searchsorted(starts, offsets))


class Encoder:
    """Token ids of texts; tokenizers that drop white space are asked once for each distinct word."""

    def __init__(self, path: str, by_word: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = by_word
        made = json.loads(self.tokenizer.to_str())
        steps = (made.get("normalizer") or {}).get("normalizers") or [made.get("normalizer") or {}]
        self.lower = any(x.get("type") == "Lowercase" for x in steps)
        splits = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [made.get("pre_tokenizer") or {}]
        suffix = made["model"].get("end_of_word_suffix")
        self.word_end = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        if suffix:
            self.word_end[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        self.cuts = (splits[0].get("pattern") or {}).get("Regex") == _PIECES
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        mark = next((t.content for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special and not t.normalized), None)
        self.mark, self.mark_id = mark, self.tokenizer.token_to_id(mark) if mark else None
        self.forget()

    def forget(self) -> None:
        # words' hashes, ascending, and their places in what follows
        self.keys, self.place = np.zeros(0, T.U), np.zeros(0, np.int64)
        self.counts, self.begin = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint16 if self.size <= 1 << 16 else np.uint32)

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _ask(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and how many each has."""
        texts = [w.decode() for w in words]
        plain = [t.isalpha() and (t.isascii() or unicodedata.normalize("NFC", t).lower().isalpha()) for t in texts] if self.cuts and self.word_end.any() else [False] * len(words)
        # words of letters alone are a piece each and show in the ids where they end
        counts, flat = np.zeros(len(words), np.int64), np.zeros(0, np.uint32)
        letters = np.flatnonzero(plain)
        if len(letters):
            flat = np.array(self._plain(" ".join(texts[i] for i in letters)), np.uint32)
            ends = np.flatnonzero(self.word_end[flat])
            if len(ends) == len(letters) and ends[-1] == len(flat) - 1:
                counts[letters] = np.diff(ends, prepend=-1)
            else:
                letters, flat = letters[:0], flat[:0]
        rest = np.setdiff1d(np.arange(len(words)), letters, assume_unique=True)
        if len(rest):
            other, n = self._ask_apart([words[i] for i in rest])
            counts[rest] = n
            own = np.zeros(len(words), bool)
            own[rest] = True
            out = np.empty(len(flat) + len(other), np.uint32)
            side = np.repeat(own, counts)
            out[side], out[~side] = other, flat
            return out, counts
        return flat, counts

    def _ask_apart(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and how many each has: many words in one text with a special token between them."""
        mark = self.mark.encode() if self.mark else b""
        odd = {i for i, w in enumerate(words) if not mark or mark in w}
        out, counts = [], np.zeros(len(words), np.int64)
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            if not any(i + j in odd for j in range(len(part))):
                ids = np.array(self._plain((b" " + mark + b" ").join(part).decode()), np.uint32)
                ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
                if len(ends) != len(part):
                    raise ValueError("the special token doesn't separate words")
                counts[i : i + len(part)] = np.diff(ends, prepend=-1) - 1
                out.append(ids[ids != self.mark_id])
            else:
                for j, w in enumerate(part):
                    ids = np.array(self._plain(w.decode()), np.uint32)
                    counts[i + j] = len(ids)
                    out.append(ids)
        return np.concatenate(out), counts

    def _places(self, own: np.ndarray, word) -> np.ndarray:
        """Where the ids of words with these hashes, ascending, are kept; new ones are asked for, ``word(i)`` being the i-th."""
        at = np.searchsorted(self.keys, own)
        known = np.zeros(len(own), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == own[at < len(self.keys)]
        new = np.flatnonzero(~known)
        if len(new) and len(self.keys) and len(self.keys) + len(new) > REMEMBERED:
            self.forget()
            return self._places(own, word)
        out = np.zeros(len(own), np.int64)
        out[known] = self.place[at[known]]
        if len(new):
            ids, counts = self._ask([word(i) for i in new])
            out[new] = len(self.counts) + np.arange(len(new))
            self.keys, self.place = np.insert(self.keys, at[new], own[new]), np.insert(self.place, at[new], out[new])
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.flat = np.concatenate([self.flat, ids.astype(self.flat.dtype)])
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each with the end id behind it; the rows' bounds in them."""
        rows = len(offsets) - 1
        if not self.by_word:
            raw = data.tobytes()
            each = self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], add_special_tokens=False)
            parts = [np.array([*e.ids, end_id], np.uint32) for e in each]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        marked = self.mark is not None and self.mark.encode() in data.tobytes()
        special = marked or b"<|" in data.tobytes()
        # special tokens stand for themselves, in their own spelling
        w = _pieces(data, offsets, self.lower) if self.cuts and not special else T.split_words(data, offsets, T.SPACED, lower=self.lower and not special)
        own, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
        at = self._places(own, lambda i: w.word(first[i]))[inverse]
        count, begin = self.counts[at], self.begin[at]
        # place of each word's ids: an end id follows each row
        row = np.repeat(np.arange(rows), np.diff(w.first))
        start = np.cumsum(count) - count + row
        before = np.concatenate([[0], np.cumsum(count)])[w.first]
        bounds = before + np.arange(rows + 1)
        out = np.full(bounds[-1], end_id, np.uint32)
        ids = np.arange(int(before[-1]))
        first_id = np.cumsum(count) - count
        out[ids + np.repeat(start - first_id, count)] = self.flat[ids + np.repeat(begin - first_id, count)]
        return out, bounds


_encoders: dict[tuple[str, bool], Encoder] = {}


def _encoder(path: str, by_word: bool) -> Encoder:
    if (path, by_word) not in _encoders:
        _encoders[path, by_word] = Encoder(path, by_word)
    return _encoders[path, by_word]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", by_word: bool = True, segment: int = SEGMENT) -> None:
    """Write all documents' ids under ``path``, in ascending id.

    ``by_word`` is for tokenizers that drop white space, for which a text's ids are those of its words.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"shard int, segment int, doc_ids array<{kind}>, n_docs long, n_ids long, width int, ids binary, low_bits int, low binary, high binary, hints binary"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, number = _encoder(tokenizer, by_word), TaskContext.get().partitionId(), 0
        width = 2 if coder.size <= 1 << 16 else 4
        held_ids: list[np.ndarray] = []
        held_docs: list[pa.Array] = []
        sizes: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            ids, each = np.concatenate(held_ids), np.concatenate(sizes)
            own = pa.concat_arrays(held_docs)
            bits, low, high, hints = EliasFano.encode(np.concatenate([[0], np.cumsum(each)]))
            raw = ids.astype("<u2" if width == 2 else "<u4").tobytes()
            row = [[shard], [number], None, [len(each)], [len(ids)], [width], [raw], [bits], [low], [high], [hints]]
            kinds = [pa.int32(), pa.int32(), None, pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            arrays = [pa.array(v, k) if v else pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own) for v, k in zip(row, kinds, strict=True)]
            held_ids.clear(), held_docs.clear(), sizes.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for i, j, data, offsets in T.text_steps(batch.column(1), _STEP):
                ids, bounds = coder.encode(data, offsets, end_id)
                a = 0
                while a < j - i:
                    room = segment - sum(map(len, held_ids))
                    b = min(j - i, int(np.searchsorted(bounds, bounds[a] + room, "left")))
                    b = max(b, a + 1)
                    held_ids.append(ids[bounds[a] : bounds[b]])
                    held_docs.append(batch.column(0).slice(i + a, b - a))
                    sizes.append(np.diff(bounds[a : b + 1]))
                    a = b
                    if sum(map(len, held_ids)) >= segment:
                        yield close()
                        number += 1
        if held_ids:
            yield close()

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    T.mapped(slim.repartitionByRange(*order).sortWithinPartitions(*order, "text"), run, schema).write.parquet(path)


def _placed(files: DataFrame) -> DataFrame:
    """(a, b, base): the ids before each segment (shard a, segment b)."""
    sums = files.groupBy("shard").agg(F.sum("n_ids").alias("sum"))
    shards = sums.select(F.col("shard").alias("s"), F.expr("sum(sum) over (order by shard) - sum").alias("shard_base"))
    bases = files.select(F.col("shard").alias("a"), F.col("segment").alias("b"), F.expr("sum(n_ids) over (partition by shard order by segment) - n_ids").alias("own_base"))
    return bases.join(shards, F.col("a") == F.col("s")).select("a", "b", (F.col("own_base") + F.col("shard_base")).alias("base"))


def _id_kind(files: DataFrame) -> str:
    return files.schema["doc_ids"].dataType.elementType.simpleString()


#: Documents whose bounds are selected at once.
_AT_ONCE = 512


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, EliasFano, np.ndarray]]:
    """The columns, the bounds' code and the ids of each segment."""
    for batch in batches:
        for r in range(batch.num_rows):
            row = {k: batch.column(k)[r] for k in batch.schema.names}
            code = EliasFano(row["n_docs"].as_py() + 1, row["low_bits"].as_py(), row["low"].as_py(), row["high"].as_py(), row["hints"].as_py())
            yield row, code, np.frombuffer(row["ids"].as_buffer(), "<u2" if row["width"].as_py() == 2 else "<u4")


def _with_bases(files: DataFrame) -> DataFrame:
    return files.join(small(_placed(files)), (F.col("shard") == F.col("a")) & (F.col("segment") == F.col("b"))).drop("a", "b")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document's ids and the ids before it, read from the files."""
    files = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, code, raw in _segments(batches):
            for a in range(0, code.n - 1, _AT_ONCE):
                b = min(code.n - 1, a + _AT_ONCE)
                bounds = code.span(a, b + 1)
                ids = raw[bounds[0] : bounds[-1]].astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"].values.slice(a, b - a), pa.array(bounds[:-1] + row["base"].as_py()), pa.array(np.diff(bounds)), T.list_array(pa.array(ids), bounds - bounds[0]).cast(pa.list_(pa.int64()))],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return T.mapped(_with_bases(files), run, f"doc_id {_id_kind(files)}, start long, n_tokens long, ids array<long>")


def find_tokens(spark: SparkSession, path: str, doc_ids: list) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of some documents: two selects for each, in the segments that have them; others stay closed."""
    files = spark.read.parquet(path)
    kind = _id_kind(files)
    wanted = F.array(*[F.lit(x).cast(kind) for x in doc_ids])
    known = set(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, code, raw in _segments(batches):
            at = [i for i, x in enumerate(row["doc_ids"].values.to_pylist()) if x in known]
            spans = [(code.select(i), code.select(i + 1)) for i in at]
            yield pa.RecordBatch.from_arrays(
                [row["doc_ids"].values.take(pa.array(at, pa.int64())), pa.array([a + row["base"].as_py() for a, _ in spans], pa.int64()), pa.array([b - a for a, b in spans], pa.int64()), pa.array([raw[a:b].tolist() for a, b in spans], pa.list_(pa.int64()))],
                ["doc_id", "start", "n_tokens", "ids"],
            )

    return T.mapped(_with_bases(files).where(F.arrays_overlap("doc_ids", wanted)), run, f"doc_id {kind}, start long, n_tokens long, ids array<long>")


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in the files; crc32 is over ids of 4 bytes."""
    files = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, code, raw in _segments(batches):
            for a in range(0, code.n - 1, _AT_ONCE):
                b = min(code.n - 1, a + _AT_ONCE)
                bounds = code.span(a, b + 1)
                own = memoryview(raw[bounds[0] : bounds[-1]].astype("<u4")).cast("B")
                at = (bounds - bounds[0]) * 4
                crc = [zlib.crc32(own[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"].values.slice(a, b - a), pa.array(np.full(b - a, row["shard"].as_py(), np.int32)), pa.array(np.full(b - a, row["segment"].as_py(), np.int32)), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                    ["doc_id", "shard", "segment", "within", "n_tokens", "ids_crc32"],
                )

    each = T.mapped(files, run, f"doc_id {_id_kind(files)}, shard int, segment int, within long, n_tokens long, ids_crc32 long")
    return each.join(small(_placed(files)), (F.col("shard") == F.col("a")) & (F.col("segment") == F.col("b"))).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the folder that executors share."""
    cut(spark.range(1))  # sets the folder where it is unset
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
