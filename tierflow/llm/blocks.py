"""Documents in blocks, and the exchange that finds hashes which occur more than once.

A block holds some MB of consecutive documents as one compressed row. It is the unit of work of
the text operators: numpy handles a whole block at once, copies within it are merged before
anything is shuffled, and a hash travels as 8 or 12 bytes of a sorted array instead of a row.
So a hash that is common to very many documents reaches its reducer once per block at most.

Blocks are written to the shared folder once. That fixes their numbers, so every later pass sees
the same documents under the same number even when an executor is lost and a task runs again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierflow.session import materialize

# Text per block. A document that is longer gets a block of its own.
BLOCK_BYTES = 2 << 20
# Hashes per reducer group: 8 MB, or 12 MB of the wide kind.
KEYS_PER_BUCKET = 1 << 20
# Words of more bytes than this are hashed one by one: in long strings, polynomials modulo 2^64 can be
# made to collide whatever their base.
LONG_WORD = 64
# Bytes that are hashed at once; keeps the arrays of one step within the processor's cache.
SLAB = 1 << 19

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_2 = U(0xD6E8FEB86659FD93)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
INVERSE_2 = U(pow(int(BASE_2), -1, 1 << 64))
BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=U)
# The separators of words: space and the five control characters from tab to carriage return.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Bytes of a wide key: 96 bits, so that no two of 10^13 different strings are likely to meet.
WIDE = 12
KEYS_SCHEMA = "bucket int, block long, keys binary, counts binary"
PLACES_SCHEMA = KEYS_SCHEMA + ", starts binary"
MARKS_SCHEMA = "block long, bucket int, marks binary"


# ---- packing -------------------------------------------------------------------------------


def pack(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "text"), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write documents as blocks: (block, n_docs, n_bytes, payload). The last column is the text."""
    text = columns[-1]
    wanted = docs.select(*columns)
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("n_docs", T.LongType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("payload", T.BinaryType()),
        ]
    )

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 22
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            lengths = np.asarray(column.cast(pa.binary()).fill_null(b"").to_numpy(zero_copy_only=False), dtype=object)
            ends = np.cumsum([len(x) + 16 for x in lengths]) if len(lengths) else np.empty(0, np.int64)
            begin = 0
            while begin < batch.num_rows:
                before = int(ends[begin - 1]) if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, before + block_bytes - size, "right")))
                if held and end == begin + 1 and ends[end - 1] - before > block_bytes - size:
                    yield block_row(number, held, size)
                    number, held, size = number + 1, [], 0
                    continue
                held.append(batch.slice(begin, end - begin))
                size += int(ends[end - 1]) - before
                begin = end
                if size >= block_bytes:
                    yield block_row(number, held, size)
                    number, held, size = number + 1, [], 0
        if held:
            yield block_row(number, held, size)

    return materialize(wanted.mapInArrow(fill, schema), "blocks")


def slices(batches: Iterable[pa.RecordBatch], text: int, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of some batches in slices of bounded text."""
    for batch in batches:
        sizes = np.cumsum([0, *(len(x or b"") for x in batch.column(text).cast(pa.binary()).to_pylist())])
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(sizes, sizes[begin] + most, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def block_row(number: int, held: list[pa.RecordBatch], size: int) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))
    table = pa.Table.from_batches(held).combine_chunks()
    with pa.ipc.new_stream(sink, table.schema, options=options) as writer:
        writer.write_table(table)
    return pa.record_batch(
        {
            "block": pa.array([number], pa.int64()),
            "n_docs": pa.array([table.num_rows], pa.int64()),
            "n_bytes": pa.array([size], pa.int64()),
            "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
        }
    )


def unpack(payload) -> pa.Table:
    """The documents of a block."""
    data = payload.as_buffer() if isinstance(payload, pa.BinaryScalar) else payload
    return pa.ipc.open_stream(data).read_all()


def total_bytes(blocks: DataFrame) -> int:
    return blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]


def buckets_for(keys: float, per_bucket: int = KEYS_PER_BUCKET) -> int:
    """Reducer groups for so many keys: their number follows the input, their size does not."""
    return max(1, int(-(-keys // per_bucket)))


# ---- text in arrays -------------------------------------------------------------------------


@dataclass
class Text:
    """The texts of a block in one byte array; each text is followed by one space."""

    data: np.ndarray
    begin: np.ndarray  # where a text begins
    end: np.ndarray  # where it ends, exclusive

    @classmethod
    def of(cls, texts: pa.ChunkedArray | pa.Array) -> Text:
        """NULL counts as an empty text."""
        values = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
        data = np.frombuffer(b" ".join([b"", *values, b""]), np.uint8) if values else np.zeros(0, np.uint8)
        lengths = np.fromiter(map(len, values), np.int64, len(values))
        begin = 1 + np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64) if values else lengths
        return cls(data, begin, begin + lengths)


@dataclass
class Words:
    """The words of a block: where each begins and ends, and the first word of each document."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # one more entry than documents

    @classmethod
    def of(cls, text: Text, separators: np.ndarray = SEPARATOR) -> Words:
        if not len(text.data):
            none = np.empty(0, np.int64)
            return cls(none, none, np.zeros(1, np.int64))
        separator = separators[text.data]
        edges = np.flatnonzero(separator[1:] != separator[:-1]) + 1
        start = edges[0::2]
        return cls(start, edges[1::2], np.append(np.searchsorted(start, text.begin), len(start)))

    def __len__(self) -> int:
        return len(self.start)

    def document(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


_powers: dict[int, np.ndarray] = {}


def powers(base: U, n: int) -> np.ndarray:
    """1, base, base^2 ... modulo 2^64; kept up to some length."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        known = np.full(1 << max(16, (n - 1).bit_length()), base, U)
        known[0] = 1
        np.cumprod(known, out=known)
        if n <= 1 << 22:
            _powers[int(base)] = known
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def sums(values: np.ndarray, base: U = BASE) -> np.ndarray:
    """Prefix sums of a polynomial modulo 2^64."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: U = BASE) -> np.ndarray:
    """Hashes of spans, the same for the same content wherever it stands."""
    inverse = INVERSE if base == BASE else INVERSE_2
    return mixed((prefix[end] - prefix[start]) * powers(inverse, len(prefix))[start])


def window_hashes(values: np.ndarray, size: int, base: U = BASE) -> np.ndarray:
    """Hash of every `size` consecutive values."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, U)
    prefix = sums(values, base)
    inverse = INVERSE if base == BASE else INVERSE_2
    return mixed((prefix[size:] - prefix[:n]) * powers(inverse, n))


def word_hashes(text: Text, words: Words, lower: bool = False, base: U = BASE) -> np.ndarray:
    """A 64-bit hash of each word's bytes, with A-Z lower-cased if asked. Hashes of several letters differ by base."""
    out = np.empty(len(words), U)
    values = BYTE_VALUES[LOWER] if lower else BYTE_VALUES
    i = 0
    while i < len(words):
        j = max(i + 1, int(np.searchsorted(words.start, words.start[i] + SLAB)))
        origin = words.start[i]
        prefix = sums(values[text.data[origin : words.end[j - 1]]], base)
        start, end = words.start[i:j] - origin, words.end[i:j] - origin
        # Length is mixed in so that no run of one byte equals a longer run of another.
        out[i:j] = span_hashes(prefix, start, end, base) + mixed((end - start).astype(U))
        i = j
    out = mixed(out)
    key = int(base).to_bytes(8, "little")
    for i in np.flatnonzero(words.end - words.start > LONG_WORD).tolist():
        word = text.data[words.start[i] : words.end[i]]
        word = LOWER[word] if lower else word
        out[i] = int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8, key=key).digest(), "little")
    return out


def within(first: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of the n - size + 1 windows lie within one document."""
    if n < size:
        return np.empty(0, bool)
    document = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return document[size - 1 :] == document[: n - size + 1]


def covered(starts: np.ndarray, lengths, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:n]) > 0


# ---- the exchange ---------------------------------------------------------------------------


@dataclass
class Keys:
    """The different keys of a block in order, how often each occurs, and the key of each occurrence."""

    high: np.ndarray
    low: np.ndarray | None
    counts: np.ndarray
    occurrence: np.ndarray

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray | None = None) -> Keys:
        order = np.argsort(high, kind="stable") if low is None else np.lexsort((low, high))
        high = high[order]
        low = None if low is None else low[order]
        new = np.ones(len(high), bool)
        if len(high):
            new[1:] = high[1:] != high[:-1]
            if low is not None:
                new[1:] |= low[1:] != low[:-1]
        occurrence = np.empty(len(order), np.int64)
        occurrence[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(high)))
        return cls(high[at], None if low is None else low[at], counts, occurrence)

    def parts(self, buckets: int) -> list[tuple[int, slice]]:
        """The range of keys that each bucket gets; buckets are ranges of the key."""
        edges = np.array([(i << 64) // buckets for i in range(buckets)], U)
        at = np.append(np.searchsorted(self.high, edges), len(self.high))
        return [(b, slice(at[b], at[b + 1])) for b in range(buckets) if at[b] < at[b + 1]]

    def rows(self, block: int, buckets: int) -> pa.RecordBatch:
        parts = self.parts(buckets)
        keys = [
            packed(self.high[s]) if self.low is None else self.high[s].tobytes() + self.low[s].tobytes() for _, s in parts
        ]
        counts = [self.counts[s].astype(np.uint32) for _, s in parts]
        return pa.record_batch(
            {
                "bucket": pa.array([b for b, _ in parts], pa.int32()),
                "block": pa.array([block] * len(parts), pa.int64()),
                "keys": pa.array(keys, pa.binary()),
                "counts": pa.array([packed_counts(c) for c in counts], pa.binary()),
            }
        )

    def marked(self, table: pa.Table) -> np.ndarray:
        """The mark of each key, from the rows that came back for this block."""
        rows = sorted(zip(table["bucket"].to_pylist(), table["marks"].to_pylist(), strict=True))
        marks = np.frombuffer(b"".join(m for _, m in rows), np.uint8)
        if len(marks) != len(self.high):
            raise ValueError(f"A block has {len(self.high)} keys and got {len(marks)} marks")
        return marks


def shortened(keys: np.ndarray, total: float) -> np.ndarray:
    """Keys cut to the bits that so many need: two in 65,000 times their number agree by chance.

    For counts whose use is only to rule out what occurs once.
    """
    spare = U(max(0, 64 - 16 - max(1, int(total)).bit_length()))
    return keys >> spare << spare


def packed(keys: np.ndarray) -> bytes:
    """Keys in order, as steps of 4 bytes where they fit: in units of the bits that are in use."""
    if not len(keys):
        return b""
    used = int(np.bitwise_or.reduce(keys))
    spare = (used & -used).bit_length() - 1 if used else 0
    units = keys >> U(spare)
    steps = np.diff(units)
    if len(steps) and int(steps.max()) < 1 << 32:
        return bytes([spare]) + units[:1].tobytes() + steps.astype(np.uint32).tobytes()
    return b"\xff" + keys.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, U)
    if data[0] == 255:
        return np.frombuffer(data, U, offset=1)
    steps = np.frombuffer(data, np.uint32, offset=9).astype(U)
    return np.cumsum(np.concatenate([np.frombuffer(data, U, 1, 1), steps]), dtype=U) << U(data[0])


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts of a block: nothing if all are 1."""
    return b"" if (counts == 1).all() else counts.tobytes()


def totals(table: pa.Table, wide: bool) -> pa.Table:
    """How often each key of a bucket occurs in all blocks, as a mark per key and block.

    The mark is the number of occurrences up to 3, and from there on 2 + log2 of it.
    """
    raw = table["keys"].to_pylist()
    if wide:
        sizes = np.array([len(x) // WIDE for x in raw], np.int64)
        high = np.concatenate([np.frombuffer(x, U, n) for x, n in zip(raw, sizes, strict=True)])
        low = np.concatenate([np.frombuffer(x, np.uint32, n, 8 * n) for x, n in zip(raw, sizes, strict=True)])
    else:
        parts = [unpacked(x) for x in raw]
        sizes, high, low = np.array([len(x) for x in parts], np.int64), np.concatenate(parts), None
    counts = np.concatenate(
        [np.frombuffer(c, np.uint32) if c else np.ones(n, np.uint32) for c, n in zip(table["counts"].to_pylist(), sizes, strict=True)]
    )
    keys = Keys.of(high, low)
    total = np.bincount(keys.occurrence, weights=counts, minlength=len(keys.high))
    mark = np.where(total <= 3, total, 2 + np.log2(np.maximum(total, 1))).astype(np.uint8)[keys.occurrence]
    edges = np.append(0, np.cumsum(sizes))
    return pa.table(
        {
            "block": table["block"],
            "bucket": table["bucket"],
            "marks": pa.array([mark[edges[i] : edges[i + 1]].tobytes() for i in range(len(sizes))], pa.binary()),
        }
    )


def count_keys(rows: DataFrame, wide: bool = False) -> DataFrame:
    """Marks of all keys, per block. `rows` has KEYS_SCHEMA."""
    return rows.groupBy("bucket").applyInArrow(lambda table: totals(table, wide), MARKS_SCHEMA)


def with_places(batch: pa.RecordBatch, starts: np.ndarray, keys: Keys) -> pa.Table:
    """Add to each row of wide keys the starts of their occurrences, in the order of the keys."""
    rows = pa.Table.from_batches([batch])
    order = np.argsort(keys.occurrence, kind="stable")
    sorted_starts = starts[order].astype(np.int32)
    ends = np.cumsum(keys.counts)
    out, at, done = [], 0, 0
    for raw in rows["keys"].to_pylist():
        done += len(raw) // WIDE
        end = int(ends[done - 1])
        out.append(sorted_starts[at:end].tobytes())
        at = end
    return rows.append_column("starts", pa.array(out, pa.binary()))


def repeated_places(table: pa.Table) -> pa.Table:
    """The starts, per block, of windows that occur more than once."""
    marks = totals(table.select(["bucket", "block", "keys", "counts"]), wide=True)["marks"].to_pylist()
    out = []
    for mark, raw, starts in zip(marks, table["counts"].to_pylist(), table["starts"].to_pylist(), strict=True):
        repeated = np.frombuffer(mark, np.uint8) > 1
        places = np.frombuffer(starts, np.int32)
        if raw:
            repeated = np.repeat(repeated, np.frombuffer(raw, np.uint32))
        out.append(places[repeated].tobytes())
    return pa.table({"block": table["block"], "starts": pa.array(out, pa.binary())})


def each_block(blocks: DataFrame, work: Callable[[int, pa.Table], pa.RecordBatch | None], schema) -> DataFrame:
    """Apply `work(block, documents)` to every block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out = work(batch["block"][i].as_py(), unpack(batch["payload"][i]))
                if out is not None:
                    yield out

    return blocks.select("block", "payload").mapInArrow(run, schema)


def with_answers(blocks: DataFrame, answers: DataFrame, work: Callable, schema) -> DataFrame:
    """Apply `work(block, documents, answers)` to every block and the rows that came back for it.

    All calls on one block table share one shuffle of the compressed texts within a plan.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows != 1:
            raise ValueError("Rows came back for a block that does not exist")
        return work(left["block"][0].as_py(), unpack(left["payload"][0]), right)

    grouped = blocks.select("block", "payload").groupBy("block")
    return grouped.cogroup(answers.groupBy("block")).applyInArrow(run, schema)
