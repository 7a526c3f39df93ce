"""Packing examples into training sequences: vector bin packing by the dot-product heuristic.

An example asks for three things at once: tokens, a segment of the attention mask, and tokens that
bear loss. A sequence has a limit on each. One sequence is open at a time; of the examples that
still fit, the one comes next whose vector has the largest dot product with what the sequence has
left, each dimension in parts of its limit and weighed by how much the waiting examples ask of it.
So an example that is large in what is scarce and in what the sequence has room for goes first, and
small ones fill what is left.

`pack_examples` places whole examples, for instruction data. `pack_documents` tokenizes texts and
may cut them: stretches that fill a sequence by themselves are cut off first, the rests are the
examples, and what a sequence has left when nothing more fits is filled by the beginning of the
longest one. A sequence is as long as its limit or, at the end of a task, a power of two, so that
nearly nothing is padded; below `MIN_PIECE` tokens a rest is padded instead of filled.

Each task packs what it reads: nothing is shuffled, and a pool of bounded size waits. The numbers
of sequences follow from the number of the task, so a task that runs again gives the same ones.

Texts are tokenized in chunks that end before a single space, which the tokenizer splits off in any
case, so a text of any length needs little memory unless it has no spaces. The tokenizer file is
read by the driver and goes to all tasks; its size is that of the vocabulary.

NULL and empty texts have the closing id only. Equal rows are packed each by itself. A table
without rows gives none. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.llm.streams import record_batch

# The id behind each document.
CLOSING = 1
# Examples that wait in a task, and below how many it reads on.
POOL, REFILL = 4096, 2048
# Tokens of the least piece that is cut off to fill a sequence.
MIN_PIECE = 8
# Characters tokenized at a time.
CHUNK = 1 << 20
BATCH_ROWS = 10_000
ID_BYTES = 4


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


# ---- placing ---------------------------------------------------------------------------------


class Pool:
    """Waiting examples and their vectors (tokens, loss); each is one segment."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits
        self.items: list = []
        self.tokens = np.zeros(2 * POOL, np.int64)
        self.loss = np.zeros(2 * POOL, np.int64)
        self.waiting = 0

    def add(self, item: object, tokens: int, loss: int) -> None:
        if len(self.items) == len(self.tokens):
            self.compact()
        n = len(self.items)
        self.tokens[n], self.loss[n] = tokens, loss
        self.items.append(item)
        self.waiting += 1

    def compact(self) -> None:
        kept = [i for i, item in enumerate(self.items) if item is not None]
        size = max(2 * POOL, 2 * len(kept))
        tokens, loss = np.zeros(size, np.int64), np.zeros(size, np.int64)
        tokens[: len(kept)], loss[: len(kept)] = self.tokens[kept], self.loss[kept]
        self.items = [self.items[i] for i in kept]
        self.tokens, self.loss = tokens, loss

    def weights(self) -> tuple[float, float, float]:
        """Demand of all that waits, in sequences, by dimension."""
        n = len(self.items)
        demand = self.tokens[:n].sum() / self.limits.tokens, self.waiting / self.limits.segments, self.loss[:n].sum() / self.limits.loss
        most = max(demand) or 1.0
        return tuple(float(d / most) for d in demand)

    def best(self, tokens: int, segments: int, loss: int, weights: tuple[float, float, float]) -> int | None:
        """The example to place where so much is left; the first of equal ones."""
        n = len(self.items)
        if not segments or not n:
            return None
        t, own = self.tokens[:n], self.loss[:n]
        limits = self.limits
        score = t * (weights[0] * tokens / limits.tokens**2) + own * (weights[2] * loss / limits.loss**2)
        # Taken ones have no tokens left.
        score[(t > tokens) | (own > loss) | (t == 0)] = -1.0
        at = int(score.argmax())
        # The segments' part of the product is the same for all.
        return at if score[at] >= 0 else None

    def longest(self) -> int | None:
        n = len(self.items)
        at = int(self.tokens[:n].argmax()) if n else 0
        return at if n and self.tokens[at] else None

    def take(self, at: int) -> tuple[object, int, int]:
        out = self.items[at], int(self.tokens[at]), int(self.loss[at])
        self.items[at], self.tokens[at], self.loss[at] = None, 0, 0
        self.waiting -= 1
        return out


def fill(pool: Pool) -> list[tuple[object, int, int]]:
    """One sequence of whole examples: (item, tokens, loss) of each."""
    left = [pool.limits.tokens, pool.limits.segments, pool.limits.loss]
    weights, out = pool.weights(), []
    while (at := pool.best(*left, weights)) is not None:
        out.append(pool.take(at))
        left = [left[0] - out[-1][1], left[1] - 1, left[2] - out[-1][2]]
    return out


def first_sequence() -> int:
    """Each task numbers its sequences in a range of its own."""
    return TaskContext.get().partitionId() << 36


# ---- whole examples --------------------------------------------------------------------------

PLACED = pa.schema([("example_id", pa.int64()), ("tokens", pa.int64()), ("loss", pa.int64()), ("sequence_id", pa.int64()), ("segment", pa.int64()), ("offset", pa.int64())])
PLACES = "example_id long, tokens long, loss long, sequence_id long, segment long, offset long"


def pack_examples(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """PLACES of whole examples; `examples` holds (example_id, tokens, loss).

    An example above a limit stands in a sequence of its own. One without tokens takes a segment like any other.
    """

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, sequence, out = Pool(limits), first_sequence(), []

        def put(members: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for segment, ((number, tokens, loss), *_) in enumerate(members):
                out.append((number, tokens, loss, sequence, segment, offset))
                offset += tokens
            sequence += 1

        empty: list[tuple] = []
        for batch in batches:
            for number, tokens, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                item = (number, tokens or 0, loss or 0)
                if item[1] > limits.tokens or item[2] > limits.loss:
                    put([(item,)])
                elif not item[1]:
                    empty.append((item,))
                    if len(empty) == limits.segments:
                        put(empty)
                        empty = []
                else:
                    pool.add(item, *item[1:])
                if pool.waiting >= POOL:
                    while pool.waiting > REFILL:
                        put(fill(pool))
                    pool.compact()
                if len(out) > BATCH_ROWS:
                    yield record_batch(out, PLACED)
                    out.clear()
        while pool.waiting:
            put(fill(pool))
        if empty:
            put(empty)
        yield record_batch(out, PLACED)

    columns = [F.col(c).cast("long").alias(c) for c in ("example_id", "tokens", "loss")]
    return examples.select(*columns).mapInArrow(packed, PLACES)


# ---- tokens ----------------------------------------------------------------------------------

# Letters, marks, digits and signs that all versions of Unicode in use sort alike.
SETTLED = r"\u0000-\u052f\u2010-\u2027\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
UNSETTLED = re.compile(f"[^{SETTLED}]")
# Characters of the longest word for the second implementation, whose time grows with their square.
LONG_WORD = 2000
# The pattern of byte-level BPE: what each piece of a text looks like.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_WORKER: dict[int, Ids] = {}


class Ids:
    """Ids of texts as little-endian 32-bit numbers.

    They are those of the library the file belongs to. Byte-level BPE whose ids are the ranks of its
    merges has a second implementation several times as fast, which is used where both must agree:
    not for characters that younger versions of Unicode sort differently, nor for added tokens.
    """

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        content = json.loads(file)
        self.added = [x["content"] for x in content.get("added_tokens", [])]
        self.fast = ranked(content)

    @classmethod
    def of(cls, file: str) -> Ids:
        """One for each Python worker, which serves many tasks."""
        key = zlib.crc32(file.encode())
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = cls(file)
        return _WORKER[key]

    def alike(self, text: str) -> bool:
        """Whether both implementations give the same ids in the same time."""
        settled = text.isascii() or UNSETTLED.search(text) is None
        short = max(map(len, text.split(" "))) < LONG_WORD and " " * LONG_WORD not in text
        return settled and short and not any(x in text for x in self.added)

    def ids(self, text: str) -> bytes:
        if self.fast is not None and self.alike(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def whole(self, text: str) -> bytes:
        """Ids of a text of any length."""
        return b"".join(map(self.ids, chunks(text)))


def ranked(content: dict):
    """The second implementation of a tokenizer file, or None if it isn't of that kind."""
    import tiktoken

    model, split = content.get("model", {}), content.get("pre_tokenizer") or {}
    plain = not content.get("normalizer") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
    if model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or not plain:
        return None
    # The letters that stand for bytes: printable ones for themselves, the others from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    added = {x["content"] for x in content.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in added}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if [model["vocab"][a + b] for a, b in merges] != list(range(256, 256 + len(merges))) or len(ranks) != 256 + len(merges):
        return None
    return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


# Before a space between characters that are none; in the tokenizer's pattern a piece begins there.
BREAK = re.compile(r"(?<=\S)(?= \S)")


def chunks(text: str) -> Iterator[str]:
    """The text cut where the tokenizer cuts in any case, about every `CHUNK` characters."""
    begin = 0
    while len(text) - begin > CHUNK:
        found = BREAK.search(text, begin + CHUNK)
        if found is None:
            break
        yield text[begin : found.start()]
        begin = found.start()
    yield text[begin:]


# ---- documents -------------------------------------------------------------------------------

PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "segment", "loss")])
PIECE = ", ".join(f"{c} long" for c in PIECES.names)


@dataclass
class Piece:
    """A stretch of a document's ids."""

    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // ID_BYTES

    @property
    def loss(self) -> int:
        """Nothing comes before the first token that could foretell it."""
        return len(self) - 1

    def cut(self, at: int) -> tuple[Piece, Piece]:
        head = Piece(self.doc_id, self.start, self.ids[: at * ID_BYTES], self.doc_tokens)
        return head, Piece(self.doc_id, self.start + at, self.ids[at * ID_BYTES :], self.doc_tokens)


@dataclass
class Packer:
    """Packs the documents of one task."""

    limits: Limits
    sequence: int
    pool: Pool = field(init=False)
    out: list[tuple] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.pool = Pool(self.limits)

    def put(self, members: list[Piece]) -> None:
        offset = 0
        for segment, p in enumerate(members):
            self.out.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, self.sequence, offset, segment, p.loss))
            offset += len(p)
        self.sequence += 1

    def wait(self, piece: Piece) -> None:
        self.pool.add(piece, len(piece), piece.loss)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        rest = Piece(doc_id, 0, ids, len(ids) // ID_BYTES)
        whole = min(self.limits.tokens, self.limits.loss + 1)
        while len(rest) > whole:
            head, rest = rest.cut(whole)
            if whole == self.limits.tokens:
                self.put([head])
            else:
                self.wait(head)
        self.wait(rest)
        if self.pool.waiting >= POOL:
            self.drain(REFILL)

    def drain(self, down_to: int) -> None:
        while self.pool.waiting > down_to:
            self.close([p for p, *_ in fill(self.pool)])
        self.pool.compact()

    def close(self, members: list[Piece]) -> None:
        """Fill what a sequence has left, or make its length a power of two."""
        limits = self.limits
        left = limits.tokens - sum(map(len, members))
        loss = limits.loss - sum(p.loss for p in members)
        at = self.pool.longest()
        if left >= MIN_PIECE and loss >= left - 1 and len(members) < limits.segments and at is not None:
            # It is longer than what is left, or it would have been placed.
            head, rest = self.pool.take(at)[0].cut(left)
            self.wait(rest)
            return self.put([*members, head])
        if left < MIN_PIECE:
            return self.put(members)
        for part in powers(members):
            self.put(part)

    def finish(self) -> None:
        self.drain(0)


def powers(members: list[Piece]) -> Iterator[list[Piece]]:
    """Sequences whose lengths are the powers of two that add up to the tokens at hand."""
    total = sum(map(len, members))
    queue = members[::-1]
    for bit in reversed(range(total.bit_length())):
        size, part = total & (1 << bit), []
        while size:
            p = queue.pop()
            if len(p) > size:
                p, rest = p.cut(size)
                queue.append(rest)
            part.append(p)
            size -= len(p)
        if part:
            yield part


def pack_documents(docs: DataFrame, tokenizer_file: str, limits: Limits = Limits()) -> DataFrame:
    """PIECE of all documents. `tokenizer_file` is the text of the tokenizer's JSON file."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_file)
    closing = np.asarray([CLOSING], "<u4").tobytes()

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packer = Ids.of(shared.value), Packer(limits, first_sequence())
        for batch in batches:
            for number, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packer.add(number, ids.whole(text or "") + closing)
            yield from flushed(packer)
        packer.finish()
        yield from flushed(packer)

    def flushed(packer: Packer) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(packer.out), BATCH_ROWS):
            yield record_batch(packer.out[i : i + BATCH_ROWS], PIECES)
        packer.out.clear()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(packed, PIECE)
