"""Substring dedup by difference-cover anchors.

Every word that lies in a long window (35 words) which also starts anywhere else goes.

A difference cover modulo 21 is a set of residues in which every difference modulo 21 occurs.
Hence for any two places there is a shift below 21 that brings both onto cover positions, and two
equal windows of 35 words share an equal anchor of 15 words that begins on a cover position in
both. Only anchors there, 5 of 21, are hashed and counted. A window that holds an anchor which
occurs more than once is extended: its own 96-bit hash is counted among all such windows, so the
answer is exact without comparing pairs. Both counts travel per block, see `blocks`.

NULL and empty texts have no words. Repeated rows are occurrences of their own, so their windows
are repeated. A table without rows gives none. Only `doc_id` and `text` are read; other columns,
whatever their names, do not matter. NULL in `doc_id` stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tierflow.llm import blocks as b

WINDOW = 35
PERIOD = 21
# A perfect difference set modulo 21: each difference occurs exactly once.
COVER = (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long"


def anchors(hashes: np.ndarray, first: np.ndarray, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Cover positions that begin an anchor within one document, and the anchors' hashes."""
    inside = b.within(first, len(hashes), anchor)
    at = np.flatnonzero(inside & np.isin(np.arange(len(inside)) % PERIOD, COVER))
    return at, b.window_hashes(hashes, anchor)[at]


def windows_with(marked: np.ndarray, first: np.ndarray, n: int, window: int) -> np.ndarray:
    """Starts of windows within a document that hold one of the marked anchors."""
    if n < window:
        return np.empty(0, np.int64)
    seen = np.zeros(n + 1, np.int64)
    seen[marked + 1] = 1
    seen = np.cumsum(seen)
    reach = PERIOD - 1
    starts = np.arange(n - window + 1)
    held = seen[starts + reach + 1] > seen[starts]
    return np.flatnonzero(held & b.within(first, n, window))


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words) and n_spans (removed runs)."""
    if window < PERIOD + 2:
        raise ValueError(f"A window needs at least {PERIOD + 2} words")
    return dedup_blocks(b.pack(docs), window, digest, RESULT)


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id and the kept words joined by one space."""
    return dedup_blocks(b.pack(docs), window, kept_texts, "doc_id long, text string")


def dedup_blocks(blocks: DataFrame, window: int, finish, schema: str) -> DataFrame:
    anchor = window - PERIOD + 1
    n_bytes = b.total_bytes(blocks)
    # About one word for six bytes; a short guess only makes the buckets larger.
    words = n_bytes / 6
    few, many = b.buckets_for(words * len(COVER) / PERIOD), b.buckets_for(words / 3)

    def seeds(block: int, table: pa.Table) -> pa.RecordBatch:
        _, words, hashes = words_of(table)
        return b.Keys.of(b.shortened(anchors(hashes, words.first, anchor)[1], n_bytes)).rows(block, few)

    def candidates(text: b.Text, words: b.Words, hashes: np.ndarray, starts: np.ndarray) -> b.Keys:
        # The other 32 bits come from other hashes of the words, too.
        again = b.word_hashes(text, words, base=b.BASE_2)
        return b.Keys.of(
            b.window_hashes(hashes, window)[starts],
            (b.window_hashes(again, window, b.BASE_2)[starts] >> b.U(32)).astype(np.uint32),
        )

    def extend(block: int, table: pa.Table, marks: pa.Table) -> pa.Table:
        text, words, hashes = words_of(table)
        at, found = anchors(hashes, words.first, anchor)
        keys = b.Keys.of(b.shortened(found, n_bytes))
        repeated = at[(keys.marked(marks) > 1)[keys.occurrence]]
        starts = windows_with(repeated, words.first, len(words), window)
        keys = candidates(text, words, hashes, starts)
        # The places travel with the keys: the last pass need not find the anchors again.
        return b.with_places(keys.rows(block, many), starts, keys)

    def remove(block: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        text = b.Text.of(table["text"])
        words = b.Words.of(text)
        starts = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x, np.int32) for x in answers["starts"].to_pylist())])
        gone = b.covered(starts.astype(np.int64), window, len(words))
        return finish(table, text, words, gone)

    marks = b.count_keys(b.each_block(blocks, seeds, b.KEYS_SCHEMA))
    windows = b.with_answers(blocks, marks, extend, b.PLACES_SCHEMA)
    places = windows.groupBy("bucket").applyInArrow(b.repeated_places, "block long, starts binary")
    return b.with_answers(blocks, places, remove, schema)


def words_of(table: pa.Table) -> tuple[b.Text, b.Words, np.ndarray]:
    text = b.Text.of(table["text"])
    words = b.Words.of(text)
    return text, words, b.word_hashes(text, words)


def kept_bytes(text: b.Text, words: b.Words, gone: np.ndarray) -> list[bytes]:
    """For each document its kept words, joined by one space."""
    keep = ~gone
    change = np.zeros(len(text.data) + 2, np.int8)
    change[words.start[keep]] += 1
    # A kept word takes along the separator that follows it, written as a space.
    change[words.end[keep] + 1] -= 1
    mask = np.cumsum(change, dtype=np.int8)[: len(text.data)] > 0
    plain = text.data.copy()
    plain[words.end] = 0x20
    return [plain[i : j + 1][mask[i : j + 1]].tobytes()[:-1] for i, j in zip(text.begin, text.end, strict=True)]


def digest(table: pa.Table, text: b.Text, words: b.Words, gone: np.ndarray) -> pa.Table:
    count = np.append(0, np.cumsum(gone))
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    inner = words.first[:-1]
    inner = inner[inner < np.append(words.first[1:], 0)[: len(inner)]]
    begins[inner] = gone[inner]
    spans = np.append(0, np.cumsum(begins))
    first = words.first
    return pa.table(
        {
            "doc_id": table["doc_id"].cast(pa.int64()),
            "n_words": pa.array(np.diff(first)),
            "n_removed": pa.array(count[first[1:]] - count[first[:-1]]),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept_bytes(text, words, gone)], pa.string()),
            "n_spans": pa.array(spans[first[1:]] - spans[first[:-1]]),
        }
    )


def kept_texts(table: pa.Table, text: b.Text, words: b.Words, gone: np.ndarray) -> pa.Table:
    return pa.table(
        {
            "doc_id": table["doc_id"].cast(pa.int64()),
            "text": pa.array([x.decode() for x in kept_bytes(text, words, gone)], pa.string()),
        }
    )
