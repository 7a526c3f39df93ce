"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items become words: runs of letters and digits in lower case, accented ones
included. Rolling
Karp-Rabin hashes of every `min_match` words are joined with those of the benchmark; the seeds that
a document shares with an item grow into longest matches. Tiling then repeats: mark the longest
match whose words are unmarked on both sides; cut what it overlaps; until nothing of `min_match`
words is left. The share of an item's words under tiles is its coverage, so a passage whose
sentences were moved around is found as well. A document with an item covered by `coverage`
percent or more is contaminated.

The benchmark is the query set: it is cut into parts of bounded size, and each part goes to all
tasks. Documents stay where they are read; nothing is shuffled.

NULL and empty texts share nothing. Items of fewer than `min_match` words cannot be matched.
Repeated rows get equal answers, repeated items each their own. Tables without rows give no rows.
Only `doc_id` and `text`, `item_id` and `text` are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.llm import blocks as b

MIN_MATCH = 5
COVERAGE = 50
# Text of the benchmark that goes to all tasks at once.
PART_BYTES = 16 << 20

SCHEMA = "doc_id long, item_id long, n_item_words long, n_covered long, n_tiles long, longest long"

# Everything in ASCII but letters and digits separates words.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[i for i in range(128) if not chr(i).isalnum()]] = True


def folded_words(texts: pa.Array) -> tuple[b.Words, np.ndarray]:
    """The words of some texts and their hashes, whatever the case."""
    text = b.Text.of(pa.compute.utf8_lower(texts))
    words = b.Words.of(text, SEPARATOR)
    return words, b.word_hashes(text, words)


@dataclass
class Items:
    """A part of the benchmark: words of all items, and where each seed stands."""

    ids: list[int | None]
    first: np.ndarray
    hashes: np.ndarray
    seeds: np.ndarray  # different seeds in order
    begin: np.ndarray  # first place of each seed
    places: np.ndarray  # the seeds' words, by seed

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]], min_match: int) -> Items:
        words, hashes = folded_words(pa.array([r[1] for r in rows], pa.string()))
        places = np.flatnonzero(b.within(words.first, len(words), min_match))
        seeds = b.window_hashes(hashes, min_match)[places]
        order = np.argsort(seeds, kind="stable")
        seeds, begin = np.unique(seeds[order], return_index=True)
        return cls([r[0] for r in rows], words.first, hashes, seeds, np.append(begin, len(order)), places[order])


def longest_matches(i: np.ndarray, j: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """(length, i, j) of the longest matches, from the places of shared seeds in both texts."""
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)
    at = np.flatnonzero(new)
    lengths = np.diff(np.append(at, len(i))) + min_match - 1
    return list(zip(lengths.tolist(), i[at].tolist(), j[at].tolist(), strict=True))


def tile(matches: list[tuple[int, int, int]], min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (length, i, j): the longest first, at a tie the first in the item, then in the document."""
    heap = [(-length, j, i) for length, i, j in matches]
    heapq.heapify(heap)
    used_i: set[int] = set()
    used_j: set[int] = set()
    tiles = []
    while heap:
        length, j, i = heapq.heappop(heap)
        free = [k for k in range(-length) if i + k not in used_i and j + k not in used_j]
        if len(free) == -length:
            tiles.append((-length, i, j))
            used_i.update(range(i, i - length))
            used_j.update(range(j, j - length))
            continue
        # What is left of an overlapped match waits for its turn.
        k = 0
        while k < len(free):
            end = k
            while end + 1 < len(free) and free[end + 1] == free[end] + 1:
                end += 1
            if end - k + 1 >= min_match:
                heapq.heappush(heap, (-(end - k + 1), j + free[k], i + free[k]))
            k = end + 1
    return tiles


def tilings(items: Items, hashes: np.ndarray, first: np.ndarray, min_match: int, coverage: int) -> Iterator[tuple]:
    """(document, item, words, covered, tiles, longest) of each pair that reaches the coverage."""
    if not len(items.seeds) or len(hashes) < min_match:
        return
    windows = b.window_hashes(hashes, min_match)
    at = np.searchsorted(items.seeds, windows)
    at[at == len(items.seeds)] = 0
    hits = np.flatnonzero((items.seeds[at] == windows) & b.within(first, len(hashes), min_match))
    if not len(hits):
        return
    document = np.searchsorted(first, hits, "right") - 1
    sizes = np.diff(items.first)
    for doc in np.unique(document).tolist():
        i = hits[document == doc]
        seed = at[i]
        times = items.begin[seed + 1] - items.begin[seed]
        rows = np.repeat(items.begin[seed], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        j, i = items.places[rows], np.repeat(i, times)
        item = np.searchsorted(items.first, j, "right") - 1
        # An item whose shared seeds cover too little cannot be covered by tiles.
        for own in np.unique(item).tolist():
            mine = item == own
            own_j = j[mine] - items.first[own]
            reach = b.covered(np.unique(own_j), min_match, sizes[own])
            if 100 * reach.sum() < coverage * sizes[own]:
                continue
            tiles = tile(longest_matches(i[mine], own_j, min_match), min_match)
            covered = sum(t[0] for t in tiles)
            if 100 * covered >= coverage * sizes[own]:
                yield doc, own, int(sizes[own]), covered, len(tiles), max(t[0] for t in tiles)


def parts_of(benchmark: DataFrame, part_bytes: int) -> list[DataFrame]:
    """The benchmark in parts of about so many bytes each."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-size // part_bytes))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == p) for p in range(n)]


def shared_items(part: DataFrame, min_match: int):
    """A part of the benchmark, sent to all tasks."""
    rows = sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    return part.sparkSession.sparkContext.broadcast(Items.of(rows, min_match))


def tile_part(docs: DataFrame, part: DataFrame, min_match: int, coverage: int) -> DataFrame:
    shared = shared_items(part, min_match)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in b.slices(batches, 1):
            words, hashes = folded_words(batch.column(1))
            found = list(tilings(items, hashes, words.first, min_match, coverage))
            ids = batch.column(0).cast(pa.int64()).take(pa.array([f[0] for f in found], pa.int64()))
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(2, 6)]
            item_ids = pa.array([items.ids[f[1]] for f in found], pa.int64())
            names = ["doc_id", "item_id", "n_item_words", "n_covered", "n_tiles", "longest"]
            yield pa.record_batch([ids, item_ids, *columns], names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def greedy_tiling(
    docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: int = COVERAGE, part_bytes: int = PART_BYTES
) -> DataFrame:
    """A row per document and benchmark item that it contains: their ids, the item's words, the words
    under tiles, the number of tiles and the longest."""
    parts = [tile_part(docs, p, min_match, coverage) for p in parts_of(benchmark, part_bytes)]
    return reduce(DataFrame.unionByName, parts)


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: int = COVERAGE, part_bytes: int = PART_BYTES
) -> DataFrame:
    """The documents without those that contain a benchmark item, with all their columns."""
    text_at = docs.columns.index("text")

    def without(docs: DataFrame, part: DataFrame) -> DataFrame:
        shared = shared_items(part, min_match)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in b.slices(batches, text_at):
                words, hashes = folded_words(batch.column(text_at))
                clean = np.ones(batch.num_rows, bool)
                clean[[f[0] for f in tilings(items, hashes, words.first, min_match, coverage)]] = False
                yield batch.filter(pa.array(clean))

        return docs.mapInArrow(run, docs.schema)

    return reduce(without, parts_of(benchmark, part_bytes), docs)
