"""Suffix-array dedup: maximal repeats from a common-prefix interval tree.

Every byte that lies in a 400-byte string which also starts anywhere else goes.

A suffix array of the whole corpus fits no task, so the strings are dealt out by content first. The
minimizer of a 400-byte string is its 32-byte gram with the least hash. Neighbouring strings share
it for a while; such a run is one stretch of text of at most 768 bytes. Equal strings have equal
minimizers, so after one count of minimizers only stretches whose minimizer occurs again are sent,
each to the bucket of its minimizer, and all copies of a string meet there.

A bucket merges equal stretches and cuts the different ones to where they hold a 400-byte string
whose hash occurs again: beyond that nothing repeats. Of the rest it builds an enhanced suffix array
(order and common prefixes) by prefix tripling, and scans the intervals of common prefixes of 400
bytes and more with a stack. An interval whose occurrences differ in the byte on their left (or begin a stretch)
is a maximal repeat; its group is the whole interval, so it holds all occurrences, not neighbours.
Repeats longer than a stretch appear as overlapping groups; merged spans show their full extent.

Stretches are handled in portions by minimizer, so memory is bounded, but for a minimizer with a
great many different stretches. From `HOT` stretches on, its strings are counted one by one by
96-bit hash instead (merged per block, like the windows of `substring_dedup`): same removed bytes,
no group that grows with the input. Counts of strings of one length do not give maximal groups, so
`repeat_groups` sends every stretch to its suffix array, whatever its minimizer: groups are whole,
but all different stretches of one minimizer, and all occurrences, meet in one task there.

NULL is an empty text. Repeated rows are occurrences of their own. A table without rows gives none.
Only `doc_id` and `text` are read; other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.llm import blocks as b

LENGTH = 400
GRAM = 32
# Occurrences of a minimizer from which on its strings are counted by hash; a power of two.
HOT = 1 << 14
# Bytes of different stretches in one suffix array, and of all stretches in one bucket.
ARRAY_BYTES = 1 << 20
BUCKET_BYTES = 8 << 20

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
FOUND_SCHEMA = "block long, starts binary, lengths binary, groups binary"
GROUP_SCHEMA = "group_id long, length long, n_occurrences long, doc_id long, start long"


# ---- runs of strings with one minimizer -----------------------------------------------------


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every `size` consecutive values, by blocks of prefix and suffix minima."""
    n = len(values)
    padded = np.full(-(-n // size) * size, np.iinfo(b.U).max, b.U)
    padded[:n] = values
    grid = padded.reshape(-1, size)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - size + 1], forward[size - 1 : n])


def stretches(text: b.Text, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts whose strings share one minimizer: first, last, key, and whether it occurs again nearby."""
    size = length - GRAM + 1
    bits = b.U(size.bit_length())
    mask = b.U((1 << int(bits)) - 1)
    inside = np.zeros(len(text.data) + 1, np.int8)
    long = text.end - text.begin >= length
    inside[text.begin[long]] += 1
    inside[text.end[long] - length + 1] -= 1
    inside = np.cumsum(inside, dtype=np.int8)
    out: list[tuple] = []
    # The bytes are handled slab by slab, each with the rest of its last string.
    for at in range(0, max(0, len(text.data) - length + 1), b.SLAB):
        data = text.data[at : at + b.SLAB + length - 1]
        here = np.flatnonzero(inside[at : at + len(data) - length + 1])
        if not len(here):
            continue
        grams = b.window_hashes(b.BYTE_VALUES[data], GRAM)
        # The low bits tell the place; equal grams thereby have an order, any will do.
        least = sliding_min((grams & ~mask) | (np.arange(len(grams), dtype=b.U) & mask), size)[here]
        place = here + ((least & mask).astype(np.int64) - here & int(mask))
        new = np.ones(len(here), bool)
        new[1:] = (place[1:] != place[:-1]) | (here[1:] != here[:-1] + 1)
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(here)) - 1
        value = least[begin] >> bits
        out.append((at + here[begin], at + here[last], b.mixed(value), again(grams >> bits, value)))
    if not out:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, b.U), np.empty(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def again(grams: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Which chosen grams stand at more than one place: only then can a string repeat within its run."""
    seen = np.zeros(1 << 20, bool)
    seen[chosen & b.U(0xFFFFF)] = True
    near = np.sort(grams[seen[grams & b.U(0xFFFFF)]])
    return np.searchsorted(near, chosen, "right") - np.searchsorted(near, chosen, "left") > 1


# ---- the suffix array of a bucket -----------------------------------------------------------


def ranked(keys: np.ndarray) -> np.ndarray:
    """The rank of each key, equal keys equal; 0 stays free."""
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeating(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Where strings may hold a repeat: their numbers, where the part begins, and the parts.

    A part reaches from the first to the last string of `length` bytes whose hash occurs again. Equal strings
    have equal hashes, so no repeat is lost; what only shares a hash is left to the suffix array. The
    byte before a part differs from that before any other occurrence, or else it would be in the part.
    """
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    begins = np.cumsum(sizes) - sizes
    hashes = b.window_hashes(b.BYTE_VALUES[np.frombuffer(b"".join(strings), np.uint8)], length)
    windows = sizes - length + 1
    place = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    owner = np.repeat(np.arange(len(strings)), windows)
    hashes = hashes[begins[owner] + place]
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    found = np.zeros(len(hashes), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    owner, place = owner[found], place[found]
    which, first = np.unique(owner, return_index=True)
    begin, last = place[first], place[np.append(first[1:], len(place)) - 1] if len(which) else place
    ends = last + length
    return which, begin, [strings[i][x:y] for i, x, y in zip(which.tolist(), begin.tolist(), ends.tolist(), strict=True)]


def suffix_array(strings: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Suffixes of `length` bytes and more in order, with their common prefixes.

    Returns the joined bytes, the place of each suffix in them, the common prefix of each suffix
    with the one before (exact from `length` on, 0 below), and begin and end of each place's string.
    """
    data = np.frombuffer(b"\0".join([*strings, b""]) + bytes(8), np.uint8)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    begins = np.cumsum(sizes + 1) - sizes - 1
    n = int(begins[-1] + sizes[-1] + 1)
    owner = np.repeat(np.arange(len(strings)), sizes + 1)
    end = (begins + sizes)[owner]
    places = np.arange(n)
    rest = end - places
    keys = np.zeros(n, b.U)
    for i in range(8):
        keys = (keys << b.U(8)) | data[i : i + n].astype(b.U)
    cut = (np.clip(8 - rest, 0, 7) * 8).astype(b.U)
    keys = (keys >> cut) << cut
    rank = ranked(keys)
    rank[rest == 0] = 0
    # As many ranks as fit into a key are joined at once: three, or two of very many places.
    bits = b.U(int(n).bit_length())
    fitting = 64 // int(bits)
    levels, size = [(8, rank)], 8
    while 2 * size <= length:
        times = 3 if fitting > 2 and 3 * size <= length else 2
        keys = rank.astype(b.U)
        for i in range(1, times):
            keys = (keys << bits) | rank[np.minimum(places + i * size, end)].astype(b.U)
        rank = ranked(keys)
        rank[rest == 0] = 0
        size *= times
        levels.append((size, rank))
    long = np.flatnonzero(rest >= length)
    longest = int(sizes.max())
    keys, held = rank[long].astype(b.U), 1
    for at in range(size, longest, size):
        if held == fitting:
            keys, held = ranked(keys).astype(b.U), 1
        keys = (keys << bits) | rank[np.minimum(long + at, end[long])].astype(b.U)
        held += 1
    suffixes = long[np.argsort(keys)]
    x, y = suffixes[:-1], suffixes[1:]
    # Equal at 0 and at length - size, with 2 * size > length: the first `length` bytes are equal.
    same = np.flatnonzero((rank[x] == rank[y]) & (rank[x + length - size] == rank[y + length - size]))
    x, y = x[same], y[same]
    common = np.zeros(len(x), np.int64)
    steps = levels[-1:] * (longest // size)
    for small, large in zip(levels[-2::-1], levels[:0:-1], strict=True):
        steps += [small] * (large[0] // small[0] - 1)
    for step, rank in steps:
        common += step * (rank[np.minimum(x + common, end[x])] == rank[np.minimum(y + common, end[y])])
    alive = np.ones(len(x), bool)
    for _ in range(7):
        alive &= data[np.minimum(x + common, end[x])] == data[np.minimum(y + common, end[y])]
        common += alive
    prefix = np.zeros(len(suffixes), np.int64)
    prefix[same + 1] = np.minimum(common, np.minimum(rest[x], rest[y]))
    return data[:n], suffixes, prefix, begins, end, owner


def maximal_intervals(prefix: list[int], left: list[int]) -> Iterator[tuple[int, int, int]]:
    """Stack scan of one run of suffixes: (length, first, last) of each interval whose left bytes differ.

    `prefix[i]` is the common prefix of suffix i with i - 1; `left` holds the byte on the left, or
    256 at the beginning of a stretch. Inner intervals come before those around them.
    """
    stack: list[list[int]] = []  # length, first, least and greatest byte on the left
    for i in range(1, len(prefix) + 1):
        depth = prefix[i] if i < len(prefix) else 0
        first, low, high = i - 1, left[i - 1], left[i - 1]
        while stack and stack[-1][0] > depth:
            d, first, lo, hi = stack.pop()
            low, high = min(low, lo), max(high, hi)
            if low != high or high == 256:
                yield d, first, i - 1
        if depth:
            if stack and stack[-1][0] == depth:
                stack[-1][2], stack[-1][3] = min(stack[-1][2], low), max(stack[-1][3], high)
            else:
                stack.append([depth, first, low, high])


def repeats_of(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Maximal repeats of different strings.

    Returns merged spans (string, from, to) and the groups as (length, [(string, place), ...]).
    """
    number, offset, parts = repeating(strings, length)
    if not parts:
        return number, number, number, []
    data, suffixes, prefix, begins, end, owner = suffix_array(parts, length)
    runs = np.flatnonzero((prefix[1:] > 0) & (prefix[:-1] == 0)) if len(prefix) else np.empty(0, np.int64)
    ends = np.flatnonzero((prefix > 0) & (np.append(prefix[1:], 0) == 0))
    left = np.where(suffixes == begins[owner[suffixes]], 256, data[suffixes - 1].astype(np.int64))
    depth = np.zeros(len(suffixes), np.int64)
    groups = []
    borders = np.column_stack([runs, ends + 1]).ravel()
    padded = np.append(left, 0)
    lowest, highest = (f.reduceat(padded, borders)[::2] if len(runs) else runs for f in (np.minimum, np.maximum))
    # Where all left bytes are equal, the same repeat began one byte further left.
    maximal = (highest == 256) | (lowest != highest)
    for lo, hi in zip(runs[maximal].tolist(), ends[maximal].tolist(), strict=True):
        own = left[lo : hi + 1]
        for d, first, last in maximal_intervals(prefix[lo : hi + 1].tolist(), own.tolist()):
            part = depth[lo + first : lo + last + 1]
            part[part == 0] = d
            groups.append((d, suffixes[lo + first : lo + last + 1]))
    at = np.flatnonzero(depth)
    gone = b.covered(suffixes[at], depth[at], len(data) + 1)
    edges = np.flatnonzero(gone[1:] != gone[:-1]) + 1
    if len(gone) and gone[0]:
        edges = np.append(0, edges)
    begin, stop = edges[0::2], edges[1::2]
    which = owner[begin]
    # Places in the strings: `moved` undoes the cut.
    moved = offset - begins
    return number[which], begin + moved[which], stop + moved[which], [(d, number[owner[s]], s + moved[owner[s]]) for d, s in groups]


# ---- the operator ---------------------------------------------------------------------------


def send(block: int, text: b.Text, runs: tuple, picked: np.ndarray, length: int, buckets: int) -> dict[int, bytes]:
    """The picked stretches of a block by bucket: different ones once, with all their places."""
    first, last, key, _ = runs
    bucket = np.searchsorted(np.array([(i << 64) // buckets for i in range(buckets)], b.U), key[picked], "right") - 1
    out: dict[int, bytes] = {}
    for number in np.unique(bucket).tolist():
        index: dict[bytes, int] = {}
        keys, which = [], []
        mine = picked[bucket == number]
        for i in mine.tolist():
            stretch = text.data[first[i] : last[i] + length].tobytes()
            at = index.setdefault(stretch, len(index))
            if at == len(keys):
                keys.append(int(key[i]))
            which.append(at)
        packed = pickle.dumps((keys, list(index), np.array(which, np.int32), first[mine].astype(np.int64)))
        out[number] = pa.compress(packed, codec="zstd", asbytes=True), len(packed)
    return out


def solve(table: pa.Table, length: int, with_groups: bool, array_bytes: int = ARRAY_BYTES) -> pa.Table:
    """All repeats of a bucket, as spans per block."""
    index: dict[bytes, int] = {}
    keys: list[int] = []
    owners, blocks, firsts = [], [], []
    for block, packed, size in zip(table["block"].to_pylist(), table["keys"].to_pylist(), table["size"].to_pylist(), strict=True):
        own_keys, strings, which, first = pickle.loads(pa.decompress(packed, size, codec="zstd", asbytes=True))
        ids = np.empty(len(strings), np.int64)
        for i, (k, s) in enumerate(zip(own_keys, strings, strict=True)):
            ids[i] = index.setdefault(s, len(index))
            if ids[i] == len(keys):
                keys.append(k)
        owners.append(ids[which])
        firsts.append(first)
        blocks.append(np.full(len(first), block, np.int64))
    strings = list(index)
    owner, first, block = np.concatenate(owners), np.concatenate(firsts), np.concatenate(blocks)
    order = np.argsort(owner, kind="stable")
    owner, first, block = owner[order], first[order], block[order]
    copies = np.searchsorted(owner, np.arange(len(strings) + 1))
    n_copies = np.diff(copies)
    spans = [(np.flatnonzero(n_copies > 1), 0, np.array([len(strings[i]) for i in np.flatnonzero(n_copies > 1)], np.int64))]
    spans = [(w, np.zeros(len(w), np.int64), e) for w, _, e in spans]
    groups = [(len(strings[i]), np.array([i]), np.zeros(1, np.int64)) for i in spans[0][0].tolist()] if with_groups else []
    portion: list[int] = []
    size = 0
    by_key = sorted(range(len(strings)), key=keys.__getitem__)
    for n, i in enumerate(by_key):
        portion.append(i)
        size += len(strings[i])
        # A portion ends between keys: only equal keys can hold equal strings.
        if n + 1 < len(by_key) and (size < array_bytes or keys[by_key[n + 1]] == keys[i]):
            continue
        which, begin, stop, found = repeats_of([strings[j] for j in portion], length)
        names = np.array(portion)
        spans.append((names[which], begin, stop))
        if with_groups:
            groups += [(d, names[w], p) for d, w, p in found]
        portion, size = [], 0
    which, begin, stop = (np.concatenate(x) for x in zip(*spans, strict=True))
    # A span of a stretch is one at each place where the stretch stands.
    times = n_copies[which]
    row = np.repeat(copies[which], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    start, size, at = first[row] + np.repeat(begin, times), np.repeat(stop - begin, times), block[row]
    return by_block(at, start, size, grouped(groups, copies, first, block) if with_groups else {})


def grouped(groups: list, copies: np.ndarray, first: np.ndarray, block: np.ndarray) -> dict[int, list]:
    """Each group's occurrences by block: (number, length, occurrences, starts)."""
    out: dict[int, list] = {}
    for number, (length, which, places) in enumerate(groups):
        rows = [(int(block[r]), int(first[r] + p)) for w, p in zip(which.tolist(), places.tolist(), strict=True) for r in range(copies[w], copies[w + 1])]
        for at, start in rows:
            out.setdefault(at, []).append((number, int(length), len(rows), start))
    return out


def by_block(block: np.ndarray, start: np.ndarray, size: np.ndarray, groups: dict[int, list]) -> pa.Table:
    order = np.argsort(block, kind="stable")
    block, start, size = block[order], start[order].astype(np.int64), size[order].astype(np.int64)
    names = np.unique(np.append(block, np.array(list(groups), np.int64)))
    lo, hi = np.searchsorted(block, names, "left"), np.searchsorted(block, names, "right")
    return pa.table(
        {
            "block": pa.array(names, pa.int64()),
            "starts": pa.array([start[i:j].tobytes() for i, j in zip(lo, hi, strict=True)], pa.binary()),
            "lengths": pa.array([size[i:j].tobytes() for i, j in zip(lo, hi, strict=True)], pa.binary()),
            "groups": pa.array([pickle.dumps(groups.get(i, [])) if groups else b"" for i in names.tolist()], pa.binary()),
        }
    )


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256."""
    return repeats(b.pack(docs), length, digest, RESULT)


def repeat_groups(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Maximal repeat groups: a row per occurrence with its group, length and place in the document (bytes).

    Repeated rows, and documents with one id, are occurrences of their own.
    """
    return repeats(b.pack(docs), length, occurrences, GROUP_SCHEMA, with_groups=True)


def repeats(
    blocks: DataFrame, length: int, finish, schema: str, with_groups: bool = False, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    if length < 2 * GRAM:
        raise ValueError(f"Repeats of fewer than {2 * GRAM} bytes are not looked for")
    n_bytes = b.total_bytes(blocks)
    # A stretch is about three times as long as its run, and half of the text may repeat.
    few, many = b.buckets_for(n_bytes / 80), b.buckets_for(1.5 * n_bytes, bucket_bytes)
    hot_mark = 2 + hot.bit_length() - 1

    def seeds(block: int, table: pa.Table) -> pa.RecordBatch:
        _, _, key, twice = stretches(b.Text.of(table["text"]), length)
        return b.Keys.of(b.shortened(np.concatenate([key, key[twice]]), n_bytes)).rows(block, few)

    def extend(block: int, table: pa.Table, marks: pa.Table) -> pa.Table:
        text = b.Text.of(table["text"])
        runs = stretches(text, length)
        first, last, key, twice = runs
        keys = b.Keys.of(b.shortened(np.concatenate([key, key[twice]]), n_bytes))
        mark = keys.marked(marks)[keys.occurrence[: len(key)]]
        by_count = (mark >= hot_mark) & (not with_groups)
        sent = send(block, text, runs, np.flatnonzero((mark > 1) & ~by_count), length, many)
        rows = pa.table(
            {
                "bucket": pa.array(list(sent), pa.int32()),
                "block": pa.array([block] * len(sent), pa.int64()),
                "keys": pa.array([x for x, _ in sent.values()], pa.binary()),
                "counts": pa.array([b""] * len(sent), pa.binary()),
                "starts": pa.array([b""] * len(sent), pa.binary()),
                "size": pa.array([n for _, n in sent.values()], pa.int64()),
            }
        )
        single = by_hash(block, text, first, last, np.flatnonzero(by_count), length, few)
        bucket = pa.array(np.asarray(single["bucket"]) + many, pa.int32())
        single = single.set_column(0, "bucket", bucket).append_column("size", pa.array([0] * single.num_rows, pa.int64()))
        return pa.concat_tables([rows, single])

    def solve_bucket(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < many:
            return solve(table, length, with_groups)
        found = b.repeated_places(table.drop_columns(["size"]))
        sizes = [np.full(len(x) // 4, length, np.int64).tobytes() for x in found["starts"].to_pylist()]
        starts = [np.frombuffer(x, np.int32).astype(np.int64).tobytes() for x in found["starts"].to_pylist()]
        return pa.table({"block": found["block"], "starts": starts, "lengths": sizes, "groups": pa.array([b""] * len(sizes), pa.binary())})

    def remove(block: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        return finish(block, table, b.Text.of(table["text"]), answers)

    marks = b.count_keys(b.each_block(blocks, seeds, b.KEYS_SCHEMA))
    sent = b.with_answers(blocks, marks, extend, b.PLACES_SCHEMA + ", size long")
    found = sent.groupBy("bucket").applyInArrow(
        (lambda key, table: numbered(key[0].as_py(), solve_bucket(table))) if with_groups else solve_bucket, FOUND_SCHEMA
    )
    return b.with_answers(blocks, found, remove, schema)


def by_hash(block: int, text: b.Text, first, last, picked, length: int, buckets: int) -> pa.Table:
    """The strings of hot minimizers one by one: their hashes and starts."""
    starts = np.concatenate([np.empty(0, np.int64), *(np.arange(first[i], last[i] + 1) for i in picked.tolist())])
    if not len(starts):
        keys = b.Keys.of(np.empty(0, b.U), np.empty(0, np.uint32))
    else:
        values = b.BYTE_VALUES[text.data]
        high = b.span_hashes(b.sums(values), starts, starts + length)
        low = b.span_hashes(b.sums(b.mixed(values), b.BASE_2), starts, starts + length, b.BASE_2)
        keys = b.Keys.of(high, (low >> b.U(32)).astype(np.uint32))
    return b.with_places(keys.rows(block, buckets), starts, keys)


def numbered(bucket: int, table: pa.Table) -> pa.Table:
    """Make the group numbers of a bucket unique."""
    groups = [
        pickle.dumps([((bucket << 32) + n, *rest) for n, *rest in pickle.loads(x)]) if x else x
        for x in table["groups"].to_pylist()
    ]
    return table.set_column(3, "groups", pa.array(groups, pa.binary()))


def spans_of(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    none = [np.empty(0, np.int64)]
    starts = np.concatenate(none + [np.frombuffer(x, np.int64) for x in answers["starts"].to_pylist()])
    return starts, np.concatenate(none + [np.frombuffer(x, np.int64) for x in answers["lengths"].to_pylist()])


def digest(block: int, table: pa.Table, text: b.Text, answers: pa.Table) -> pa.Table:
    gone = b.covered(*spans_of(answers), len(text.data))
    count = np.append(0, np.cumsum(gone))
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    spans = np.append(0, np.cumsum(begins))
    i, j = text.begin, text.end
    return pa.table(
        {
            "doc_id": table["doc_id"].cast(pa.int64()),
            "n_bytes": pa.array(j - i),
            "n_removed": pa.array(count[j] - count[i]),
            "n_spans": pa.array(spans[j] - spans[i]),
            "kept_sha256": pa.array(
                [hashlib.sha256(text.data[x:y][~gone[x:y]].tobytes()).hexdigest() for x, y in zip(i, j, strict=True)], pa.string()
            ),
        }
    )


def occurrences(block: int, table: pa.Table, text: b.Text, answers: pa.Table) -> pa.Table:
    rows = [r for x in answers["groups"].to_pylist() if x for r in pickle.loads(x)]
    start = np.array([r[3] for r in rows], np.int64)
    doc = np.searchsorted(text.begin, start, "right") - 1
    ids = table["doc_id"].cast(pa.int64()).combine_chunks()
    return pa.table(
        {
            "group_id": pa.array([r[0] for r in rows], pa.int64()),
            "length": pa.array([r[1] for r in rows], pa.int64()),
            "n_occurrences": pa.array([r[2] for r in rows], pa.int64()),
            "doc_id": ids.take(pa.array(doc)),
            "start": pa.array(start - text.begin[doc] if len(rows) else start, pa.int64()),
        }
    )
