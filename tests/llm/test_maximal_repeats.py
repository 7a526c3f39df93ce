"""Bytes in repeated strings and maximal repeat groups, against brute-force versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.tables import documents
from tierflow.llm import maximal_repeats as m
from tierflow.llm.blocks import pack


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(t, gone, strict=False) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sample(seed, n_docs=40):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choices("ab cé\n", k=n))
    passages = [text(rng.randint(300, 1500)) for _ in range(6)]
    rows = []
    for i in range(n_docs):
        parts = [
            (p := rng.choice(passages))[rng.randint(0, 60) : len(p) - rng.randint(0, 60)] if rng.random() < 0.5 else text(rng.randint(1, 500))
            for _ in range(rng.randint(0, 4))
        ]
        rows.append((i, "".join(parts)))
    return rows


PERIODIC = [(100, "a" * 900), (101, "b" * 400), (102, "c" * 399), (103, "d" * 401), (104, "xyz" * 200), (105, "0123456789" * 45), (106, "é" * 201)]


@pytest.mark.parametrize("block_bytes", [2000, 1 << 20])
@pytest.mark.parametrize("hot", [m.HOT, 4])
def test_equals_brute_force(spark, block_bytes, hot):
    rows = sample(hot + block_bytes) + PERIODIC
    blocks = pack(documents(spark, rows), block_bytes=block_bytes)
    assert got(m.repeats(blocks, 400, m.digest, m.RESULT, hot=hot)) == brute(rows, 400)


def test_shorter_length(spark):
    rows = sample(5, 30)
    assert got(m.suffix_dedup(documents(spark, rows), 100)) == brute(rows, 100)


def test_odd_rows(spark):
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefgh ", k=700_000))
    rows = [(1, None), (2, ""), (None, "x"), (4, long), (5, "y" + long[:500] + "z"), (6, "\0" * 1000)]
    same = [(7, long[1000:1600])] * 3
    short = [r for r in rows + same]
    expected = {r[0]: r for r in got(m.suffix_dedup(documents(spark, short, clashing=True)))}
    assert expected[1] == expected[2][:0] + (1, 0, 0, 0, hashlib.sha256(b"").hexdigest())
    assert expected[4][1:4] == (700_000, 1100, 2)
    assert expected[5][1:4] == (502, 500, 1)
    assert expected[6][1:4] == (1000, 1000, 1)
    assert expected[7][1:4] == (600, 600, 1)
    assert expected[None][1:4] == (1, 0, 0)


def test_empty_table(spark):
    assert m.suffix_dedup(documents(spark, [])).collect() == []


def test_groups_hold_all_occurrences(spark):
    rng = random.Random(9)
    shared = "".join(rng.choices("abcdefgh ", k=500))
    rows = [(i, f"{i}{i}" + shared[: 500 - i] + f"-{i}") for i in range(5)] + [(9, "nothing")]
    found = defaultdict(set)
    for r in m.repeat_groups(documents(spark, rows), 400).collect():
        found[r.group_id, r.length].add((r.doc_id, r.start))
        assert shared[:500].startswith(rows[r.doc_id][1][2:][: r.start - 2 + r.length][: r.start - 2])
    # Every repeated string lies in a group that holds all five documents.
    assert any({d for d, _ in members} == {0, 1, 2, 3, 4} for members in found.values())


def test_groups_of_frequent_repeats(spark):
    """Groups are the same whatever counts as frequent, and repeated rows are occurrences of their own."""
    rng = random.Random(13)
    shared = "".join(rng.choices("abcdefgh ", k=450))
    rows = [(i, f"{i}-" + shared + f"-{i}") for i in range(12)] + [(20, "x" + shared)] * 3
    blocks = pack(documents(spark, rows), block_bytes=2000)

    def groups(hot):
        found = defaultdict(list)
        for r in m.repeats(blocks, 400, m.occurrences, m.GROUP_SCHEMA, with_groups=True, hot=hot).collect():
            found[r.group_id, r.length, r.n_occurrences].append((r.doc_id, r.start))
        assert all(len(places) == n for (_, _, n), places in found.items())
        return Counter((length, tuple(sorted(places))) for (_, length, _), places in found.items())

    assert groups(4) == groups(m.HOT) and groups(4)
    found = defaultdict(list)
    for r in m.repeat_groups(documents(spark, rows), 400).collect():
        found[r.group_id, r.n_occurrences].append(r.doc_id)
    assert all(len(ids) == n for (_, n), ids in found.items())
    assert any(sorted(ids) == [*range(12), 20, 20, 20] for ids in found.values())


def test_intervals_of_a_run():
    # Prefixes 0 5 5 3: the inner interval's left bytes differ, so do those of the whole.
    assert list(m.maximal_intervals([0, 5, 5, 3], [97, 98, 97, 97])) == [(5, 0, 2), (3, 0, 3)]
    assert list(m.maximal_intervals([0, 5, 3], [97, 97, 98])) == [(3, 0, 2)]


def plain_repeats(strings, length):
    """Maximal repeats of strings as {(length, places)}, and the bytes that they cover, one substring at a time."""
    places = defaultdict(set)
    for i, s in enumerate(strings):
        for size in range(length, len(s) + 1):
            for at in range(len(s) - size + 1):
                places[s[at : at + size]].add((i, at))
    groups = set()
    for text, where in places.items():
        before = {strings[i][at - 1] if at else None for i, at in where}
        after = {strings[i][at + len(text)] if at + len(text) < len(strings[i]) else None for i, at in where}
        if len(where) > 1 and (len(before) > 1 or None in before) and (len(after) > 1 or None in after):
            groups.add((len(text), frozenset(where)))
    gone = {(i, at + k) for text, where in places.items() if len(where) > 1 for i, at in where for k in range(len(text))}
    return groups, gone


@pytest.mark.parametrize("length", [64, 100])
def test_repeats_of_strings(length):
    rng = random.Random(length)
    text = lambda n: bytes(rng.choices(b"ab\0", k=n))
    passages = [text(length + 20), text(length + 5), b"xy" * length]
    strings = {text(rng.randint(0, 15)) + rng.choice(passages)[rng.randint(0, 4) :] + text(rng.randint(0, 15)) for _ in range(12)}
    strings = sorted(s for s in {*strings, text(length), text(3 * length)} if len(s) >= length)
    which, begin, stop, found = m.repeats_of(strings, length)
    groups, gone = plain_repeats(strings, length)
    spans = zip(which.tolist(), begin.tolist(), stop.tolist(), strict=True)
    assert {(i, at) for i, x, y in spans for at in range(x, y)} == gone
    assert {(int(d), frozenset(zip(w.tolist(), p.tolist(), strict=True))) for d, w, p in found} == groups and groups


def test_only_parts_that_may_repeat_reach_the_suffix_array(monkeypatch):
    """Strings that share a gram but no string of the length cost no suffix array; others are cut to what they share."""
    rng = random.Random(17)
    text = lambda n: bytes(rng.choices(b"abcdefgh", k=n))
    gram, shared, seen = text(32), text(410), []
    array = m.suffix_array
    monkeypatch.setattr(m, "suffix_array", lambda strings, length: seen.extend(strings) or array(strings, length))
    apart = [text(360) + gram + text(370) for _ in range(20)]
    assert [len(x) for x in m.repeats_of(apart, 400)] == [0, 0, 0, 0] and seen == []
    which, begin, stop, _ = m.repeats_of([*apart, text(300) + b"1" + shared + b"2", b"3" + shared + b"4" + text(50)], 400)
    assert seen == [shared, shared]
    assert sorted(zip(which.tolist(), begin.tolist(), stop.tolist(), strict=True)) == [(20, 301, 711), (21, 1, 411)]
