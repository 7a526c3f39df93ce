"""Words in repeated windows, against a brute-force version."""

import hashlib
import random
import re
from collections import Counter

import pytest

from tests.llm.tables import documents
from tierflow.llm.blocks import pack
from tierflow.llm.substring_dedup import COVER, PERIOD, RESULT, dedup_blocks, deduplicated, digest, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = [WORD.findall(text or "") for _, text in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=repr)


def sample(seed, n_docs=60, vocabulary=400):
    rng = random.Random(seed)
    word = lambda: rng.choice("añz") * rng.randint(0, 2) + str(rng.randint(0, vocabulary))
    passages = [[word() for _ in range(rng.randint(20, 90))] for _ in range(8)]
    rows = []
    for i in range(n_docs):
        parts = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            parts += p[rng.randint(0, 10) : len(p) - rng.randint(0, 10)] if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 60))]
        rows.append((i, "".join(w + rng.choice([" ", "\n", "  ", "\t", "\r\n"]) for w in parts)))
    return rows


def test_cover_holds_every_difference():
    assert {(x - y) % PERIOD for x in COVER for y in COVER} == set(range(PERIOD))


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("block_bytes", [300, 1 << 20])
def test_equals_brute_force(spark, seed, block_bytes):
    rows = sample(seed) + [(100, "x " * 50), (101, "y " * 35), (102, "z " * 34), (103, "z " * 36)]
    df = dedup_blocks(pack(documents(spark, rows), block_bytes=block_bytes), 35, digest, RESULT)
    assert got(df) == brute(rows, 35)


def test_odd_rows(spark):
    long = " ".join(str(i) for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b"), (5, long), (6, "start " + long), (7, "a b  c"), (7, "a b  c")]
    same = [(8, " ".join(map(str, range(100, 160))))] * 3
    df = substring_dedup(documents(spark, rows + same, clashing=True))
    assert got(df) == brute(rows + same, 35)


def test_empty_table(spark):
    assert substring_dedup(documents(spark, [])).collect() == []


def test_kept_texts(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(1, f"one {shared} two"), (2, f"three\n{shared}")]
    assert sorted(map(tuple, deduplicated(documents(spark, rows)).collect())) == [(1, "one two"), (2, "three")]
