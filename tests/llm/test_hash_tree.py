"""Shards of a weighted tree, against the same draws in Python."""

import hashlib
import math
from collections import Counter
from dataclasses import replace

import pytest

from tests.llm.tables import documents, odd_documents
from tierflow.llm import hash_tree as h
from pyspark.sql import functions as F


def descend(key, shards):
    """Level by level: the child whose own draw is least."""
    label = ""
    for level in (("generation", "region"), ("rack",), ("number",)):
        draws = {}
        for s in shards:
            child = ".".join([label, *(str(getattr(s, f)) for f in level)])
            draws.setdefault(child, []).append(s)
        def draw(child):
            digits = int(hashlib.md5(f"{key}:{child}".encode()).hexdigest()[: h.DIGITS], 16)
            return -math.log((digits + 0.5) / 16**h.DIGITS) / sum(s.weight for s in draws[child])  # noqa: B023
        label = min(draws, key=draw)
        shards = draws[label]
    return shards[0].number


WEIGHTED = [h.Shard(0, 0, 0, 2.0), h.Shard(0, 0, 1, 1.0), h.Shard(0, 1, 2, 4.0), h.Shard(1, 2, 5, 1.0), h.Shard(1, 3, 7, 0.5)]


def placed(spark, n, **trees):
    return h.place(spark.range(n).select(F.col("id").alias("doc_id")), F.col("doc_id").cast("string"), trees).collect()


def test_weighted_tree(spark):
    rows = placed(spark, 4000, shard=WEIGHTED)
    assert all(r.shard == descend(r.doc_id, WEIGHTED) for r in rows)
    counts, total = Counter(r.shard for r in rows), sum(s.weight for s in WEIGHTED)
    assert all(abs(counts[s.number] - 4000 * s.weight / total) < 150 for s in WEIGHTED)


def test_movement_stays_where_weights_change(spark):
    region = {s.number: s.region for s in WEIGHTED}
    heavier = [replace(s, weight=3.0) if s.number == 5 else s for s in WEIGHTED]
    # The weights of one rack change places: its own weight stays.
    shifted = [replace(s, weight={0: 1.0, 1: 2.0}.get(s.number, s.weight)) for s in WEIGHTED]
    rows = placed(spark, 4000, shard=WEIGHTED, heavier=heavier, shifted=shifted)
    assert all(r.heavier == descend(r.doc_id, heavier) for r in rows)
    moved = [r for r in rows if r.heavier != r.shard]
    assert moved and all(region[r.heavier] == 1 for r in moved)
    inside = [r for r in rows if r.shifted != r.shard]
    assert inside and all({r.shard, r.shifted} == {0, 1} for r in inside)


def test_what_is_added_takes_rows_only_into_itself(spark):
    heavier = h.added(WEIGHTED, [h.Shard(1, 2, 5, 2.0)])
    wider = h.added(heavier, [h.Shard(0, 1, 9, 1.0), h.Shard(1, 3, 10, 2.0)])
    rows = placed(spark, 4000, shard=WEIGHTED, heavier=heavier, wider=wider)
    assert all(r.heavier in (r.shard, 5) and r.wider in (r.heavier, 9, 10) for r in rows)
    assert all(r.wider == descend(r.doc_id, wider) for r in rows)
    counts = Counter(r.wider for r in rows)
    assert all(abs(counts[number] - 4000 * w / 13.5) < 150 for number, w in {0: 2.0, 2: 4.0, 5: 3.0, 9: 1.0, 10: 2.0}.items())


@pytest.mark.parametrize("n", [1, 2, 4, 7, 8, 16, 31])
def test_one_more_shard_takes_rows_only_into_itself(spark, n):
    rows = placed(spark, 2000, shard=h.even_tree(n), after=h.one_more(h.even_tree(n)))
    moved = [r for r in rows if r.after != r.shard]
    assert all(r.after == n for r in moved)
    assert abs(len(moved) - 2000 / (n + 1)) < 5 * math.sqrt(2000 / (n + 1))


def test_levels_decide(spark):
    """Shards by the tree are not those of the least draw of all shards."""
    tree = h.even_tree(16)
    flat = [replace(s, region=0, rack=0) for s in tree]
    rows = placed(spark, 1000, shard=tree, flat=flat)
    assert sum(r.shard != r.flat for r in rows) > 800


def test_slots_have_no_gaps(spark, monkeypatch):
    monkeypatch.setattr(h, "SLOT_ROWS", 20)
    monkeypatch.setattr(h, "COPY_ROWS", 7)
    rows = [(i % 300, f"text {i % 50}") for i in range(900)] + [(5, "hot")] * 100 + [(None, None)] * 30
    out = h.hash_tree(documents(spark, rows, clashing=True), h.even_tree(4)).collect()
    assert len(out) == len(rows)
    for shard in range(4):
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert {r.grown_shard for r in out} == {None}


def test_bad_weights_are_refused(spark):
    df = documents(spark, [(1, "a")])
    with pytest.raises(ValueError):
        h.hash_tree(df, [h.Shard(0, 0, 0, 0.0)])
    with pytest.raises(ValueError):
        h.hash_tree(df, [h.Shard(0, 0, 0), h.Shard(0, 0, 0, 2.0)])


def test_documents_keep_their_columns(spark):
    """Shards and slots are those of the narrow rows, and nothing of the documents is lost."""
    docs = documents(spark, odd_documents(), clashing=True)
    trees = h.even_tree(5), h.even_tree(6)
    out = h.sharded(docs, *trees)
    narrow = h.hash_tree(docs, *trees)
    assert sorted(map(repr, out.select(*narrow.columns).collect())) == sorted(map(repr, narrow.collect()))
    assert out.columns[:7] == narrow.columns[:1] + ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    back = out.select(*[f"document_{c}" if c in ("size", "shard") else c for c in docs.columns]).toDF(*docs.columns)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, docs.collect()))
    assert h.sharded(docs, trees[0]).where("grown_shard IS NOT NULL").count() == 0
