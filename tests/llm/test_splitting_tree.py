"""Targets, draws and the splitting tree of the mix."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.tables import documents, odd_documents
from tierflow.llm import splitting_tree as m


def water_fill(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Deal the budget by weight; what exceeds a limit is dealt again until nothing does."""
    w = [weights[i % 3] for i in range(len(sizes))]
    target = [0.0] * len(sizes)
    free = [i for i in range(len(sizes)) if sizes[i]]
    for i in range(len(sizes)):
        if i not in free:
            w[i] = 0
    budget = share * sum(sizes)
    while free:
        level = budget / sum(w[i] for i in free)
        over = [i for i in free if level * w[i] > most * sizes[i]]
        if not over:
            for i in free:
                target[i] = level * w[i]
            break
        for i in over:
            target[i] = most * sizes[i]
            budget -= target[i]
            free.remove(i)
    return target


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 5, 0, 40, 7, 300], [5], [10_000, 1, 1, 1, 1], [0, 0]])
def test_targets(spark, sizes):
    names = ["", "B", "a", "b", "é", "ü", None][-len(sizes) :]
    df = spark.createDataFrame([(n, s, 1) for n, s in zip(names, sizes, strict=True)], "source string, source_size long, n_rows long")
    got = {r.source: r.target for r in m.targets(df).collect()}
    assert [got[n] for n in names] == pytest.approx(water_fill(sizes))


@pytest.mark.parametrize("shards", [1, 2, 5, 16])
def test_tree_deals_exact_quotas(spark, shards):
    quotas = {0: 300, 1: 7, 2: 0, 3: 93}
    units = spark.createDataFrame(list(quotas.items()), "number long, units long")
    rows = m.splitting_tree(units, shards).collect()
    per_shard = Counter()
    for number, quota in quotas.items():
        own = sorted((r.shard, r.first, r["last"]) for r in rows if r.number == number)
        # Disjoint ranges in a row that hold the whole quota.
        assert own[0][1] == 0 and own[-1][2] == quota
        assert all(a[2] == b[1] for a, b in zip(own, own[1:], strict=False))
        for shard, first, last in own:
            per_shard[shard] += last - first
    assert max(per_shard.values()) - min(per_shard.values()) <= 1
    assert sorted(map(tuple, m.splitting_tree(units, shards).collect())) == sorted(map(tuple, rows))


def test_split_follows_the_hypergeometric_law(spark):
    """Mean and variance of the draws of one source out of three."""
    df = spark.range(3000).select(m.split(F.array(*[F.lit(x).cast("long") for x in (30, 50, 20)]), F.lit(40).cast("long"), F.xxhash64("id")).alias("s"))
    draws = [r.s for r in df.collect()]
    assert all(sum(d) == 40 and d[0] <= 30 and d[1] <= 50 and d[2] <= 20 for d in draws)
    for i, k in enumerate((30, 50, 20)):
        p = k / 100
        mean = sum(d[i] for d in draws) / len(draws)
        variance = sum((d[i] - mean) ** 2 for d in draws) / len(draws)
        assert mean == pytest.approx(40 * p, abs=0.25)
        assert variance == pytest.approx(40 * p * (1 - p) * 60 / 99, rel=0.12)


def mix_of(spark, rows, **options):
    narrow = m.narrow(documents(spark, rows))
    draws, sources = m.draws(narrow, **options)
    by_row = {r.row: r for r in narrow.collect()}
    return by_row, draws.collect(), {r.source: r for r in sources.collect()}


def test_words_come_near_their_targets(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice("abbcccdddd")) for i in range(2500)]
    by_row, draws, sources = mix_of(spark, rows, block_rows=50)
    taken, times, shards = Counter(), Counter(), defaultdict(set)
    for d in draws:
        taken[by_row[d.row].source] += by_row[d.row].size
        times[d.row] += 1
        shards[d.row, d["pass"]].add(d.shard)
    assert max(times.values()) <= 2
    assert all(abs(taken[s] - r.target) <= 2 for s, r in sources.items())
    # Each time that a row is taken it is in one shard, and the shards are near in size.
    assert all(len(x) == 1 for x in shards.values())
    assert len({d.shard for d in draws}) == 16
    assert len({(d.row, d["pass"]) for d in draws}) == len(draws)


def test_reruns_agree_whatever_the_partitions(spark):
    rows = odd_documents()
    key = lambda r: repr(tuple(r))
    first = sorted(m.splitting_mix(documents(spark, rows)).collect(), key=key)
    again = sorted(m.splitting_mix(documents(spark, rows[::-1]).repartition(7)).collect(), key=key)
    assert first == again and len(first) == len(rows)


def test_mixed_documents(spark):
    rows = [(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(200)]
    docs = documents(spark, rows)
    out = m.mixed(docs)
    assert out.schema == docs.schema
    times = Counter(r.doc_id for r in out.collect())
    assert {r.doc_id: r.taken for r in m.splitting_mix(docs).collect()} == {i: times[i] * (i % 7 + 1) for i in range(200)}
    assert m.mixed(documents(spark, [])).collect() == []


def test_mixed_rows_of_any_names_and_blocks(spark):
    """The mix in place takes each document as often as the draws do."""
    rng = random.Random(7)
    rows = [(i % 500, "w " * rng.randint(0, 40), rng.choice(["a", "a", "b", None, "c"])) for i in range(900)] + odd_documents()
    docs = documents(spark, rows, clashing=True)
    for name in ("_row", "document", "of", "k", "row", "room", "open", "time", "passes", "block_", "text_"):
        docs = docs.withColumn(name, F.lit("clash"))
    key = lambda r: (r.doc_id, r.text, r.source)
    for block_rows in (20, 1000):
        out = m.mixed(docs, block_rows=block_rows)
        assert out.dtypes == docs.dtypes
        taken = Counter(map(key, out.collect()))
        words = Counter()
        for (doc_id, text, source), n in taken.items():
            words[doc_id] += len((text or "").split()) * n
        want = Counter()
        for r in m.splitting_mix(docs, block_rows=block_rows).collect():
            want[r.doc_id] += r.taken
        assert +words == +want


def test_mixed_stands_in_the_shards_of_the_tree(spark, tmp_path):
    """Each time that a document is taken it lies in the shard that the tree dealt it to, in the order of the shard."""
    rng = random.Random(21)
    rows = [(i, f"t{i} " + "w " * rng.randint(0, 40), rng.choice(["a", "a", "b", None, "c"])) for i in range(900)]
    docs = documents(spark, rows)
    by_row, draws, sources = mix_of(spark, rows, block_rows=20)
    want = defaultdict(list)
    for d in sorted(draws, key=lambda d: d.place):
        want[d.shard].append(by_row[d.row].doc_id)
    assert len(want) == m.SHARDS and {d["pass"] for d in draws} == {0, 1} and set(sources) == {"a", "b", None, "c"}
    for pieces in (1, 3):
        n_bytes = sum(len(t) for _, t, _ in rows)
        out = m.mixed(docs, block_rows=20, piece_bytes=-(-n_bytes * 3 // (2 * m.SHARDS * pieces)))
        assert out.rdd.getNumPartitions() == m.SHARDS * pieces
        got = defaultdict(list)
        for at, part in enumerate(out.select("doc_id").rdd.glom().collect()):
            got[at // pieces] += [r.doc_id for r in part]
        assert got == want
        # Written, as the pipeline writes it, the files are the shards.
        path = tmp_path / f"mix-{pieces}"
        out.write.parquet(str(path))
        for file in path.glob("part-*.parquet"):
            shard = int(file.name.split("-")[1]) // pieces
            ids = [r.doc_id for r in spark.read.parquet(str(file)).collect()]
            assert ids and str(ids)[1:-1] in str(want[shard])
