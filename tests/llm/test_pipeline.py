"""The stages of the pipeline, each against a plain version of its decision."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as p
from tests.llm.tables import documents
from tests.llm.test_greedy_tiling import brute as plain_tilings
from tests.llm.test_set_relations import brute as plain_classes
from tierflow.llm import splitting_tree
from tierflow.session import written

ITEM = "which of these planets is known to have the largest number of moons in the solar system today"


def corpus():
    rng = random.Random(11)
    text = lambda n: " ".join(f"{rng.choice('abcdef')}{rng.randint(0, 900)}" for _ in range(n))
    rows = [(i, text(120), rng.choice(["s1", "s2", "s3"])) for i in range(60)]
    rows += [(100 + i, rows[i][1] + f" tail{i}", "s1") for i in range(8)]  # near copies
    rows += [(200 + i, rows[20][1], "s2") for i in range(4)]  # exact copies
    rows += [(300, text(80) + " " + ITEM + " " + text(10), "s3")]
    rows += [(400, "too short", "s1"), (401, None, "s1"), (402, "spam spam spam " * 40, None)]
    return rows


def benchmark(spark, folder):
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages(spark, tmp_path):
    benchmark(spark, tmp_path)
    rows = corpus()
    docs = documents(spark, rows)
    schema = docs.schema
    seen = {}
    for name, stage in p.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "sharding":
            assert docs.schema == schema, name
        docs = docs.persist()
        seen[name] = sorted((r.doc_id, r.text) for r in docs.collect())
    good = [(i, t) for i, t, _ in rows if i < 400]
    assert seen["quality_rules"] == sorted(good)
    least = {d: c for d, _, c in plain_classes(good)}
    one = sorted((i, t) for i, t in good if least[i] == i)
    assert seen["near_duplicates"] == one and len(one) == 61
    bad = {d for d, *_ in plain_tilings(one, [(1, ITEM)], 5, 50)}
    assert bad == {300}
    clean = [x for x in one if x[0] not in bad]
    assert seen["decontamination"] == clean
    times = Counter(seen["mixing"])
    assert set(times) <= set(clean) and max(times.values()) <= 2
    words = sum(len(t.split()) * n for (_, t), n in times.items())
    assert abs(words - 1.5 * sum(len(t.split()) for _, t in clean)) < 400
    assert seen["sharding"] == seen["mixing"]
    assert docs.columns[7:] == ["text", "lang", "source", "n_chars"]


def test_mixing_deals_the_documents_to_the_shards_of_the_tree(spark, tmp_path):
    docs = documents(spark, [(i, t, s) for i, t, s in corpus() if i < 400])
    rows = splitting_tree.narrow(docs)
    ids = {r.row: r.doc_id for r in rows.collect()}
    want = [[] for _ in range(splitting_tree.SHARDS)]
    for d in sorted(splitting_tree.draws(rows)[0].collect(), key=lambda d: d.place):
        want[d.shard].append(ids[d.row])
    out = p.mixing(spark, docs, str(tmp_path))
    assert [[r.doc_id for r in part] for part in out.select("doc_id").rdd.glom().collect()] == want
    assert sum(map(bool, want)) > 1


def test_run(spark, tmp_path):
    benchmark(spark, tmp_path)
    documents(spark, corpus()).write.parquet(f"{tmp_path}/documents.parquet")
    out = p.run(spark, str(tmp_path))
    names = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "text", "lang", "source", "n_chars"]
    assert out.columns == names
    assert out.count() > 60


def test_any_columns(spark, tmp_path):
    """Columns that clash with names used inside pass through all stages."""
    benchmark(spark, tmp_path)
    docs = documents(spark, corpus(), clashing=True)
    for name in ("_gone", "_doc_id", "_host", "_content", "_found", "_row", "document", "law", "slot", "row", "k"):
        docs = docs.withColumn(name, F.lit("clash"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plain = ("size", "shard", "law", "slot")
    out = p.run(spark, str(tmp_path)).select(*[f"document_{c}" if c in plain else c for c in docs.columns if c != "doc_id"])
    assert {tuple(r)[4:] for r in out.collect()} == {("clash",) * (len(docs.columns) - 5)}


def test_intermediates_are_removed(spark, tmp_path):
    """After a run what its last stage reads and wrote is left, and nothing after a stage of the next run."""
    benchmark(spark, tmp_path)
    documents(spark, corpus()).write.parquet(f"{tmp_path}/documents.parquet")
    before = set(written())
    p.run(spark, str(tmp_path)).collect()
    left = set(written()) - before
    assert len([f for f in left if f not in p._left]) == 1 and len(left) < 8


def test_no_documents(spark, tmp_path):
    benchmark(spark, tmp_path)
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).collect() == []
