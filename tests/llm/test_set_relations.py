"""Classes of the n-gram Jaccard join, against all pairs."""

import random
import re

import numpy as np
import pytest

from tests.llm.tables import documents
from tierflow.llm import set_relations as s
from tierflow.llm.blocks import pack
from tierflow.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    n_links = [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                root[find(i)] = find(j)
                n_links[i] += 1
                n_links[j] += 1
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    each = enumerate(zip(rows, sets, strict=True))
    return sorted(((d, len(x), least.get(find(i)), n_links[i]) for i, ((d, _), x) in each), key=repr)


def without_links(rows):
    return sorted((r[:3] for r in rows), key=repr)


def got(df):
    columns = [c for c in ("doc_id", "n_shingles", "component_id", "n_links") if c in df.columns]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def sample(seed):
    """Texts, and copies of them at all distances around the limit."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    line = [[word() for _ in range(12)] for _ in range(5)]
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 6, 30, 80, 200]))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy += rng.choice(line)
            text = " ".join(copy)
            rows.append((len(rows), text.upper() if rng.random() < 0.2 else text))
    rng.shuffle(rows)
    return rows + [(900, "É a"), (901, "é a"), (902, "A B"), (903, "a\tb")]


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_pairs(spark, seed):
    rows = sample(seed)
    blocks = pack(documents(spark, rows), block_bytes=3000)
    assert got(s.classes(blocks, with_links=True)) == brute(rows)
    if seed == 0:
        assert got(s.classes(blocks)) == without_links(brute(rows))


def test_groups_in_parts(spark):
    """One passage chain: each copy is near the next one only, and the group is cut into parts."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(base)))
        for _ in range(2):
            base[rng.randrange(len(base))] = f"n{rng.random()}"
    rows += [(100 + i, rows[i][1]) for i in range(0, 60, 7)]
    blocks = pack(documents(spark, rows), block_bytes=5000)
    assert got(s.classes(blocks, part_sets=8, with_links=True)) == brute(rows)
    assert got(s.classes(blocks, part_sets=8)) == without_links(brute(rows))


def test_answers_are_derived_from_a_similar_query():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, 90).astype(np.uint64)) for _ in range(20)]
    for i in range(1, 20):
        keep = rng.random(len(sets[i - 1])) < 0.9
        sets[i] = np.unique(np.append(sets[i - 1][keep], rng.integers(0, 300, 6).astype(np.uint64)))
    sizes = np.array([len(x) for x in sets])
    group = s.Group(np.arange(20), sizes, sets)
    for i in range(20):
        names = group.names[i]
        want = [j for j in range(20) if s.linked(len(np.intersect1d(names, group.names[j])), group.sizes[i], group.sizes[j])]
        assert group.answers(names, int(group.sizes[i])).tolist() == want
        assert group.before[3].tolist() == group.histogram(names, *group.before[1:3]).tolist()


def test_odd_rows(spark):
    long = " ".join(str(i) for i in range(40_000))
    rows = [(1, None), (2, ""), (3, "\n "), (None, "a b c"), (5, "A b C"), (6, long), (7, long + " x"), (7, long + " x"), (None, "q r s t u v"), (None, "q r s t u v")]
    assert got(s.set_relations(documents(spark, rows, clashing=True), with_links=True)) == brute(rows)
    assert got(s.set_relations(documents(spark, rows, clashing=True))) == without_links(brute(rows))


def test_empty_table(spark):
    assert s.set_relations(documents(spark, [])).collect() == []
    assert s.one_of_each(documents(spark, [])).collect() == []


def test_one_of_each(spark):
    rows = [(4, "a b c d e f"), (2, "A B C D E F"), (2, "a b c d e f"), (None, "a b c d e f"), (9, None), (9, None), (8, "z"), (None, "n o"), (None, "n o")]
    df = s.one_of_each(documents(spark, rows))
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = sorted(((r.doc_id, (r.text or "").lower()) for r in df.collect()), key=repr)
    assert kept == sorted([(2, "a b c d e f"), (9, ""), (9, ""), (8, "z"), (None, "n o")], key=repr)


def test_one_of_each_tells_classes_apart_without_ids(spark):
    texts = ["a b c d e f", "g h i j k l", "m n o p q r", "s t u v w x"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1].upper()), (5, texts[2]), (5, texts[3]), (5, texts[3])]
    kept = sorted(((r.doc_id, r.text.lower()) for r in s.one_of_each(documents(spark, rows)).collect()), key=repr)
    assert kept == sorted([(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3])], key=repr)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 30)] + [(5, 5)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(51)} | {1000 + i: 1000 for i in range(30)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
