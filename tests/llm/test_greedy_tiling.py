"""Tilings, against the plain algorithm over all pairs of places."""

import random
import re

import pytest

from tests.llm.tables import documents
from tierflow.llm import greedy_tiling as g

WORD = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+")


def words(text):
    return [w.lower() for w in WORD.findall(text or "")]


def plain_tiles(doc, item, least):
    """Greedy string tiling as it is defined: look for the longest unmarked match, mark it, repeat."""
    marked_d, marked_i, tiles = set(), set(), []
    while True:
        best = None
        for j in range(len(item)):
            for i in range(len(doc)):
                k = 0
                while (
                    i + k < len(doc)
                    and j + k < len(item)
                    and doc[i + k] == item[j + k]
                    and i + k not in marked_d
                    and j + k not in marked_i
                ):
                    k += 1
                if k >= least and (best is None or k > best[0]):
                    best = (k, i, j)
        if best is None:
            return tiles
        tiles.append(best)
        marked_d.update(range(best[1], best[1] + best[0]))
        marked_i.update(range(best[2], best[2] + best[0]))


def brute(docs, items, least, coverage):
    out = []
    for doc_id, text in docs:
        for item_id, item in items:
            d, i = words(text), words(item)
            tiles = plain_tiles(d, i, least) if len(i) >= least else []
            covered = sum(t[0] for t in tiles)
            if tiles and 100 * covered >= coverage * len(i):
                out.append((doc_id, item_id, len(i), covered, len(tiles), max(t[0] for t in tiles)))
    return sorted(out, key=repr)


def benchmark(spark, items):
    return spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, seeds string")


def sample(seed):
    rng = random.Random(seed)
    word = lambda: f"{rng.choice(['a', 'é', 'Q'])}{rng.randint(0, 25)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 30)))) for i in range(6)]
    docs = []
    for n in range(25):
        parts = [" ".join(word() for _ in range(rng.randint(0, 20)))]
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items)[1].split()
            cut = rng.randint(0, len(w))
            parts.append(", ".join(w[cut:] + w[:cut]).upper() if rng.random() < 0.5 else " ".join(w[rng.randint(0, 3) :]))
        docs.append((n, "\n".join(parts)))
    return docs, items


@pytest.mark.parametrize("seed", range(4))
def test_equals_plain_tiling(spark, seed):
    docs, items = sample(seed)
    got = g.greedy_tiling(documents(spark, docs), benchmark(spark, items), 4, 50, part_bytes=200 if seed % 2 else g.PART_BYTES)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, 4, 50)


def test_reordered_passage_is_found(spark):
    item = "one two three four five six, seven eight nine ten eleven twelve. thirteen fourteen fifteen sixteen seventeen"
    docs = [
        (1, f"x thirteen fourteen fifteen sixteen seventeen y SEVEN EIGHT nine ten eleven twelve z {item[:27]} five six"),
        (2, "one two three four five but nothing else of it"),
        (3, " ".join(w if i % 5 else "x" for i, w in enumerate(item.split()))),
    ]
    rows = {r.doc_id: r for r in g.greedy_tiling(documents(spark, docs), benchmark(spark, [(7, item)])).collect()}
    assert set(rows) == {1} and rows[1].n_tiles == 3 and rows[1].n_covered == 17


def test_case_of_accented_letters_does_not_matter(spark):
    item = "los años de la niñez según él éramos únicos aquí"
    rows = g.greedy_tiling(documents(spark, [(1, item.upper() + "!!")]), benchmark(spark, [(3, item)])).collect()
    assert [(r.doc_id, r.n_covered) for r in rows] == [(1, 10)]


def test_odd_rows(spark):
    long = " ".join(str(i) for i in range(50_000))
    item = " ".join(str(i) for i in range(700, 740))
    docs = [(1, None), (2, ""), (None, item), (4, long), (4, long), (5, (item + " ") * 300), (6, "!!!")]
    items = [(1, None), (2, ""), (3, "a b"), (4, item), (4, item), (None, item)]
    got = g.greedy_tiling(documents(spark, docs, clashing=True), benchmark(spark, items)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(
        [(d, i, 40, 40, 1, 40) for d in (None, 4, 4, 5) for i in (4, 4, None)], key=repr
    )
    kept = g.decontaminated(documents(spark, docs), benchmark(spark, items), part_bytes=50)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 2, 6]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty_tables(spark):
    assert g.greedy_tiling(documents(spark, []), benchmark(spark, [(1, "a b c d e f")])).collect() == []
    assert g.greedy_tiling(documents(spark, [(1, "a b c d e f")]), benchmark(spark, [])).collect() == []
    assert g.decontaminated(documents(spark, [(1, "a b")]), benchmark(spark, [])).count() == 1
