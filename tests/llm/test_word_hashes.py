"""Words made to collide in polynomials modulo 2^64 whatever the base: they are different words."""

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.tables import documents
from tierflow.llm import blocks as b
from tierflow.llm.greedy_tiling import greedy_tiling
from tierflow.llm.set_relations import one_of_each, set_relations
from tierflow.llm.substring_dedup import substring_dedup

LETTERS = 4096
THUE_MORSE = "".join("ab"[i.bit_count() % 2] for i in range(LETTERS))
SWAPPED = THUE_MORSE.translate(str.maketrans("ab", "ba"))
WORDS = [f"w{i}" for i in range(34)]


def hashes(texts, **how):
    text = b.Text.of(pa.array(texts))
    return b.word_hashes(text, b.Words.of(text), **how)


def test_polynomials_collide():
    """The reason for the other hash of long words."""
    prefix = [b.sums(b.BYTE_VALUES[np.frombuffer(w.encode(), np.uint8)]) for w in (THUE_MORSE, SWAPPED)]
    assert prefix[0][-1] == prefix[1][-1]


@pytest.mark.parametrize("base", [b.BASE, b.BASE_2])
@pytest.mark.parametrize("size", [1, 63, 64, 65, 66, 1024, LETTERS])
def test_words_differ(base, size):
    one, other, again = hashes([THUE_MORSE[:size] + "c", SWAPPED[:size] + "c", "x " + THUE_MORSE[:size] + "c"], base=base)[[0, 1, 3]]
    assert one == again != other
    lower, upper = hashes([THUE_MORSE[:size], THUE_MORSE[:size].upper()], lower=True, base=base)
    assert lower == upper


def test_bases_differ():
    texts = ["ab", "word", THUE_MORSE]
    assert not np.any(hashes(texts) == hashes(texts, base=b.BASE_2))


def test_windows_of_different_words_stay(spark):
    texts = [" ".join([*WORDS, w]) for w in (THUE_MORSE, SWAPPED)]
    rows = substring_dedup(documents(spark, list(enumerate(texts)))).collect()
    assert [r.n_removed for r in rows] == [0, 0]
    rows = substring_dedup(documents(spark, list(enumerate([*texts, texts[0]])))).collect()
    assert {r.doc_id: r.n_removed for r in rows} == {0: 35, 1: 0, 2: 35}


def test_sets_of_different_words_are_not_linked(spark):
    docs = documents(spark, [(0, THUE_MORSE), (1, SWAPPED), (2, THUE_MORSE.upper())])
    assert {r.doc_id: r.component_id for r in set_relations(docs).collect()} == {0: 0, 1: 1, 2: 0}
    assert sorted(r.doc_id for r in one_of_each(docs).collect()) == [0, 1]


def test_tiles_of_different_words(spark):
    item = spark.createDataFrame([(7, " ".join([*WORDS[:4], THUE_MORSE]))], "item_id long, text string")
    docs = documents(spark, [(i, " ".join([*WORDS[:4], w])) for i, w in enumerate((THUE_MORSE, SWAPPED))])
    assert [r.doc_id for r in greedy_tiling(docs, item).collect()] == [0]
