"""Token counts, against a public implementation of the same tokenizer."""

import os
import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from tests.llm.tables import documents
from tierflow.llm import unigram_counts as u

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def tokenizer(vocabulary):
    t = Tokenizer(models.Unigram(vocabulary.pieces, vocabulary.unknown, vocabulary.bytes_for_unknown))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=False)
    return t


def counted(t, text):
    return len(t.encode(text, add_special_tokens=False).ids) if text else 0


def texts(seed, letters="abcde \n é漢▁"):
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(400)]


@pytest.mark.skipif(not os.path.exists(MODEL), reason="vocabulary file not present")
def test_public_vocabulary(spark):
    vocabulary = u.Vocabulary.read(MODEL)
    assert vocabulary.cuts()
    t = tokenizer(vocabulary)
    prose = ["The quick  brown fox, it's 2024!\n\nNew   line\tand tab", "Straße über ñandú 漢字 🙂 <0x0A> <s> ▁x", " lead", "trail ", "   "]
    long = " ".join(random.Random(1).choices(["alpha", "beta", "of", "the", "internationalisation", "x" * 90], k=20_000))
    rows = [(i, x) for i, x in enumerate([*prose, *texts(3, "The quick, étranger 12\n"), long, "y" * 5000, "", None])]
    got = {r.doc_id: r.n_tokens for r in u.unigram_counts(documents(spark, rows, clashing=True), vocabulary).collect()}
    assert got == {i: counted(t, x) for i, x in rows}


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("seed", range(3))
def test_small_vocabularies_with_ties(seed, fallback):
    """Few letters and whole scores: many paths tie. Without byte fallback unknown runs count once."""
    rng = random.Random(seed)
    names = {"".join(rng.choices("abcd▁", k=rng.randint(1, 4))) for _ in range(25)}
    pieces = [("<unk>", 0.0)] + [(p, -float(rng.randint(1, 6))) for p in sorted(names)]
    if fallback:
        pieces += [(f"<0x{i:02X}>", 0.0) for i in range(256)]
    vocabulary = u.Vocabulary(pieces, 0, fallback)
    t, known = tokenizer(vocabulary), u.Remembered(vocabulary)
    for x in texts(seed):
        assert u.count_tokens(x, vocabulary, known) == counted(t, x), x


def test_scores_that_round_are_not_cut():
    assert not u.Vocabulary([("<unk>", 0.0), ("a", -0.1)]).cuts()
    assert not u.Vocabulary([("<unk>", 0.0), ("a▁b", -1.0)]).cuts()
    assert u.Vocabulary([("<unk>", 0.0), ("▁▁a", -1.0)]).cuts()


def test_empty_table(spark):
    assert u.unigram_counts(documents(spark, []), u.Vocabulary([("<unk>", 0.0)])).collect() == []
