"""Token counts: a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates all pieces of the vocabulary in a text; going from left to
right, each place keeps the best score that reaches it and the number of pieces on that path, no
path itself. The rules are the tokenizer's: starts are taken in order, at one start shorter pieces
first, and only a strictly better score replaces what is known. A character without a piece of its
own may be passed as unknown at 10 below the least score; with byte fallback it counts its UTF-8
bytes, otherwise a run of unknown characters counts once.

Where no piece goes on past a space marker that follows other text, each best path passes the place
before it. Texts are then cut there, and counts of words that were met before are looked up. This
is exact when scores add up without rounding, as whole numbers do; `Vocabulary` checks both and
falls back to whole texts.

The vocabulary (bounded by the model file) goes to all tasks; texts stay where they are read.

NULL and empty texts have no tokens. Repeated rows get equal answers. A table without rows gives
none. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
# Words remembered by a task, and the length up to which they are.
REMEMBERED = 400_000
REMEMBERED_LENGTH = 64


@dataclass
class Vocabulary:
    """Pieces with scores. `bytes_for_unknown`: unknown characters become one token per byte."""

    pieces: list[tuple[str, float]]
    unknown: int | None = 0
    bytes_for_unknown: bool = True
    _ready: tuple | None = field(default=None, repr=False, compare=False)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """The pieces and scores of a sentencepiece model file, taken as a unigram vocabulary."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
        return cls(pieces, model.unk_id(), any(model.is_byte(i) for i in range(model.get_piece_size())))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None}

    def cuts(self) -> bool:
        """Whether texts may be cut before each space marker that follows other text."""
        whole = all(float(score).is_integer() and abs(score) < 2**31 for _, score in self.pieces)
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        return self.bytes_for_unknown and whole and not any(inner.search(p) or "\n" in p for p, _ in self.pieces)

    def automaton(self):
        """The automaton, the score of an unknown character, and whether texts may be cut."""
        if self._ready is None:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for i, (piece, score) in enumerate(self.pieces):
                if piece:
                    # The first of equal pieces counts.
                    if piece not in machine:
                        machine.add_word(piece, (len(piece), score, i == self.unknown))
            if len(machine):
                machine.make_automaton()
            least = min((score for _, score in self.pieces), default=0.0)
            self._ready = machine, least - UNKNOWN_PENALTY, self.cuts()
        return self._ready

    def count(self, text: str) -> int:
        """Tokens of a text whose spaces are markers already."""
        machine, unknown_score, _ = self.automaton()
        n = len(text)
        if not n:
            return 0
        # Per start: (length, score) of the pieces there, the shorter first.
        at: list[list | None] = [None] * n
        if len(machine):
            for end, (length, score, _) in machine.iter(text):
                start = end - length + 1
                if at[start] is None:
                    at[start] = [(length, score)]
                else:
                    at[start].append((length, score))
        best: list[float | None] = [None] * (n + 1)
        counts = [0] * (n + 1)
        after_unknown = [False] * (n + 1)
        best[0] = 0.0
        fallback = self.bytes_for_unknown
        for i in range(n):
            base = best[i]
            if base is None:
                continue
            single = False
            # Matches with one start are met in the order of their ends: shorter pieces first.
            for length, score in at[i] or ():
                j = i + length
                total = base + score
                if best[j] is None or total > best[j]:
                    best[j], counts[j], after_unknown[j] = total, counts[i] + 1, False
                single = single or length == 1
            if not single:
                total, j = base + unknown_score, i + 1
                if best[j] is None or total > best[j]:
                    best[j] = total
                    counts[j] = counts[i] + (len(text[i].encode("utf-8", "surrogatepass")) if fallback else int(not after_unknown[i]))
                    after_unknown[j] = True
        return counts[n]


class Remembered(dict):
    """Counts of words, found once."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        n = self.vocabulary.count(word)
        if len(word) <= REMEMBERED_LENGTH:
            self[word] = n
        return n


WORDS = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")


def marked(text: str) -> str:
    """Spaces as markers, with one in front."""
    text = text.replace(" ", SPACE)
    return text if text.startswith(SPACE) else SPACE + text


def count_tokens(text: str | None, vocabulary: Vocabulary, known: Remembered) -> int:
    if not text:
        return 0
    if not vocabulary.automaton()[2]:
        return vocabulary.count(marked(text))
    return sum(map(known.__getitem__, WORDS.findall(marked(text))))


def unigram_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per row: doc_id, n_chars (code points) and n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known = Remembered(own)
        for batch in batches:
            numbers, lengths = [], []
            for value in batch.column(1):
                text = value.as_py()
                if len(known) > REMEMBERED:
                    known.clear()
                lengths.append(len(text or ""))
                numbers.append(count_tokens(text, own, known))
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0).cast(pa.int64()),
                    "n_chars": pa.array(lengths, pa.int64()),
                    "n_tokens": pa.array(numbers, pa.int64()),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_chars long, n_tokens long")
