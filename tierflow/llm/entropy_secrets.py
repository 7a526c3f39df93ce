"""Secret scans: patterns, and sliding-window Shannon entropy of candidate strings.

Base spans come from three patterns. The method adds spans of candidate strings: runs of at least
20 characters that tokens are made of. A window of 20 characters slides over a candidate; the
entropy of the characters in it is kept as the sum of c * log2 c over their counts c, in whole
millionths, and each step changes that sum by the counts of the one character that leaves and the
one that enters. What counts as high depends on the character class (hexadecimal, letters,
alphanumeric, with symbols). The span runs from the first to the last window that is high enough.
Base spans are cut out of it, and what remains is reported where it has 12 characters or more.

The allow-list suppresses what is known to be harmless, and no more than that: a candidate that is
a UUID as a whole; a window that names itself a sample, while the other windows of its candidate
count; what remains of a span if it is words and numbers joined by punctuation, each word shorter
than a window. Longer words are judged by their entropy.

Only built-in functions run, without a shuffle: each text is handled where it is read. Places are
counted in code points; they follow from the lengths of the matches and of the pieces between
them, summed in chunks so that many matches in one text cost no more than linear work.

NULL is an empty text. Repeated rows get equal answers. A table without rows gives none. Only
`doc_id` and `text` are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.llm.words import let, running_sums

ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
# Kinds in order: name, pattern, group that must be long enough, least length.
KINDS = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))
# Where a match that is too short cannot hide a longer one, it need not be found in the first place.
SEARCH = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
ENTROPY = "entropy"

WINDOW = 20
MILLION = 1_000_000
# Least characters of what base spans leave of a span.
REST = 12
# Least bits per character of a window, by the class of its candidate: pattern, bits.
CLASSES = (("^[0-9A-Fa-f]+$", 3.0), ("^[A-Za-z]+$", 3.9), ("^[0-9A-Za-z]+$", 3.7), ("", 3.8))
# Harmless as a whole candidate: UUIDs.
UUID = r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
# Harmless in a window: it says that it is a sample.
SAMPLE = r"([Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Ss][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Xx]{6}|[0]{8}|12345678)"
# Harmless as what remains: words, each shorter than a window, and numbers joined by punctuation.
NAMES = rf"^[+/_=-]*([A-Za-z]{{1,{WINDOW - 1}}}|[0-9]+)([+/_=-]+([A-Za-z]{{1,{WINDOW - 1}}}|[0-9]+))*[+/_=-]*$"


def surprise(count: int) -> int:
    """c * log2 c in millionths."""
    return round(count * math.log2(count) * MILLION) if count else 0


def most_sum(bits: float) -> int:
    """The greatest sum of c * log2 c at which a window has so many bits per character."""
    return round(WINDOW * (math.log2(WINDOW) - bits) * MILLION)


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, text) of the pattern's matches, left to right without overlap."""

    def placed(found: Column) -> Column:
        def at(gaps: Column) -> Column:
            steps = F.zip_with(found, gaps, lambda m, g: F.char_length(m) + g)
            return F.transform(
                F.arrays_zip(running_sums(steps).alias("s"), gaps.alias("g"), found.alias("m")),
                lambda x: F.struct(
                    (x["s"] + x["g"]).alias("start"), (x["s"] + x["g"] + F.char_length(x["m"])).alias("end"), x["m"].alias("m")
                ),
            )

        pieces = F.split(text, pattern, -1)
        gaps = F.transform(F.slice(pieces, 1, F.size(found)), lambda p: F.char_length(p).cast("long"))
        return let(gaps, at)

    none = F.array().cast("array<struct<start:bigint,end:bigint,m:string>>")
    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def base_spans(text: Column) -> Column:
    """(start, rank, end) of the spans of the base patterns."""
    parts = []
    for rank, (name, pattern, group, least) in enumerate(KINDS):
        # The wanted group of a match: a match is matched by its own pattern once more.
        value = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)  # noqa: B023
        long = F.filter(matches(text, SEARCH.get(name, pattern)), lambda x: F.char_length(value(x["m"])) >= least)  # noqa: B023
        parts.append(F.transform(long, lambda x: F.struct(x["start"], F.lit(rank).alias("rank"), x["end"])))  # noqa: B023
    return F.concat(*parts)


def high_entropy(candidate: Column) -> Column:
    """(first, last) start of windows of high entropy, or NULL."""
    steps = F.array(*[F.lit(surprise(c + 1) - surprise(c)).cast("long") for c in range(WINDOW)])
    limit = F.when(F.lit(False), F.lit(None).cast("long"))
    for pattern, bits in CLASSES:
        limit = limit.when(candidate.rlike(pattern), F.lit(most_sum(bits)).cast("long"))

    def high(total: Column, most: Column, at: Column) -> Column:
        return (total <= most) & ~F.substring(candidate, at + 1, F.lit(WINDOW)).rlike(SAMPLE)

    def count(part: Column, c: Column) -> Column:
        return F.size(F.filter(part, lambda x: x == c))

    def slide(chars: Column) -> Column:
        # The first window is built by letting its characters in one by one.
        first = F.aggregate(
            F.sequence(F.lit(1), F.lit(WINDOW)),
            F.lit(0).cast("long"),
            lambda s, i: s + F.element_at(steps, 1 + count(F.slice(chars, 1, i - 1), F.get(chars, i - 1))),
        )
        def begin(s: Column) -> Column:
            at = F.when(high(s["sum"], s["limit"], F.lit(0)), F.lit(0)).cast("long")
            return F.struct(s["sum"].alias("sum"), s["limit"].alias("limit"), at.alias("first"), at.alias("last"))

        zero = let(F.struct(first.alias("sum"), limit.alias("limit")), begin)

        def step(s: Column, i: Column) -> Column:
            # Between window i - 1 and window i: all but one character stay.
            def change(stay: Column) -> Column:
                leaves = F.element_at(steps, 1 + count(stay, F.get(chars, i - 1)))
                enters = F.element_at(steps, 1 + count(stay, F.get(chars, i + WINDOW - 1)))
                return s["sum"] - leaves + enters

            def next_state(total: Column) -> Column:
                def found(here: Column) -> Column:
                    at = i.cast("long")
                    return F.struct(
                        total.alias("sum"),
                        s["limit"].alias("limit"),
                        F.when(s["first"].isNotNull(), s["first"]).when(here, at).alias("first"),
                        F.when(here, at).otherwise(s["last"]).alias("last"),
                    )

                return let(high(total, s["limit"], i), found)

            return let(let(F.slice(chars, i + 1, WINDOW - 1), change), next_state)

        windows = F.size(chars) - WINDOW
        rest = F.when(windows > 0, F.sequence(F.lit(1), F.greatest(windows, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return let(zero, lambda z: F.aggregate(rest, z, step))

    return let(F.split(candidate, ""), slide)


def remains(span: Column, base: Column) -> Column:
    """Array of (start, end): a span without the base spans, which are in order."""
    inside = F.filter(base, lambda y: (y["start"] < span["end"]) & (span["start"] < y["end"]))
    part = lambda start, end: F.struct(start.alias("start"), end.alias("end"))
    zero = F.struct(span["start"].alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("parts"))
    cut = F.aggregate(
        inside,
        zero,
        lambda s, y: F.struct(
            F.greatest(s["at"], y["end"]).alias("at"),
            F.when(s["at"] < y["start"], F.concat(s["parts"], F.array(part(s["at"], y["start"])))).otherwise(s["parts"]).alias("parts"),
        ),
    )
    return let(
        cut, lambda s: F.when(s["at"] < span["end"], F.concat(s["parts"], F.array(part(s["at"], span["end"])))).otherwise(s["parts"])
    )


def entropy_spans(text: Column, base: Column) -> Column:
    """(start, rank, end) of what base spans leave of candidates' windows of high entropy."""
    found = F.filter(matches(text, CANDIDATE), lambda x: ~x["m"].rlike(UUID))
    scored = F.transform(found, lambda x: F.struct(x["start"], x["m"], high_entropy(x["m"]).alias("at")))

    def parts(x: Column) -> Column:
        span = F.struct((x["start"] + x["at"]["first"]).alias("start"), (x["start"] + x["at"]["last"] + WINDOW).alias("end"))
        left = F.filter(let(span, lambda s: remains(s, base)), lambda p: p["end"] - p["start"] >= REST)
        # What remains is a part of the candidate: its place in there.
        text_of = lambda p: F.substring(x["m"], p["start"] - x["start"] + 1, p["end"] - p["start"])
        return F.transform(
            F.filter(left, lambda p: ~text_of(p).rlike(NAMES)),
            lambda p: F.struct(p["start"], F.lit(len(KINDS)).alias("rank"), p["end"]),
        )

    return F.flatten(F.transform(F.filter(scored, lambda x: x["at"]["first"].isNotNull()), parts))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit(ENTROPY))
    texts = F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"], x["end"]))
    return F.array_join(texts, ",")


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, and the spans of secrets as arrays of (start, rank, end), base and all."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("base", F.sort_array(base_spans(F.col("text"))))
    spans = let(F.col("base"), lambda base: F.sort_array(F.concat(base, entropy_spans(F.col("text"), base))))
    return rows.select("doc_id", "text", "base", spans.alias("spans"))


def entropy_secrets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256 and spans."""
    counts = [
        F.size(F.filter("base", lambda x: x["rank"] == rank)).cast("long").alias(f"n_{name}")  # noqa: B023
        for rank, (name, *_) in enumerate(KINDS)
    ]
    return scan(docs).select(
        "doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """Per row: doc_id and the text with every span replaced."""
    merged = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(
                x["start"] >= s["at"],
                F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), F.lit(mask)),
            ).otherwise(s["out"]).alias("out"),
        ),
    )
    return scan(docs).withColumn("m", merged).select(
        "doc_id", F.concat(F.col("m.out"), F.substring(F.col("text"), F.col("m.at") + 1, F.char_length("text"))).alias("text")
    )
