"""Quality rules: cross-document line frequency.

Lines are normalised (A-Z lower-cased, blanks squeezed) and hashed. A line that stands in more
than `max_documents` different documents of a host is removed from all but the first of them, the
one with the least `doc_id`; so of a text that a host repeats endlessly one stays. A document that
has too few words left is rejected. Documents of equal text count as one, whatever their ids, and
`source` is the host; NULL is a host of its own.

`line_frequency` gives the counts and verdicts per row, `cleaned` the documents with those lines really
removed. Both reject by one rule: too few of a document's words left, each line counted as often as
it stands.

Base rules apply as well: too short, or too much of the text made of repeated three-word windows.

Only built-in functions run. The texts are read once into narrow rows (metrics, and hash and word
count of each line), which are written to the shared folder; the rest works on those.
Counts combine before each shuffle, so no line, however common, puts its rows into one task.

NULL text has no words and fails the base rules. Repeated rows get equal answers. A table without
rows gives none. Only `doc_id`, `text` and `source` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.llm.words import BLANKS, WORD, let, lower_ascii, words
from tierflow.operators.skew import SMALL_ROWS, is_small, sent
from tierflow.session import materialize

MAX_DOCUMENTS = 100
# Of 100 words so many must be left.
MIN_LEFT = 30
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"


def repeat_words(w: Column) -> Column:
    """Words in three-word windows that the text holds twice or more."""

    def windows(w: Column) -> Column:
        return F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def places(hashes: Column) -> Column:
        """Places of windows whose hash occurs again, in order."""
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(ordered, lambda s: F.filter(s, lambda x, k: same(s, x, k)))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def same(s: Column, x: Column, k: Column) -> Column:
        return F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"])

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.coalesce(F.get(at, k + 1) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    def counted(hashes: Column) -> Column:
        # Most texts hold some repeat; a set of hashes tells cheaply which do not.
        none = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(none, F.lit(0).cast("long")).otherwise(let(places(hashes), covered))

    own = let(w, lambda v: F.slice(windows(v), 1, F.greatest(F.size(v) - 2, F.lit(0))))
    return let(own, counted)


def lines_of(text: Column) -> Column:
    """Lines that hold a word, as they stand."""
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))


def normalised(line: Column) -> Column:
    return F.array_join(words(lower_ascii(line)), " ")


def measured(docs: DataFrame) -> DataFrame:
    """Narrow rows: the metrics of each text, and hash and words of each line."""
    symbols = F.translate(F.col("text"), SYMBOLS, "")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("host"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    rows = rows.select("*", words(F.col("text")).alias("w"), lines_of(F.col("text")).alias("l"))
    lines = F.transform(
        F.transform("l", normalised), lambda line: F.struct(F.xxhash64(line).alias("line"), F.size(words(line)).alias("words"))
    )
    return rows.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("content"),
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.translate(F.col("text"), BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(symbols)).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        lines.alias("lines"),
    )


def frequent_lines(rows: DataFrame, max_documents: int) -> DataFrame:
    """Lines of a host above the limit, with the first document that holds each."""
    lines = rows.select("host", "content", "doc_id", F.explode("lines").alias("l")).select(
        "host", F.col("l.line").alias("line"), "content", "doc_id"
    )
    once = lines.groupBy("host", "line", "content").agg(F.min("doc_id").alias("first"))
    counts = once.groupBy("host", "line").agg(F.count("*").alias("documents"), F.min("first").alias("first"))
    return counts.where(F.col("documents") > max_documents)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def counted(docs: DataFrame, max_documents: int) -> tuple[DataFrame, DataFrame]:
    """Narrow rows with a number, and the frequent lines (host, line, first)."""
    numbered = measured(docs).withColumn("row", F.monotonically_increasing_id())
    # Written once, so the row numbers are fixed.
    rows = materialize(numbered, "lines")
    frequent = materialize(frequent_lines(rows, max_documents), "frequent-lines")
    return rows, frequent.select("host", "line", "first")


def judged(docs: DataFrame, max_documents: int, min_left: int) -> DataFrame:
    """Narrow rows with their verdict; (doc_id, host, content) tells rows of different verdicts apart."""
    rows, frequent = counted(docs, max_documents)
    if is_small(frequent):
        frequent = F.broadcast(frequent)
    lines = rows.select("row", "host", "doc_id", F.explode("lines").alias("l"))
    lines = lines.select("row", "host", "doc_id", F.col("l.line").alias("line"), F.col("l.words").alias("words")).alias("a")
    f = frequent.alias("f")
    hit = F.col("a.host").eqNullSafe(F.col("f.host")) & (F.col("a.line") == F.col("f.line"))
    other = ~F.col("a.doc_id").eqNullSafe(F.col("f.first"))
    gone = lines.join(f, hit & other).groupBy("a.row").agg(F.sum("a.words").alias("gone"))
    all_words = F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + x["words"])
    out = rows.select("*", all_words.alias("line_words")).join(gone, "row", "left")
    left = F.col("line_words") - F.coalesce("gone", F.lit(0))
    failed = base_failed()
    return out.select(
        "doc_id",
        "host",
        "content",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (100 * left >= min_left * F.col("line_words"))).alias("kept"),
        left.cast("long").alias("n_words_left"),
    )


def line_frequency(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, min_left: int = MIN_LEFT) -> DataFrame:
    """Per row: doc_id, the metrics, base_failed, kept, and n_words_left without the frequent lines."""
    return judged(docs, max_documents, min_left).drop("host", "content")


def own_names(df: DataFrame, *names: str) -> list[str]:
    """Names that `df` doesn't use, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def same_row(doc_id: str, host: str, content: str) -> Column:
    """Whether a document is the one with these values."""
    return (
        F.col("doc_id").cast("long").eqNullSafe(F.col(doc_id))
        & F.col("source").cast("string").eqNullSafe(F.col(host))
        & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col(content))
    )


def passing(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, min_left: int = MIN_LEFT) -> DataFrame:
    """The documents that are kept, with all their columns."""
    names = own_names(docs, "_doc_id", "_host", "_content")
    rejected = judged(docs, max_documents, min_left).where(~F.col("kept"))
    rejected = rejected.select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "host", "content"), names, strict=True)]).distinct()
    return docs.join(sent(materialize(rejected, "rejected")), same_row(*names), "left_anti")


# ---- lines removed ---------------------------------------------------------------------------


def held_lines(docs: DataFrame) -> DataFrame:
    """(host, doc_id, content, line): the hash of each different line of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("source").cast("string").alias("host"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("content"),
        F.array_distinct(F.transform(lines_of(text), lambda line: F.xxhash64(normalised(line)))).alias("lines"),
    )
    return rows.select("host", "doc_id", "content", F.explode("lines").alias("line"))


def kept_lines(docs: DataFrame, max_documents: int) -> DataFrame:
    """(host, line, first, keeper): the frequent lines, and the one document that keeps each. Written once.

    That is the one with the least id, NULL last, and of those the one with the least content hash.
    Counts combine before each shuffle.
    """
    holder = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    once = held_lines(docs).groupBy("host", "line", "content").agg(F.min(holder).alias("holder"))
    keeper = F.min(F.struct("holder", "content")).alias("keeper")
    counts = once.groupBy("host", "line").agg(F.count("*").alias("documents"), keeper)
    out = counts.where(F.col("documents") > max_documents)
    return materialize(out.select("host", "line", F.col("keeper.holder.doc_id").alias("first"), F.col("keeper.content").alias("keeper")), "kept-lines")


def in_parts(lines: Column) -> Column:
    """An array of (line, ...) as about as many parts as each then holds, so that none is searched from end to end."""
    n = F.ceil(F.sqrt(F.size(lines))).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.filter(lines, lambda x: F.pmod(x["line"], n) == i))


def without_lines(text: Column, parts: Column, doc_id: Column) -> Column:
    """The text without the lines in `parts` that another document keeps, wherever they stand; lines without a word stay."""

    def goes(own: Column, h: Column) -> Column:
        part = F.get(parts, F.pmod(h, F.size(parts)).cast("int"))
        return F.exists(part, lambda x: (x["line"] == h) & ~(x["first"].eqNullSafe(doc_id) & (x["keeper"] == own)))

    def stays(own: Column, line: Column) -> Column:
        return ~(line.rlike(WORD) & let(F.xxhash64(normalised(line)), lambda h: goes(own, h)))

    return F.array_join(let(F.xxhash64(text), lambda own: F.filter(F.split(text, "\n", -1), lambda line: stays(own, line))), "\n")


def by_broadcast(docs: DataFrame, kept: DataFrame, parts: str) -> DataFrame:
    """Documents with a column `parts`: the frequent lines of their host, which are few and go to all tasks."""
    per_host = kept.groupBy("host").agg(F.collect_list(F.struct("line", "first", "keeper")).alias("all"))
    per_host = materialize(per_host.select("host", in_parts(F.col("all")).alias("parts")), "lines-by-host")
    (host,) = own_names(docs, "_host")
    lookup = F.broadcast(per_host.select(F.col("host").alias(host), F.col("parts").alias(parts)))
    return docs.join(lookup, F.col("source").cast("string").eqNullSafe(F.col(host)), "left")


def by_shuffle(docs: DataFrame, kept: DataFrame, parts: str) -> DataFrame:
    """Documents with a column `parts`: the frequent lines that each holds itself, met by line and then by document."""
    names = own_names(docs, "_doc_id", "_host", "_content")
    a, f = held_lines(docs).alias("a"), kept.alias("f")
    hit = F.col("a.host").eqNullSafe(F.col("f.host")) & (F.col("a.line") == F.col("f.line"))
    other = ~(F.col("a.doc_id").eqNullSafe(F.col("f.first")) & (F.col("a.content") == F.col("f.keeper")))
    found = a.join(f, hit & other).groupBy("a.doc_id", "a.host", "a.content")
    found = found.agg(F.collect_set(F.struct("f.line", "f.first", "f.keeper")).alias("all"))
    found = found.select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "host", "content"), names, strict=True)], in_parts(F.col("all")).alias(parts))
    return docs.join(sent(materialize(found, "lines-by-document")), same_row(*names), "left")


def cleaned(
    docs: DataFrame, max_documents: int = MAX_DOCUMENTS, min_left: int = MIN_LEFT, small_rows: int = SMALL_ROWS
) -> DataFrame:
    """The documents without their host's frequent lines, but for those that fail or have too few words left.

    Other columns than the text stay as they are, sizes of the text as well, whatever their names.
    While the frequent lines measure small, no text is shuffled; beyond that each document meets its own.
    """
    kept = kept_lines(docs, max_documents)
    name, text = own_names(docs, "_parts", "_cleaned")
    rows = (by_broadcast if is_small(kept, small_rows) else by_shuffle)(docs, kept, name)
    parts = F.col(name)
    doc_id = F.col("doc_id").cast("long")
    w = words(F.coalesce(F.col("text"), F.lit("")))
    short = lambda w, n: (n < MIN_WORDS) | (100 * repeat_words(w) > 50 * n)

    def left_over(w: Column) -> Column:
        enough = lambda t: 100 * F.size(words(t)) >= min_left * F.size(w)
        new = let(without_lines(F.col("text"), parts, doc_id), lambda t: F.when(enough(t), F.array(t)))
        return F.when(~short(w, F.size(w)), F.when(parts.isNull(), F.array("text")).otherwise(new))

    # A rejected document has no text here; exploding leaves it out, and every text is worked on once.
    rows = rows.select(*docs.columns, F.explode(let(w, left_over)).alias(text))
    return rows.select(*[F.col(text).alias(c) if c == "text" else F.col(c) for c in docs.columns])
