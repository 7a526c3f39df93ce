"""Cross-document line frequency with small limits, and the documents that pass."""

from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm.tables import documents, odd_documents
from tierflow.llm import line_frequency as q


def normal(line):
    return " ".join("".join(c.lower() if "A" <= c <= "Z" else c for c in line).translate(str.maketrans("\t\v\f\r", "    ")).split(" ")).split()


def verdicts(rows, limit, min_left):
    """(n_words_left, kept) per row by plain loops; a line counts as often as it stands."""
    lines = [[" ".join(n) for x in (t or "").split("\n") if (n := normal(x))] for _, t, _ in rows]
    texts, first = defaultdict(set), {}
    for (doc_id, t, host), own in zip(rows, lines, strict=True):
        for x in own:
            texts[host, x].add(t)
            if doc_id is not None:
                first[host, x] = min(first.get((host, x), doc_id), doc_id)
    out = []
    for (doc_id, t, host), own in zip(rows, lines, strict=True):
        words = sum(len(x.split(" ")) for x in own)
        left = sum(len(x.split(" ")) for x in own if len(texts[host, x]) <= limit or first.get((host, x)) == doc_id)
        out.append((left, 100 * left >= min_left * words))
    return out


def test_frequent_lines_deplete_documents(spark):
    page = "Home News About\n\tIMPRINT\n"
    body = lambda i: " ".join(f"own{i}x{j}" for j in range(60))
    rows = [(i, page * 20 + f"{i} words", "a") for i in range(6)]
    rows += [(10 + i, page + body(i), "a") for i in range(3)]
    rows += [(20, page * 20, "b"), (21, page * 20, None), (22, None, "a"), (23, "", "a")]
    rows += [(30 + i, body(99), "c") for i in range(9)]
    got = {r.doc_id: r for r in q.line_frequency(documents(spark, rows, clashing=True), max_documents=5, min_left=60).collect()}
    want = dict(zip([r[0] for r in rows], verdicts(rows, 5, 60), strict=True))
    for i, r in got.items():
        assert r.n_words_left == want[i][0], i
        assert r.kept == (not r.base_failed and want[i][1]), i
    # Unique text with a common head, and equal texts however many, are kept.
    assert all(got[i].kept for i in [10, 11, 12, *range(30, 39)])


def test_passing(spark):
    rows = odd_documents()
    docs = documents(spark, rows)
    kept = q.passing(docs, max_documents=20)
    assert kept.schema == docs.schema
    answers = q.line_frequency(docs, max_documents=20)
    key = lambda r: repr(r.doc_id)
    assert sorted(map(key, kept.collect())) == sorted(map(key, answers.where("kept").collect()))


def without_frequent(rows, limit, min_left):
    """(doc_id, text) of rows that pass by plain loops; repeated lines count as often as they stand."""
    name = lambda line: " ".join(normal(line))
    holders = defaultdict(set)
    for doc_id, t, host in rows:
        for line in t.split("\n"):
            holders[host, name(line)].add((doc_id, t))
    out = []
    for doc_id, t, host in rows:
        left = []
        for line in t.split("\n"):
            own = holders[host, name(line)]
            first = min({i for i, _ in own}, key=lambda i: (i is None, i))
            keepers = {x for i, x in own if i == first}
            if not normal(line) or len({x for _, x in own}) <= limit or (doc_id == first and (len(keepers) == 1)):
                left.append(line)
        if 100 * len(normal(" ".join(left))) >= min_left * len(normal(t)):
            out.append((doc_id, "\n".join(left)))
    return out


def test_frequent_lines_are_removed(spark):
    body = lambda i, n=60: "\n".join(" ".join(f"own{i}x{j}y{k}" for k in range(6)) for j in range(n // 6))
    head, foot = "Home\tNews  about us", "imprint and terms of use"
    rows = [(i, f"{head}\n\n{body(i)}\n{foot.upper()}\n{head.lower()}\n", "a") for i in range(6)]
    rows += [(None, f"{head}\n{body(50)}", "a"), (20, f"{head}\n{body(20)}", "b"), (21, f"{body(21)}\n{foot}", None)]
    # One line fills most of the text by repetition: of different lines most is left, of the words little.
    menu = " ".join(f"menu{k}" for k in range(20))
    spread = lambda i: "\n".join(f"{menu}\n{' '.join(f'd{i}e{k}f{j}' for k in range(4))}" for j in range(12))
    rows += [(30 + i, spread(i), "c") for i in range(7)]
    docs = documents(spark, rows, clashing=True)
    kept = q.cleaned(docs, max_documents=5, min_left=30)
    assert kept.schema == docs.schema
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    failed = {r.doc_id for r in q.line_frequency(docs).where("base_failed").collect()}
    want = [x for x in without_frequent(rows, 5, 30) if x[0] not in failed]
    assert got == sorted(want, key=repr)
    assert {i for i, _ in got} >= {0, 1, 2, 3, 4, 5, None, 20, 21}
    assert (1, f"\n{body(1)}\n") in got and head in dict(got)[0] and head not in dict(got)[None]
    shuffled = q.cleaned(docs, max_documents=5, min_left=30, small_rows=0)
    assert shuffled.schema == docs.schema
    assert sorted(((r.doc_id, r.text) for r in shuffled.collect()), key=repr) == got


def test_any_names(spark):
    """Columns with the names that the stage itself uses, or would."""
    names = ["_gone", "_doc_id", "_host", "_content", "_found", "_parts", "_cleaned", "_text", "__host", "Parts", "first", "keeper"]
    docs = documents(spark, [(i, "a line on every page\n" + " ".join(f"w{i}x{k}" for k in range(60)), "a") for i in range(7)])
    for name in names:
        docs = docs.withColumn(name, F.lit("clash"))
    for out in (q.cleaned(docs, 5), q.cleaned(docs, 5, small_rows=0), q.passing(docs, 5)):
        assert out.columns == docs.columns and {tuple(r)[5:] for r in out.collect()} == {("clash",) * len(names)}
        assert out.count() == 7


def test_many_lines_of_a_host(spark):
    """Lists of lines are searched in parts."""
    lines = lambda i: "\n".join(f"common line {k}" for k in range(i, 120 + i))
    rows = [(i, lines(i) + "\n" + " ".join(f"w{i}x{k}" for k in range(300)), "a") for i in range(9)]
    got = sorted((r.doc_id, r.text) for r in q.cleaned(documents(spark, rows), 5, 0).collect())
    assert got == without_frequent(rows, 5, 0)


def test_repeated_lines_deplete_by_their_words(spark):
    line = " ".join(f"menu{k}" for k in range(9))
    unique = lambda i: " ".join(f"w{i}x{k}" for k in range(50))
    # 36 of 86 words are the line's, though only 9 of its different lines' 59: query and documents agree.
    rows = [(i, f"{line}\n" * 4 + unique(i), "a") for i in range(7)]
    docs = documents(spark, rows)
    assert {r.doc_id for r in q.line_frequency(docs, 5, 60).where("kept").collect()} == {0}
    assert {r.doc_id for r in q.passing(docs, 5, 60).collect()} == {0}
    assert {r.doc_id for r in q.cleaned(docs, 5, 60).collect()} == {0}


def test_without_an_id_one_document_keeps_its_line(spark):
    line, body = "a line on every page", lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(None, f"{line}\n{body(i)}", "a") for i in range(7)] + [(None, f"{line}\n{body(0)}", "a")]
    texts = [r.text for r in q.cleaned(documents(spark, rows), 5).collect()]
    assert len(texts) == 8 and len({t for t in texts if line in t}) == 1
