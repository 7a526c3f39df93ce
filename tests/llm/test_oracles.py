"""Queries with SQL, on tables of odd rows, without rows, and with columns that clash."""

import pytest

from tests.llm.tables import against_oracle, documents, odd_documents

OF_DOCUMENTS = ["op1_hash_tree", "op5_line_frequency", "op8_splitting_tree", "op10_entropy_secrets"]


@pytest.mark.parametrize("name", OF_DOCUMENTS)
def test_odd_documents(spark, tmp_path, name):
    assert against_oracle(spark, tmp_path, name, {"documents": documents(spark, odd_documents(), clashing=True)}) is None


@pytest.mark.parametrize("name", OF_DOCUMENTS)
def test_no_documents(spark, tmp_path, name):
    assert against_oracle(spark, tmp_path, name, {"documents": documents(spark, [])}) is None


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, verdict string")


def linked_pages():
    link = lambda *hosts: " ".join(f'<a HREF = "https://{h}/x">' for h in hosts) + "<a href='/self'>"
    return [
        (1, "http://good.com/a", link("mid.org", "mid.org", "Far.org"), "h", "v"),
        (2, "http://mid.org/b?x=1", link("far.org"), "h", "v"),
        (3, "https://far.org", link("mid.org") + "<a href=//other.org/y>", "h", "v"),
        (4, "http://bad.net/es/1", link("mid.org"), "h", "v"),
        (5, "http://bad.net/fr/1#t", None, "h", "v"),
        (6, "http://bad.net/de/1", "", "h", "v"),
        (7, "http://friend.org/1", link("bad.net", "bad.net", "bad.net"), "h", "v"),
        (8, "http://friend2.org/1", link("friend.org"), "h", "v"),
        (9, "http://x.EXAMPLE.com/en/1", link("bad.net"), "h", "v"),
        (10, "http://www.example.com/en/1", None, "h", "v"),
        (11, "http://notexample.com/en/1", None, "h", "v"),
        (12, "no scheme", link("bad.net"), "h", "v"),
        (13, None, link("bad.net"), "h", "v"),
        (None, "http://friend.org/1", link("friend2.org"), "h", "v"),
        (14, "http:///path", None, "h", "v"),
        (14, "http:///path", None, "h", "v"),
        (15, "http://half.net/es/1", None, "h", "v"),
        (16, "http://half.net/de/1", None, "h", "v"),
        (17, "http://some.net/es/1", None, "h", "v"),
        (18, "http://some.net/de/1", None, "h", "v"),
        (19, "http://some.net/de/2", None, "h", "v"),
    ]


def test_link_graph(spark, tmp_path):
    df = pages(spark, linked_pages())
    assert against_oracle(spark, tmp_path, "op7_link_graph", {"pages": df}) is None
    from tierflow.llm.link_graph import link_graph

    verdicts = {r.page_id: (r.rule, r.verdict) for r in link_graph(df).collect()}
    assert verdicts[6] == (None, "block")  # most pages of its host are blocked
    assert verdicts[7] == (None, "block")  # it links to a blocked host only
    assert verdicts[2] == verdicts[3] == (None, "allow")  # trusted hosts link to them
    assert verdicts[9] == ("example.com/en/", "block")
    assert verdicts[10] == ("www.example.com/en/", "allow")
    assert verdicts[11] == ("com/", "allow")
    assert verdicts[12] == verdicts[13] == verdicts[14] == (None, "allow")
    assert verdicts[16] == (None, "block") and verdicts[18] == (None, "allow")


def test_no_pages(spark, tmp_path):
    assert against_oracle(spark, tmp_path, "op7_link_graph", {"pages": pages(spark, [])}) is None
