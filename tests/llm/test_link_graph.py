"""Ranks over host edges, against a loop."""

import random

import pytest

from tierflow.llm.link_graph import spread


@pytest.mark.parametrize("seed", range(2))
def test_personalised_ranks(spark, seed):
    rng = random.Random(seed)
    hosts = [f"h{i}" for i in range(12)]
    edges = {(rng.choice(hosts), rng.choice(hosts)): rng.randint(1, 5) for _ in range(30)}
    seeds = {h: rng.choice([0.0, 0.5, 1.0]) for h in hosts}
    out = {h: sum(n for (s, _), n in edges.items() if s == h) for h in hosts}
    rank = {h: 0.3 * s for h, s in seeds.items()}
    for _ in range(6):
        rank = {h: 0.3 * seeds[h] + sum(0.7 * rank[s] * n / out[s] for (s, t), n in edges.items() if t == h) for h in hosts}
    df = spread(
        spark.createDataFrame(list(seeds.items()), "host string, seed double"),
        spark.createDataFrame([(s, t, n) for (s, t), n in edges.items()], "source string, target string, links long"),
        0.7,
        6,
    )
    got = {r.host: r["rank"] for r in df.collect()}
    assert all(got.get(h, 0.0) == pytest.approx(r, abs=1e-12) for h, r in rank.items())


@pytest.mark.parametrize("linkers", [1, 10, 1000])
def test_linkers_of_a_blocked_host(spark, linkers):
    """Who links to a blocked host only is blocked, however many do; who mostly links elsewhere or is trusted is not."""
    link = lambda *hosts: " ".join(f'<a href="http://{h}/">' for h in hosts)
    rows = [(i, f"http://linker{i}.org/", link("bad.net")) for i in range(linkers)]
    rows += [
        (-1, "http://bad.net/es/1", None),
        (-2, "http://mixed.org/", link("bad.net", "plain.org", "plain.org")),
        (-3, "http://plain.org/", None),
        (-4, "http://known.org/", link("bad.net")),
        (-5, "http://good.com/", link("known.org")),
        (-6, "http://second.org/", link(*[f"linker{i}.org" for i in range(linkers)])),
    ]
    from tierflow.llm.link_graph import link_graph

    verdicts = {r.page_id: r.verdict for r in link_graph(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {verdicts[i] for i in range(linkers)} == {"block"}
    assert verdicts[-2] == verdicts[-3] == verdicts[-4] == "allow"
    assert verdicts[-6] == "block"  # all it links to link to blocked hosts
