"""Host verdicts against a plain power iteration on random graphs; registries and hosters."""

from __future__ import annotations

import numpy as np
import pytest

from fieldkpi.llm import hostrank

RULES = (("allow", "good", "/"), ("block", "bad", "/"))


def pages_of(spark, links, urls):
    rows = [(i, u, "".join(f'<a href="http://{t}/x">t</a>' for t in links.get(u, []))) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def scores_by_hand(hosts, edges, seeds, damping=0.85, rounds=400):
    index = {h: i for i, h in enumerate(hosts)}
    total = np.zeros(len(hosts))
    for (s, _), n in edges.items():
        total[index[s]] += n
    start = np.zeros(len(hosts))
    for h, v in seeds.items():
        start[index[h]] = v
    if start.sum():
        start /= start.sum()
    rank = start.copy()
    for _ in range(rounds):
        new = (1 - damping) * start
        for (s, d), n in edges.items():
            new[index[d]] += damping * rank[index[s]] * n / total[index[s]]
        rank = new
    return dict(zip(hosts, rank))


@pytest.mark.parametrize("seed", [1, 2])
def test_verdicts_match_power_iteration(spark, seed):
    rng = np.random.default_rng(seed)
    hosts = [f"h{i}.{'good' if i < 8 else 'bad' if i < 16 else 'net'}" for i in range(200)]
    edges, links = {}, {}
    for _ in range(500):
        s, d = rng.integers(0, 200, 2)
        if s != d:
            n = int(rng.integers(1, 4))
            edges[hosts[s], hosts[d]] = edges.get((hosts[s], hosts[d]), 0) + n
            links.setdefault(f"http://{hosts[s]}/p", []).extend([hosts[d]] * n)
    urls = [f"http://{h}/p" for h in hosts]
    found = {r.host: r for r in hostrank.url_verdicts(pages_of(spark, links, urls), RULES).collect()}
    trust = scores_by_hand(hosts, edges, {h: 1.0 for h in hosts if h.endswith("good")})
    back = {(d, s): n for (s, d), n in edges.items()}
    distrust = scores_by_hand(hosts, back, {h: 1.0 for h in hosts if h.endswith("bad")})
    verdicts = set()
    for h in hosts:
        if h.endswith("net"):
            assert found[h].verdict == ("block" if distrust[h] > trust[h] else "allow"), h
            verdicts.add(found[h].verdict)
        assert abs(found[h].trust - trust[h]) < 0.05 and abs(found[h].distrust - distrust[h]) < 0.05
    assert verdicts == {"allow", "block"}


def test_registries_and_hosters_tie_nobody(spark):
    rules = (("block", "evil.co.uk", "/"), ("block", "spam.blogspot.com", "/"), ("block", "www.ill.net", "/bad"))
    urls = [
        "http://evil.co.uk/", "http://fair.co.uk/", "http://www.evil.co.uk/", "http://shop.fair.co.uk/",
        "http://spam.blogspot.com/", "http://cook.blogspot.com/", "http://www.ill.net/bad", "http://www.ill.net/",
        "http://m.ill.net/", "http://well.net/", "http://10.0.0.1/", "http://11.0.0.1/",
    ]
    found = {r.host + r.path: r.verdict for r in hostrank.url_verdicts(pages_of(spark, {}, urls), rules).collect()}
    blocked = {k for k, v in found.items() if v == "block"}
    assert blocked == {"evil.co.uk/", "www.evil.co.uk/", "spam.blogspot.com/", "www.ill.net/bad", "www.ill.net/", "m.ill.net/"}


def test_ties_end_by_tolerance(spark):
    """Trust equals distrust everywhere: no margin ever suffices, the walk still ends."""
    rules = (("allow", "x.net", "/a"), ("block", "x.net", "/b"))
    urls = ["http://x.net/a", "http://x.net/b", "http://x.net/", "http://w.x.net/"]
    found = {r.path + r.host: r for r in hostrank.url_verdicts(pages_of(spark, {}, urls), rules).collect()}
    assert found["/w.x.net"].verdict == "allow"
    assert found["/w.x.net"].trust == pytest.approx(found["/w.x.net"].distrust)


def test_links_outweigh_domains(spark):
    links = hostrank.domain_links(spark.createDataFrame([("a.b.c.com",), ("c.com",), ("x.co.uk",), ("1.2.3.4",)], "host string"))
    got = sorted((r.src, r.dst) for r in links.collect())
    assert got == [("a.b.c.com", "b.c.com"), ("b.c.com", "a.b.c.com"), ("b.c.com", "c.com"), ("c.com", "b.c.com")]
    assert {r.n for r in links.collect()} == {hostrank.DOMAIN_WEIGHT} and hostrank.DOMAIN_WEIGHT < 1
