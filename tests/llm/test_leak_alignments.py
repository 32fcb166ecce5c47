"""Benchmark leaks against a comparison of every alignment; long diagonals; short items."""

from __future__ import annotations

import re

import numpy as np

from fieldkpi.llm import leaks

DOCS = "doc_id long, text string, _leaked string, _key long, held int, covered int, item_id int"
ITEMS = "item_id long, text string, n_words string, tokens int"


def cut(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def densest(places):
    """Most equal words in a stretch of enough density, and its words (the first such)."""
    best = (0, 0)
    for a in range(len(places)):
        for b in range(a, len(places)):
            n, span = b - a + 1, places[b] - places[a] + 1
            if n >= leaks.MIN_DENSITY * span - 1e-9 and n > best[0]:
                best = (n, span)
    return best


def by_hand(doc, item):
    """Best alignment as (n_equal, -diagonal), among those that the rules accept."""
    accepted = []
    for diagonal in range(-len(item) + 1, len(doc)):
        places = [i for i, w in enumerate(item) if 0 <= i + diagonal < len(doc) and doc[i + diagonal] == w]
        n = len(places)
        whole = n >= min(leaks.MIN_EQUAL, len(item)) and n >= leaks.MIN_SHARE * len(item)
        if whole or (n >= leaks.MIN_RUN and densest(places)[0] >= leaks.MIN_RUN):
            accepted.append((n, diagonal))
    return accepted


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "a", 1, 2, 3, 4) for i, t in docs], DOCS).repartition(3),
        spark.createDataFrame([(i, t, "b", 5) for i, t in items], ITEMS),
    )


def test_all_alignments(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(60)]
    draw = lambda n: list(rng.choice(vocabulary, n))
    items = [(i, draw(int(rng.integers(5, 40)))) for i in range(25)]
    docs = []
    for d in range(60):
        text = draw(int(rng.integers(0, 80)))
        for _ in range(int(rng.integers(0, 3))):
            item = list(items[int(rng.integers(25))][1])
            for k in rng.choice(len(item), int(len(item) * rng.choice([0.0, 0.2, 0.4])), replace=False):
                item[k] = str(rng.choice(vocabulary))
            a = int(rng.integers(0, len(item)))
            part = item if rng.random() < 0.6 else item[a:]
            at = int(rng.integers(0, len(text) + 1))
            text[at:at] = part
        docs.append((d, text))
    df, bench = frames(spark, [(i, " ".join(t)) for i, t in docs], [(i, ", ".join(t)) for i, t in items])
    found = {(r.doc_id, r.item_id): r for r in leaks.leaked_passages(df, bench).collect()}
    want = {}
    for d, text in docs:
        for i, item in items:
            if accepted := by_hand(text, item):
                want[d, i] = accepted
    # Alignments of chance may lie under no seed; every one found is right and best.
    for pair, row in found.items():
        assert (row.n_equal, row.start) in want[pair]
    missed = set(want) - set(found)
    assert all(max(n for n, _ in want[p]) < leaks.MIN_EQUAL + 4 for p in missed) and len(missed) <= 0.02 * len(want)
    assert len(found) > 40


def test_a_phrase_many_times_on_both_sides_carries_no_texts(spark):
    item = "one two three four " * 10 + "and then some other words that stand alone here now"
    text = "one two three four " * 400
    df, bench = frames(spark, [(1, text), (None, text), (2, item)], [(7, item)])
    hits = leaks.seed_hits(df, leaks.benchmark_items(bench)).collect()
    assert max(len(r.covered) for r in hits) <= len(cut(item))
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_passages(df, bench).collect()} == {(1, 7), (None, 7), (2, 7)}


def test_short_items_are_found_as_whole_texts_only(spark):
    df, bench = frames(
        spark,
        [(1, "Yes, indeed!"), (2, "yes indeed it is"), (3, "indeed"), (4, ""), (5, None), (None, "yes indeed")],
        [(10, "yes indeed"), (11, "INDEED."), (12, ""), (13, None)],
    )
    got = sorted(((r.doc_id or 0), r.item_id, r.item_words, r.start, r.n_equal) for r in leaks.leaked_passages(df, bench).collect())
    assert got == [(0, 10, 2, 0, 2), (1, 10, 2, 0, 2), (3, 11, 1, 0, 1)]
    left = leaks.without_leaks(df, bench)
    assert sorted(r.doc_id for r in left.collect()) == [2, 4, 5] and left.columns == df.columns


def test_no_words_are_cut_inside_a_lambda(spark):
    df, bench = frames(spark, [(1, "a")], [(1, "a b c d e f")])
    for frame in (leaks.leaked_passages(df, bench), leaks.seed_hits(df, leaks.benchmark_items(bench))):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.split("\n"):
            if "lambdafunction(" in line:
                assert "split(" not in line.split("lambdafunction(", 1)[1].replace("transform(array_remove(split(", "")
        assert "Python" not in plan
