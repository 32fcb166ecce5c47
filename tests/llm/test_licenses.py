"""License scan: base places by brute force, planted and altered notices, edge rows."""

from __future__ import annotations

import re

import numpy as np
import pytest

from fieldkpi.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, words string, label string, k1 long, span int"
MIT, APACHE, GPL, LGPL, BSD = (
    next(t.text for t in reversed(licenses.TEMPLATES) if t.label == x)
    for x in ("mit", "apache", "gpl", "lgpl", "bsd")
)


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def base(text):
    got = words(text)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        part = phrase.split()
        for i in range(len(got) - len(part) + 1):
            if got[i : i + len(part)] == part:
                places.append(i)
                labels.add(label)
    return places, labels


def altered(text, rng, swaps, drops=0):
    out = text.split()
    for i in rng.choice(np.arange(6, len(out) - 6), swaps, replace=False):
        out[i] = "zzz"
    for i in sorted(rng.choice(np.arange(6, len(out) - 6), drops, replace=False))[::-1]:
        del out[i]
    return " ".join(out)


@pytest.fixture(scope="module")
def report(spark):
    rng = np.random.default_rng(5)
    fill = " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60))
    texts = {
        0: "MIT License mit-license! MIT\n\nLICENSE the mit",
        1: "gnu General Public LICENSE general public public license general public license",
        2: "Äpache license, Apache2 license; apache licenses",
        3: None,
        4: "",
        5: " \t\x00 ...",
        6: f"{fill} {MIT} {fill}",
        7: f"{fill} {altered(MIT, rng, 4, 2)} {fill}",
        8: f"{fill} {LGPL} {fill} {BSD}",
        9: f"{fill} {' '.join(rng.permutation(MIT.split()))}",
        10: fill,
        11: "permission is hereby granted free of charge to all who came " + fill,
        12: "Licensed under CC BY-NC 4.0.",
        13: ("word " * 150_000) + APACHE + (" general public license" * 3000),
        14: "license",
        15: "mit",
        16: f"{GPL.upper()} İstanbul",
    }
    rows = [(i, t, "x", "y", 1, 2) for i, t in texts.items()]
    rows += [(None, texts[6], None, None, None, None), (6, texts[6], "", "", 0, 0), (6, fill, "", "", 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = licenses.license_report(docs).collect()
    assert len(out) == len(rows)
    return texts, out


def test_base_places_match_brute_force(report):
    texts, out = report
    for row in out:
        if row.doc_id in texts and row.doc_id != 6:
            places, labels = base(texts[row.doc_id])
            assert row.n_words == len(words(texts[row.doc_id]))
            assert row.n_base == len(places)
            assert row.first_word == (min(places) if places else None)
            assert row.last_word == (max(places) if places else None)
            assert row.base_labels == ",".join(sorted(labels))
            assert labels <= set(row.labels.split(",")) | {""}
            assert 0.0 <= row.score <= 1.0


def test_notices_are_found_whole_and_altered(report):
    got = {r.doc_id: r for r in report[1] if r.doc_id not in (6, None)}
    assert got[7].labels == "mit" and 0.6 <= got[7].score < 1.0
    assert got[8].labels == "bsd,gpl,lgpl" and got[8].base_labels == "gpl"
    assert got[12].labels == "cc-by-nc" and got[12].score == 1.0
    assert got[13].labels == "apache,gpl"
    assert got[16].labels == "gpl"


def test_clean_shuffled_and_short_texts_stay_alone(report):
    got = {r.doc_id: r for r in report[1]}
    for i in (3, 4, 5, 9, 10, 11, 14, 15):
        assert (got[i].labels, got[i].score) == ("", 0.0), i
    assert got[3].n_words == got[4].n_words == got[5].n_words == 0


def test_rows_of_one_id_are_judged_by_their_own_text(report):
    shared = sorted((r.labels, r.n_words) for r in report[1] if r.doc_id in (6, None))
    assert [x for x, _ in shared] == ["", "mit", "mit", "mit"]
    assert len({n for x, n in shared if x}) == 1


def test_spans_say_where(spark):
    docs = spark.createDataFrame([(1, "a b c " + MIT + " d e"), (2, "a b c " + MIT + " d e")], "doc_id long, text string")
    (span,) = licenses.license_spans(docs).collect()
    n = len(words(MIT))
    assert (span.first_word, span.last_word, span.share, span.diagonals) == (3, 3 + n - 1, 1.0, 1)
    gap = MIT.replace("without limitation", "without any known limitation")
    (span,) = licenses.license_spans(spark.createDataFrame([(1, gap)], "doc_id long, text string")).collect()
    assert span.diagonals == 2 and span.first_word == 0 and span.last_word == n + 1


def test_empty_table(spark):
    assert licenses.license_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_words_are_cut_once_and_nothing_is_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = licenses.license_report(docs)._jdf.queryExecution().optimizedPlan().toString()
    lambdas = [line for line in plan.split("\n") if "lambdafunction" in line]
    assert lambdas and not any("split(" in x.split("lambdafunction", 1)[1] for x in lambdas if "filter(split(" not in x)
    assert "Python" not in plan and "Pandas" not in plan
