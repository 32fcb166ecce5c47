"""Rows without id, texts under one id, clashing column names: a third of the rows, whole results."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldkpi.llm import common, fixity, mixing, neardup, repeats, severity, shards

WORDS = [f"word{i}" for i in range(400)]


def sentences(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(21)
    out = [(i, sentences(rng, int(rng.integers(3, 40))), f"s{i % 2}") for i in range(200)]
    return out + [(None, sentences(rng, int(rng.integers(3, 40))), "s0") for _ in range(100)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    names = ["twin", "_twin", "_text", "document_key", "same_id", "times", "copy", "expected_severity", "_severity"]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    return df.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in names})


def test_hash_collision_of_texts_without_id(spark):
    """Two texts whose 32-bit hashes agree: only the one that stands twice is removed."""
    rng = np.random.default_rng(7)
    seen, pair, n = {}, None, 0
    while pair is None:
        texts = ["".join(rng.choice(list("abcdefghij"), 320)) for _ in range(20_000)]
        hashes = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.hash("t").alias("h")).collect()
        for r in hashes:
            if r.h in seen and seen[r.h] != r.t:
                pair = (seen[r.h], r.t)
            seen[r.h] = r.t
        n += 1
        if n == 12:
            pytest.skip("no two of 240,000 texts agree")
    df = spark.createDataFrame([(None, pair[0]), (None, pair[1]), (1, pair[1])], "doc_id long, text string")
    found = repeats.without_repeats(df).collect()
    kept = {hashlib.sha256(pair[0].encode()).hexdigest(): 0, hashlib.sha256(b"").hexdigest(): 320}
    assert Counter((r.kept_sha256, r.n_removed) for r in found) == Counter(
        {(h, n): 1 if n == 0 else 2 for h, n in kept.items()}
    )


def test_texts_of_one_id_are_linked_each_by_its_own(spark):
    rng = np.random.default_rng(5)
    a, b, c = (sentences(rng, 60) for _ in range(3))
    df = spark.createDataFrame(
        [(7, a), (7, b), (3, a), (9, b + " more"), (5, c), (None, c), (7, a)], "doc_id long, text string"
    )
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in neardup.near_duplicates(df, k=4).collect())
    assert got == sorted(
        [(7, 57, 3, False), (7, 57, 7, True), (3, 57, 3, True), (9, 58, 7, False), (5, 57, 5, True), (0, 57, 0, True), (7, 57, 3, False)]
    )


def test_columns_of_the_caller_stay(docs, rows):
    before = {r.doc_id: r for r in docs.where("doc_id IS NOT NULL").collect()}
    labels = docs.sparkSession.createDataFrame([(i, 1, int(i % 20 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    for out in (mixing.mixed_documents(docs), neardup.keep_one_of_each(docs), severity.keep_clean(docs, labels)):
        assert out.columns == docs.columns
        for r in out.where("doc_id IS NOT NULL").collect():
            assert r == before[r.doc_id]


def test_rows_without_id_are_spread_over_the_ranges(docs):
    plan = mixing.mix_plan(docs, keep=["twin"])
    assert plan.count() == 300
    draws = docs.where("doc_id IS NULL").select(F.countDistinct(F.xxhash64(F.lit(17), "doc_id", "text"))).first()[0]
    assert draws == 100


def test_more_documents_have_more_ranges(docs, monkeypatch):
    monkeypatch.setattr(shards, "BUCKETS", 2)
    monkeypatch.setattr(shards, "RANGE_DOCS", 7)
    order = shards.training_order(docs, length=64)
    got = order.select("slot", "n_tokens").collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert sum(r.n_tokens for r in got) == sum(
        r.n for r in docs.select((F.octet_length("text") + 1).alias("n")).collect()
    )


def test_pages_without_id_are_in_files_of_their_own(spark):
    pages = [(i, f"http://h/{i}", f"body {i}") for i in range(30)] + [(None, f"http://n/{i}", f"body {i}") for i in range(60)]
    first = spark.createDataFrame(pages, "page_id long, url string, html string")
    second = spark.createDataFrame(pages[:40] + [(None, "http://n/10", "other")] + pages[41:], first.schema)
    records = fixity.page_records(first)
    loose = records.where("record_id IS NULL").groupBy("file").count().collect()
    assert len(loose) >= 58 and all(r.file < 0 for r in loose)
    audit = fixity.fixity_audit(records, fixity.page_records(second)).collect()
    assert sorted(r.fault for r in audit) == ["added", "missing"]
    again = fixity.page_records(first).collect()
    assert sorted(map(str, again)) == sorted(map(str, records.collect()))


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "Key int, key_ int")
    assert common.fresh(df, "key", "key", "other") == ("key__", "key___", "other")
