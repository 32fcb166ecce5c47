"""The corpus operators on small fixtures: edge rows, and results by brute force."""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldkpi.llm import (
    components,
    fixity,
    hostrank,
    leaks,
    mixing,
    neardup,
    repeats,
    secrets,
    severity,
    shards,
    vectors,
)

WORDS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string"


def prose(rng, n):
    letters = list(string.ascii_lowercase)
    return ["".join(rng.choice(letters, rng.integers(2, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    base = prose(rng, 120)
    out = [" ".join(base), " ".join(base), " ".join(base[:60] + ["zz"] + base[61:])]
    for share in (3, 8, 15, 30):
        changed = list(base)
        for i in rng.choice(len(base), share, replace=False):
            changed[i] = "q" * 3
        out.append(" ".join(changed))
    out += [" ".join(prose(rng, 80)) for _ in range(8)]
    out += [out[9][:150] + out[0][100:420], "a" * 450, "ab" * 300, "One two", "one TWO", "", " \t\n"]
    out += ["é" * 150, "word " * 5000, out[-9].upper()]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}", len(t), "x") for i, t in enumerate(texts)]
    rows += [(1000, None, None, None, None, None), (None, texts[0], None, "s1", 1, None)]
    rows += [(7, texts[7], "en", "s1", 1, "x")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def set_of(text, k):
    table = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    words = WORDS.findall((text or "").translate(table))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def test_near_duplicates_match_all_pairs(docs, empty):
    rows = {(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None}
    sets = {i: set_of(t, 4) for i, t in rows}
    group = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    found = neardup.near_duplicates(docs, 4).collect()
    assert len(found) == docs.count()
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            want = (len(sets[r.doc_id]), group[r.doc_id], group[r.doc_id] == r.doc_id)
            assert (r.n_shingles, r.component_id, r.kept) == want
    assert neardup.near_duplicates(empty, 4).count() == 0
    kept = neardup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 0 in ids and 1 not in ids and ids.count(7) == 1 and None in ids and 1000 in ids


def test_joint_similarity_is_near_the_truth():
    rng = np.random.default_rng(5)
    common, mine, theirs = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    rows = [np.concatenate([common, mine]), np.concatenate([common, theirs])]
    levels = [neardup.registers_of(np.zeros(900, int), v, 1, 1024) for v in rows]
    n = np.array([900])
    assert neardup.joint_similarity(*levels, n, n)[0] == pytest.approx(0.8, abs=0.05)
    # Sketches merge by the greater register.
    union = neardup.registers_of(np.zeros(1000, int), np.concatenate([common, mine, theirs]), 1, 1024)
    assert (np.maximum(*levels) == union).all()


def test_repeats_match_brute_force(docs, empty):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = Counter(b[k : k + 200] for _, b in rows for k in range(len(b) - 199))
    want = Counter()
    for i, b in rows:
        on = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                on[k : k + 200] = True
        data = np.frombuffer(b, np.uint8)
        spans = int((np.diff(np.concatenate([[0], on.astype(int)])) == 1).sum())
        digest = hashlib.sha256(data[~on].tobytes()).hexdigest()
        want[(i, len(b), int(on.sum()), spans, digest)] += 1
    found = repeats.without_repeats(docs).drop("spans", "kept").collect()
    assert Counter(tuple(r) for r in found) == want
    assert repeats.without_repeats(empty).count() == 0


def test_mixture_meets_its_targets(docs, empty):
    found = mixing.mix_plan(docs).toPandas()
    sizes = {(r.doc_id, len(WORDS.findall(r.text or ""))) for r in docs.collect()}
    pairs = {(None if i != i else int(i), n) for i, n in zip(found["doc_id"], found["size"])}
    assert pairs == sizes
    assert (found["taken"] <= 3 * found["size"]).all()
    assert found["target"].groupby(found["source_size"]).first().sum() == pytest.approx(
        found["size"].sum()
    )
    again = mixing.mix_plan(docs.repartition(5)).toPandas()
    columns = ["doc_id", "size", "taken"]
    assert sorted(map(str, found[columns].values.tolist())) == sorted(
        map(str, again[columns].values.tolist())
    )
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixed_documents(docs).count() == int(
        sum(t // s for t, s in zip(found["taken"], found["size"]) if s)
    )
    assert mixing.mix_plan(empty).count() == 0


def test_budgets():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1], 3) == pytest.approx([187.5, 75, 37.5])
    assert mixing.water_fill([10, 1000], [5, 2], 3) == pytest.approx([30, 980])
    rng = np.random.default_rng(1)
    for _ in range(40):
        lengths = sorted(rng.choice(np.arange(1, 60), 6, replace=False).tolist())
        counts = rng.integers(1, 6, 6).tolist()
        budget = int(rng.integers(0, 300))
        take = mixing.fill_budget(lengths, counts, budget, cap=40)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        used = sum(n * t for n, t in zip(lengths, take))
        assert used <= budget
        if budget < sum(n * c for n, c in zip(lengths, counts)):
            assert budget - used <= max(lengths)
    assert mixing.fill_budget([3, 5], [4, 4], 11) and sum(
        n * t for n, t in zip([3, 5], mixing.fill_budget([3, 5], [4, 4], 11))
    ) == 11


def spans_by_hand(text):
    out = []
    rule = (
        r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
        r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
        r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    )
    for no, (kind, pattern, size, part) in enumerate(
        [("assign", rule, 6, 2), ("access", "AKIA[A-Z0-9]+", 20, 0), ("hex", "[0-9a-f]+", 24, 0)]
    ):
        out += [
            (m.start(), no, f"{kind}:{m.start()}:{m.end()}")
            for m in re.finditer(pattern, text)
            if len(m.group(part)) >= size
        ]
    return ",".join(s for _, _, s in sorted(out))


def test_secrets(spark):
    random_key = "Zk3+xQ9/mT7bVw2LcR8pYf5Hs1Nd"
    cases = [
        None,
        "",
        "é😀 Password: 'hunter22' token=abc secret=token=abcdefgh",
        "AKIA" + "A1" * 9 + " AKIASHORT " + "0123456789abcdef" * 2,
        f"key {random_key} end",
        "123e4567-e89b-12d3-a456-426614174000 this/is/only/a/long/path/of/words " + "=" * 40,
        "secret=token: abcdefgh API_KEY = \"x.y/z+1\"",
        "deadbeef " * 4000,
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(cases)], "doc_id long, text string, spans string")
    found = {r.doc_id: r for r in secrets.secret_report(df).collect()}
    for i, text in enumerate(cases):
        base = spans_by_hand(text or "")
        assert found[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), text
        kinds = Counter(s.split(":")[0] for s in base.split(",") if s)
        assert (found[i].n_assign, found[i].n_access, found[i].n_hex) == tuple(
            kinds[k] for k in ("assign", "access", "hex")
        )
    assert found[4].spans == f"entropy:4:{4 + len(random_key)}"
    assert found[5].spans == ""
    value = df.where("doc_id = 4").select(secrets.window_entropy(F.lit(random_key))).first()[0]
    entropies = []
    for k in range(len(random_key) - 19):
        part = Counter(random_key[k : k + 20])
        entropies.append(-sum(c / 20 * math.log2(c / 20) for c in part.values()))
    assert value == pytest.approx(max(entropies))


def test_secrets_of_one_alphabet(spark):
    rng = np.random.default_rng(13)
    upper_hex, lower, upper = "0123456789ABCDEF", string.ascii_lowercase, string.ascii_uppercase
    cases = {}
    for name, letters, n, around in (
        ("id_", upper_hex, 32, ("id_", "")), ("_x", upper_hex, 32, ("", "_x")), ("id=", upper_hex, 24, ("id=", "")),
        ("lower", lower, 32, ("", "")), ("upper", upper, 32, ("", "")), ("both", lower + upper, 32, ("", "")),
    ):
        cases[name] = ["".join(rng.choice(list(letters), n)).join(around) for _ in range(40)]
    plain = ["internationalization", "this/is/only/a/long/path/of/words", "123e4567-e89b-12d3-a456-426614174000"]
    rows = [(n, t) for n, many in cases.items() for t in many] + [("plain", t) for t in plain]
    df = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(rows)], "doc_id long, name string, text string")
    found = secrets.secret_spans(df).where(F.size("entropy_spans") > 0).groupBy("name").count()
    share = {r["name"]: r["count"] / 40 for r in found.collect()}
    assert "plain" not in share
    assert all(share.get(name, 0) >= 0.9 for name in cases), share


def test_vectors_match_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    near = base[:10] + 0.05 * rng.normal(size=(10, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([base, near, base[:3], 2 * base[:2]]))]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] * 16, [None] * 16, [1.0, 2.0]]
    extra = [(900 + i, v) for i, v in enumerate(odd)] + [(None, base[0].tolist())]
    df = spark.createDataFrame(
        [(*r, "x") for r in rows + extra], "vec_id long, embedding array<double>, kept string"
    )
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.9
    label = np.arange(len(x))
    for _ in x:
        label = np.array([label[link[i]].min() for i in range(len(x))])
    found = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    for i in range(len(x)):
        assert (found[i].n_links, found[i].component_id) == (link[i].sum() - 1, label[i])
        assert found[i].kept == (label[i] == i)
    for i, _ in extra:
        assert found[i].n_links == 0 and found[i].component_id == i and found[i].kept
    assert vectors.near_vectors(df.where("false")).count() == 0


def test_vectors_of_every_length_and_many_lists(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LIST_ROWS", 10)
    rng = np.random.default_rng(14)
    sets = []
    for dim, n in ((24, 500), (12, 200)):
        base = rng.normal(size=(n, dim))
        aside = rng.normal(size=(n, dim))
        base /= np.linalg.norm(base, axis=1, keepdims=True)
        aside -= (aside * base).sum(axis=1, keepdims=True) * base
        aside /= np.linalg.norm(aside, axis=1, keepdims=True)
        sets.append(np.vstack([base, 0.91 * base + math.sqrt(1 - 0.91**2) * aside, base[:3]]))
    rows, want = [], {}
    for x in sets:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        for i, k in enumerate((unit @ unit.T >= vectors.THRESHOLD).sum(axis=1) - 1):
            want[len(rows) + i] = k
        rows += [(len(rows) + i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r.vec_id: r.n_links for r in vectors.near_vectors(df).collect()}
    assert found == want and len(vectors.fit_indexes(vectors.vector_classes(df))[24].coarse) == 100


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.id: r.component for r in components.connected_components(df).collect()}
    assert found == {i: 0 for i in range(51)} | {i: 100 for i in (100, *range(200, 250))}


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(shards.feistel(np.arange(n), n, 5)) == list(range(n))
    assert (shards.feistel(np.arange(100), 100, 1) != shards.feistel(np.arange(100), 100, 2)).any()


def test_shards_round_trip(spark, docs, empty, tmp_path):
    path = str(tmp_path / "shards")
    options = {"length": 64, "per_shard": 50}
    manifest = shards.materialise(docs, path, **options).collect()
    tokens = {r.slot: r.tokens for r in shards.training_order(docs, **options).collect()}
    assert sorted(tokens) == list(range(len(manifest)))
    for start in (0, 120):
        read = shards.read_shards(spark, path, start, 64, 1, 50).collect()
        assert sorted(r.slot for r in read) == list(range(start, len(manifest)))
        assert all(bytes(r.tokens) == bytes(tokens[r.slot]).ljust(64, b"\xff") for r in read)
    whole = {}
    for r in sorted(manifest, key=lambda r: r.part):
        if r.doc_id == 3:
            whole[r.part] = bytes(tokens[r.slot])
    text = docs.where("doc_id = 3").first().text
    assert b"".join(whole[k] for k in sorted(whole)) == text.encode() + b"\xfe"
    assert shards.training_order(empty).count() == 0


def test_leaks(spark, empty):
    rng = np.random.default_rng(9)
    items = [prose(rng, 30) for _ in range(4)] + [["tiny", "one"]]
    bench = spark.createDataFrame(
        [(i, " ".join(w), 0) for i, w in enumerate(items)] + [(9, None, 0), (8, " ".join(items[0]), 0)],
        "item_id long, text string, doc_id int",
    )
    swapped = list(items[1])
    for k in (4, 11, 17, 25):
        swapped[k] = "other"
    pad = prose(rng, 50)
    cases = [pad + items[0] + pad, pad + swapped, items[2][:16] + pad, items[3][:6] + pad, pad]
    rows = [(i, " ".join(c)) for i, c in enumerate(cases)] + [(50, None), (None, " ".join(items[0])), (51, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    for blocks in (2_000_000, 50):
        found = {(r.doc_id, r.item_id): r for r in leaks.leaked_passages(df, bench, blocks).collect()}
        assert set(found) == {(0, 0), (1, 1), (2, 2), (None, 0)}
        assert found[(0, 0)].start == 50 and found[(0, 0)].n_equal == 30
        assert found[(1, 1)].n_equal == 26
    left = leaks.without_leaks(df, bench)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 50, 51]
    assert leaks.leaked_passages(empty, bench).count() == 0


def test_leaks_tell_texts_of_one_id_apart(spark):
    rng = np.random.default_rng(10)
    item = prose(rng, 30)
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    clean = [" ".join(prose(rng, 40)) for _ in range(6)]
    leaked = [" ".join(prose(rng, 9) + item) for _ in range(2)]
    rows = [(None, t) for t in (*clean[:4], *leaked, None, "")]
    rows += [(1, clean[4]), (1, leaked[0]), (2, clean[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in leaks.without_leaks(df, bench).collect()]
    want = [(i, t) for i, t in rows if t not in leaked]
    assert sorted(left, key=str) == sorted(want, key=str)
    found = leaks.leaked_passages(df, bench)
    assert sorted((str(r.doc_id), r.start) for r in found.collect()) == [("1", 9), ("None", 9), ("None", 9)]


def test_leaks_judge_the_best_stretch(spark):
    rng = np.random.default_rng(12)
    item = prose(rng, 60)
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    # A copied part, and one chance match far from it on the same diagonal.
    cases = [["xx"] * 60 for _ in range(3)]
    cases[0][5:18], cases[0][55] = item[5:18], item[55]
    cases[1][40:57], cases[1][2] = item[40:57], item[2]
    cases[1][44], cases[1][47] = "xx", "xx"
    cases[2][5:17], cases[2][55] = item[5:17], item[55]
    df = spark.createDataFrame([(i, " ".join(c)) for i, c in enumerate(cases)], "doc_id long, text string")
    found = {r.doc_id: (r.n_equal, r.run_words) for r in leaks.leaked_passages(df, bench).collect()}
    assert found == {0: (14, 13), 1: (16, 17)}
    runs = [sorted(rng.choice(40, n, replace=False).tolist()) for n in (1, 5, 14, 20, 28, 35, 40)]
    got = spark.createDataFrame([(r,) for r in runs], "p array<int>").select("p", leaks.longest_run(F.col("p")).alias("r"))
    for p, (n, _) in got.collect():
        assert n == max(
            b - a + 1
            for a in range(len(p))
            for b in range(a, len(p))
            if 4 * (b - a + 1) >= 3 * (p[b] - p[a] + 1)
        )


def test_masks_hit_whatever_the_whole_rule_accepts():
    def hit(equal):
        return any(
            all(i + o in equal for o in mask)
            for mask in leaks.MASKS
            for i in range(max(equal) + 1 - max(mask))
        )

    for n in range(leaks.MIN_EQUAL, 15):
        least = max(leaks.MIN_EQUAL, math.ceil(n * 6 / 10))
        assert all(hit(set(equal)) for equal in combinations(range(n), least))
    # Every so many words one, or two of five, are replaced in a long item.
    for period, kept in ((3, {0, 1}), (4, {0, 1, 2}), (5, {0, 1, 2, 3}), (5, {0, 1, 2}), (5, {0, 1, 3})):
        assert hit({i for i in range(200) if i % period in kept})


def test_near_copies_tell_texts_of_one_id_apart(spark):
    rng = np.random.default_rng(11)
    a, b, c = (" ".join(prose(rng, 60)) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (5, b), (6, c), (6, b), (7, None), (7, ""), (None, a), (None, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in neardup.keep_one_of_each(df).collect()]
    want = [(1, a), (5, b), (6, c), (7, None), (7, ""), (None, a), (None, c)]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_severity_on_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.1/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/../sf0.1/labels.parquet")
    test = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = severity.train(docs, labels.where(~test))
    assert model.thresholds == sorted(model.thresholds)
    held = docs.join(labels.where(test), "doc_id").select("text", "toxic").collect()
    scores = model.grade_chances(np.array([model.score(r.text) for r in held]))
    assert np.allclose(scores.sum(axis=1), 1.0)
    guess = scores @ np.arange(4) >= severity.REJECT_AT
    truth = np.array([r.toxic == 1 for r in held])
    assert (guess == truth).mean() >= 0.95
    assert guess[truth].mean() >= 0.8 and guess[~truth].mean() <= 0.02


def test_severity_without_labels(docs, empty, spark):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    found = severity.severity_report(docs, labels).collect()
    assert len(found) == docs.count() and not any(r.toxic for r in found)
    assert severity.keep_clean(docs, labels).columns == docs.columns
    assert severity.severity_report(empty, labels).count() == 0


def test_fixity_finds_what_differs(spark):
    rows = [(i, f"http://h/{i}", "body %d" % i) for i in range(40)] + [(None, None, None), (3, "http://h/3", "body 3")]
    first = spark.createDataFrame(rows, "page_id long, url string, html string")
    second = first.withColumn("html", F.when(F.col("page_id") == 17, "bodY 17").otherwise(F.col("html"))).where("page_id is null or page_id <> 39")
    a, b = (fixity.page_records(x, per_file=20) for x in (first, second))
    found = [tuple(r) for r in fixity.fixity_audit(a, b, fanout=4).select("first_id", "second_id", "fault").collect()]
    assert sorted(found, key=str) == [(17, 17, "changed"), (39, None, "missing")]
    assert fixity.fixity_audit(a, a, fanout=4).count() == 0
    assert fixity.fixity_audit(a.where("false"), a.where("false")).count() == 0


def test_fixity_tells_shifted_records_from_damage(spark):
    rows = [(i, f"http://h/{i}", "body %d" % i) for i in range(60)] + [(None, None, t) for t in ("a", "b")]
    schema = "page_id long, url string, html string"
    first = spark.createDataFrame(rows, schema)
    # File 0: 3 truncated and 12 struck; file 1: 25 lost and 33 struck; file 2: 45 came in.
    now = {3: "bo", 12: "bodY 12", 33: "bodY 33", 25: None}
    second = [(i, u, now.get(i, t)) for i, u, t in rows if i is None or now.get(i, t)]
    a = fixity.page_records(first.where("page_id is null or page_id <> 45"), per_file=20)
    b = fixity.page_records(spark.createDataFrame(second, schema), per_file=20)
    found = fixity.fixity_audit(a, b, fanout=4).collect()
    faults = {(r.first_id, r.second_id, r.fault) for r in found if r.fault != "shifted"}
    assert faults == {
        (3, 3, "changed"), (12, 12, "changed"), (33, 33, "changed"), (25, None, "missing"), (None, 45, "added"),
    }
    shifted = {r.first_id for r in found if r.fault == "shifted"}
    assert shifted == {*range(4, 20), *range(26, 40), *range(46, 60)} - {12, 33}
    assert all(r.first_id == r.second_id for r in found if r.fault == "shifted")
    assert len(found) == len(faults) + len(shifted)


def test_hosts_and_rules(spark):
    cases = {
        None: ("", "", None), "no url": ("", "", None), "": ("", "", None),
        "HTTP://A.Example.ORG/es/x?y=/": ("a.example.org", "/es/x", "example.org/es/"),
        "http://example.org": ("example.org", "", None),
        "http://example.org/en/12#f": ("example.org", "/en/12", "example.org/en/1"),
        "x://b.org/z": ("b.org", "/z", "org/"), "x://borg/z": ("borg", "/z", None),
        "x://b.com/fr/?q": ("b.com", "/fr/", "com/fr/"), "x://b.com?fr://c": ("b.com", "", None),
    }
    df = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(cases)], "page_id long, url string, html string, host string")
    found = {r.page_id: r for r in hostrank.url_verdicts(df).collect()}
    for i, want in enumerate(cases.values()):
        assert (found[i].host, found[i].path, found[i].rule) == want
    assert found[3].verdict == "block" and found[6].verdict == "allow" and found[0].verdict == "allow"
    assert hostrank.url_verdicts(df.where("false")).count() == 0


def test_distrust_goes_back_to_those_who_link(spark):
    bad, good = "http://bad.com/de/1", "http://good.org/1"
    link = '<p><a class=x href="{}">t</a></p>'
    pages = [(0, bad, ""), (1, good, link.format("https://fine.net/")), (2, "http://shady.net/1", link.format(bad) * 3), (3, "http://fine.net/1", link.format("/local"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r for r in hostrank.url_verdicts(df).collect()}
    assert [found[i].verdict for i in range(4)] == ["block", "allow", "block", "allow"]
    assert found[2].distrust > 0 and found[3].trust > 0


def test_distrust_goes_back_along_a_long_chain(spark):
    link = "<a href='http://h{}.net/'>t</a>"
    pages = [(i, f"http://h{i}.net/", link.format(i + 1)) for i in range(11)]
    pages += [(11, "http://h11.net/", "<a href=http://bad.com/de/1>t</a>"), (12, "http://bad.com/de/1", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r for r in hostrank.url_verdicts(df).collect()}
    assert all(found[i].verdict == "block" for i in range(13))
    for i in range(12):
        assert found[i].distrust == pytest.approx(0.15 * 0.85 ** (12 - i))


def test_pipeline_keeps_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES][1] == "near duplicates"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        docs = docs.cache()
        assert 0 < docs.count()
    manifest = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert manifest.count() == manifest.select("slot").distinct().count()
