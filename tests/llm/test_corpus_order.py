"""The order of suffixes behind the passages that stand twice, over many small ranges."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fieldkpi.llm import repeats


def by_hand(texts):
    """Removed bytes of each text, from all 200-byte strings."""
    seen = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    out = []
    for t in texts:
        on = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                on[k : k + 200] = True
        out.append(int(on.sum()))
    return out


@pytest.fixture
def ranges(spark):
    """As many ranges as asked for: small ones are not merged."""
    names = ["spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "false")
    spark.conf.set(names[1], "23")
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def passages():
    rng = np.random.default_rng(31)
    letters = np.frombuffer(b"abcdefghijklmnop \x00\xff", np.uint8)

    def noise(n):
        return rng.choice(letters[:17], n).tobytes()

    core = noise(190)
    rest = noise(400)
    texts = []
    for _ in range(120):  # one passage in many settings: it alone is too short
        texts.append(noise(int(rng.integers(0, 90))) + core + noise(int(rng.integers(0, 90))))
    for _ in range(120):  # the same with pieces of a common left and right side
        left, right = int(rng.integers(0, 80)), int(rng.integers(0, 80))
        texts.append(noise(30) + rest[200 - left : 200] + core + rest[200 : 200 + right] + noise(30))
    for _ in range(40):  # cut out of one text, so phrases share parts of every length
        begin = int(rng.integers(0, 150))
        texts.append(rest[begin : begin + int(rng.integers(180, 250))])
    texts += [b"x" * 700, b"x" * 350 + b"y", b"ab" * 300, b"", core, b"q" * 200, b"r" * 201]
    return texts


def test_order_over_many_ranges_matches_all_strings(spark, ranges):
    texts = [t.decode("latin-1") for t in passages()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.n_removed for r in repeats.without_repeats(df).collect()}
    want = by_hand([t.encode() for t in texts])
    assert [got[i] for i in range(len(texts))] == want
    assert 0 < sum(n > 0 for n in want) < len(want)


def test_neighbours_in_order_are_the_equal_strings(spark, ranges):
    """Every start of every phrase: marked where its 200 bytes stand in another phrase."""
    rng = np.random.default_rng(3)
    left = [bytes(rng.choice([97, 98], 20).astype(np.uint8)) for _ in range(4)]
    tails = [bytes(rng.choice([97, 98], 40).astype(np.uint8)) for _ in range(4)]
    middle = bytes(rng.choice([97, 98, 0, 255], 160).astype(np.uint8))
    rows, strings = [], Counter()
    for i in range(400):
        a = int(rng.integers(0, 20))
        before = left[int(rng.integers(0, 4))][20 - a :]
        turn = int(rng.integers(0, 30))
        after = tails[int(rng.integers(0, 4))][:turn] + tails[int(rng.integers(0, 4))][turn:]
        right = (middle + after)[: 200 - int(rng.integers(0, a + 1))]
        size = len(before) + len(right) - 199
        if size < 1:
            continue
        rows.append((1, i, 1, a << 7 | size, before, right))
        strings.update((a - k, (before + right)[k : k + 200]) for k in range(size))
    pieces = spark.createDataFrame(
        rows, "core long, phrase long, n long, shape int, left binary, right binary"
    ).repartition(7)
    order = repeats.stored(repeats.parse_order(pieces), "parse-order")
    places = order.where("n > 0").orderBy("part", "place").collect()
    text = {r[1]: (r[4], r[5]) for r in rows}
    follows = [text[r.phrase][1] for r in places]
    assert follows == sorted(follows) and len({r.part for r in places}) > 5
    by_place = {r.part << 36 | r.place: r for r in places}
    want = set()
    for at, r in by_place.items():
        before, right = text[r.phrase]
        for k in range(r.shape & 127):
            if strings[(len(before) - k, (before + right)[k : k + 200])] > 1:
                want.add(at << 6 | k)
    marks = [r.mark for r in repeats.equal_neighbours(repeats.corpus_order(order)).collect()]
    assert set(marks) == want and 0 < len(want) < sum(strings.values())


def test_runs_go_on_over_borders_of_ranges():
    depths = len(repeats.DEPTHS)
    same = b"a" * 200
    other = b"a" * 150 + b"b" * 50
    ends = [-1] * depths
    got = dict(repeats.carried_runs([
        (2, other, other, [4] * depths), (0, same, same, [5] * depths), (1, same, same, ends),
    ]))
    assert got[0] == [0] * depths
    assert got[1] == [5] * depths  # the run that begins in row 5 of the first range
    shallow = (repeats.DEPTHS <= 150).tolist()
    assert got[2] == [5 if s else 2 << 36 for s in shallow]


def test_common_prefixes_end_with_the_shorter():
    column = pa.array([b"abc", b"abc\x00", b"abd", b""], pa.binary())
    assert repeats.common_prefixes(b"abc", column).tolist() == [3, 3, 2, 0]
