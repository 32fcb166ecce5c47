"""Repeated passages by prefix-free parsing: what stands twice in the corpus, byte for byte.

Every ``WINDOW``-byte string is placed by its trigger, the least rolling hash among its
first ``RUN`` grams, so equal strings have equal triggers. Strings of one trigger and
one stretch of ``STRETCH`` starts form a phrase. Phrases overlap by ``WINDOW - 1`` bytes:
each string lies in exactly one, and two strings can only be equal in phrases that agree
in what all their strings share (the core).

The corpus order is only needed ``WINDOW`` bytes deep and only where something repeats.
Cores that occur once hold nothing repeated; where every phrase of a core is the same
phrase of the dictionary, all its strings repeat. The other dictionary phrases, each
once, are cut at their trigger (moved back by whole stretches), and two sorted lists
make up the order of all their suffixes:

* parse order: what follows the triggers, sorted by its bytes in ranges, with the common
  prefix of neighbours; for each depth it gives the first place of the run that agrees so far;
* dictionary order: the suffixes of what stands before the triggers, sorted by their bytes.

A text suffix is a dictionary suffix and then a place in the parse order, so sorting by
both puts equal ``WINDOW``-byte strings side by side. Runs that cross the border of two
ranges are settled from one summary a range. Between different dictionary suffixes of which
one begins the other, the order is that of the pair, not of the text; equal strings are
neighbours all the same.

Cases: a null or empty text, or one shorter than ``WINDOW`` bytes, loses nothing; repeated
rows remove each other's whole text, as every string in them also starts elsewhere; rows
without id or with a shared one are told apart by their text; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldkpi.llm import wordhash
from fieldkpi.llm.common import discard, release, stored, text_or_empty, travels

travels(__name__)
travels(wordhash.__name__)

WINDOW = 200
GRAM = 12
RUN = 128
# Starts of a phrase fit the bits of a long.
STRETCH = 64
DEPTHS = np.arange(WINDOW - STRETCH + 1, WINDOW + 1)
# A phrase's number of starts (7 bits) and, above it, of the bytes before its trigger.
PHRASES = "name long, n_bytes int, lo int, shape int, core long, phrase long"
SIZE = "(shape & 127)"
# Places in the parse order: a range's number above 36 bits, the row in the range below.
ORDER = (
    "core long, phrase long, n long, shape int, part int, place int, left binary, "
    "right binary, classes array<int>"
)


def triggers(data: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start, the place of the least gram among the next RUN (leftmost of equals)."""
    place = np.arange(len(data) - GRAM + 1)
    low = (np.uint64(1) << np.uint64(len(data).bit_length())) - np.uint64(1)
    key = wordhash.substring_hash(sums, place, place + GRAM) & ~low | place.astype(np.uint64)
    span = 1
    while span < RUN:
        step = min(span, RUN - span)
        key = np.minimum(key[:-step], key[step:])
        span += step
    return (key & low).astype(np.int64)


def phrases_of(data: np.ndarray, at: np.ndarray):
    """Row, first start (in the text), shape, core and phrase hash of each phrase."""
    sizes = np.diff(at)
    change = np.zeros(len(data) + 1, np.int8)
    long = sizes >= WINDOW
    np.add.at(change, at[:-1][long], 1)
    np.add.at(change, at[1:][long] - WINDOW + 1, -1)
    start = np.flatnonzero(np.cumsum(change[:-1], dtype=np.int8))
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = wordhash.running(data)
    trigger = triggers(data, sums)[start]
    stretch = (trigger - start) // STRETCH
    new = np.ones(len(start), bool)
    new[1:] = (
        (trigger[1:] != trigger[:-1]) | (start[1:] != start[:-1] + 1) | (stretch[1:] != stretch[:-1])
    )
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    low, high, mark = start[first], start[last], trigger[first]
    inner = mark - stretch[first] * STRETCH
    core = wordhash.substring_hash(sums, inner, inner - STRETCH + 1 + WINDOW)
    whole = wordhash.substring_hash(sums, low, high + WINDOW)
    phrase = wordhash.mixed(whole ^ (mark - low).astype(np.uint64))
    row = np.searchsorted(at, low, side="right") - 1
    return row, low - at[row], (inner - low) << 7 | high - low + 1, core, phrase


def _identified(docs: DataFrame) -> DataFrame:
    """Rows ``doc_id, name, n_bytes, text``. A 64-bit hash of id and text and the number of
    bytes stand for a document: equal rows have equal ones, and their results are equal too."""
    text = text_or_empty()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("doc_id", text).alias("name"),
        F.octet_length(text).alias("n_bytes"),
        text.alias("text"),
    )


def parse(docs: DataFrame) -> DataFrame:
    """The parse: one row per phrase of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in wordhash.slices(whole, 2):
                row, low, shape, core, phrase = phrases_of(*wordhash.batch_bytes(part.column(2)))
                at = pa.array(row)
                yield pa.record_batch(
                    [
                        part.column(0).take(at),
                        part.column(1).take(at),
                        pa.array(low.astype(np.int32)),
                        pa.array(shape.astype(np.int32)),
                        pa.array(core.view(np.int64)),
                        pa.array(phrase.view(np.int64)),
                    ],
                    names=["name", "n_bytes", "lo", "shape", "core", "phrase"],
                )

    return docs.select("name", "n_bytes", "text").mapInArrow(run, PHRASES)


def _cuts(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """The byte strings of given begins and sizes."""
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])]
    )


def _pieces(dictionary: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows ``core, phrase, n, shape, left, right``: dictionary phrases cut at their triggers.

    A phrase's bytes are read where it occurs first.
    """
    per_text = dictionary.groupBy("rep.name", "rep.n_bytes").agg(
        F.collect_list(F.struct("core", "phrase", "n", "rep.lo", "rep.shape")).alias("wanted")
    )
    texts = docs.join(per_text, ["name", "n_bytes"]).dropDuplicates(["name", "n_bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in wordhash.slices(whole, 0):
                data, at = wordhash.batch_bytes(part.column(0))
                lists = part.column(1)
                flat = lists.flatten()
                owner = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
                core, phrase, n, low, shape = (
                    flat.field(name) for name in ("core", "phrase", "n", "lo", "shape")
                )
                begin, kind = at[owner] + np.asarray(low), np.asarray(shape).astype(np.int64)
                left, size = kind >> 7, kind & 127
                yield pa.record_batch(
                    [
                        core, phrase, n, shape,
                        _cuts(data, begin, left),
                        _cuts(data, begin + left, size - 1 + WINDOW - left),
                    ],
                    names=["core", "phrase", "n", "shape", "left", "right"],
                )

    return texts.select("text", "wanted").mapInArrow(
        run, "core long, phrase long, n long, shape int, left binary, right binary"
    )


def common_prefixes(before: bytes, column: pa.Array) -> np.ndarray:
    """Length of the common prefix of each row and the one before it."""
    values = [before, *column.to_pylist()]
    size = np.array([len(v) for v in values])
    rows = np.frombuffer(b"".join(v.ljust(WINDOW, b"\0") for v in values), np.uint8)
    rows = rows.reshape(-1, WINDOW)
    differs = np.ones((len(values) - 1, WINDOW + 1), bool)
    differs[:, :WINDOW] = rows[1:] != rows[:-1]
    return np.minimum(differs.argmax(axis=1), np.minimum(size[1:], size[:-1]))


def parse_order(pieces: DataFrame) -> DataFrame:
    """Dictionary phrases in the order of what follows their triggers.

    ``classes`` holds for each start of a phrase the first row of the run that agrees as
    deep as the start's string goes, -1 if the run begins in an earlier range. A last row a range with
    ``n`` 0 sums it up: its first and last bytes and the runs open at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        names = [field.split()[0] for field in ORDER.split(", ")]
        open_runs, seen, first, before = np.full(len(DEPTHS), -1), 0, None, None
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                part = whole.slice(start, 4096)
                right = part.column(5)
                if first is None:
                    first = before = right[0].as_py()
                shared = common_prefixes(before, right)
                if seen == 0:
                    shared[0] = WINDOW  # settled by the summaries
                rows = np.arange(seen, seen + part.num_rows)
                runs = np.where(shared[:, None] < DEPTHS, rows[:, None], -1)
                runs[0] = np.maximum(runs[0], open_runs)
                runs = np.maximum.accumulate(runs, axis=0)
                open_runs, before = runs[-1], right[-1].as_py()
                seen += part.num_rows
                shape = np.asarray(part.column(3)).astype(np.int64)
                left, size = shape >> 7, shape & 127
                item = np.repeat(np.arange(len(size)), size)
                place = np.arange(len(item)) - np.repeat(np.cumsum(size) - size, size)
                classes = runs[item, STRETCH - 1 - left[item] + place].astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.record_batch(
                    [
                        *part.columns[:4],
                        pa.array(np.full(len(size), number, np.int32)),
                        pa.array(rows.astype(np.int32)),
                        part.column(4),
                        pa.nulls(len(size), pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(classes)),
                    ],
                    names=names,
                )
        if seen:
            summary = [0, 0, 0, 0, number, seen, first, before, open_runs.tolist()]
            kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()] * 2 + [pa.list_(pa.int32())]
            yield pa.record_batch([pa.array([v], k) for v, k in zip(summary, kinds)], names=names)

    # With ``left`` in the bounds, phrases that go on alike may fall into several ranges.
    ranges = pieces.repartitionByRange("right", "left").sortWithinPartitions("right", "left")
    return ranges.mapInArrow(run, ORDER)


def carried_runs(summaries: list) -> list[tuple[int, list[int]]]:
    """For each range, the first places of the runs open at its begin, by depth."""
    out, runs, before = [], None, None
    for part, first, last, ends in sorted(summaries):
        here = np.full(len(DEPTHS), part << 36)
        if runs is not None:
            shared = common_prefixes(before, pa.array([first], pa.binary()))[0]
            here = np.where(shared < DEPTHS, here, runs)
        out.append((part, here.tolist()))
        ends = np.array(ends)
        runs, before = np.where(ends < 0, here, (part << 36) + ends), last
    return out


def corpus_order(order: DataFrame) -> DataFrame:
    """Rows ``suffix, run, mark``, one per start of a dictionary phrase: the dictionary
    suffix, the first place in the parse order, and the phrase's place and start."""
    spark = order.sparkSession
    # One row a range, so the side below grows with the number of tasks only.
    ends = order.where("n = 0").select("part", "left", "right", "classes").collect()
    carried = spark.createDataFrame(carried_runs([tuple(r) for r in ends]), "part int, carried array<long>")
    starts = order.where("n > 0").join(F.broadcast(carried), "part")
    return starts.select(
        "part", "place", "left", "carried", F.posexplode("classes").alias("start", "run")
    ).select(
        F.expr("substring(left, start + 1)").alias("suffix"),
        F.expr(
            "if(run >= 0, shiftleft(bigint(part), 36) + run, "
            f"carried[{STRETCH - 1} - length(left) + start])"
        ).alias("run"),
        F.expr("shiftleft(shiftleft(bigint(part), 36) + place, 6) + start").alias("mark"),
    )


def equal_neighbours(rows: DataFrame) -> DataFrame:
    """Rows ``mark`` of ``corpus_order`` whose string stands at more than one place of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, same, top = None, False, True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch])
            table = table.combine_chunks().to_batches()[0]
            equal = np.zeros(table.num_rows + 1, bool)
            equal[0] = same
            for name in ("suffix", "run"):
                column = table.column(name)
                alike = pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
                equal[1:-1] = alike if name == "suffix" else equal[1:-1] & alike
            n = table.num_rows - 1
            twice, edge = (equal[:-1] | equal[1:])[:n], np.zeros(n, bool)
            if n:
                edge[0], top = top, False
                yield marked(table.slice(0, n), twice, edge)
            held, same = table.slice(n), bool(equal[n])
        if held is not None:
            yield marked(held, np.array([same]), np.array([True]))

    def marked(table, twice, edge):
        """Repeated rows, and the first and last of a range with their keys."""
        chosen = np.flatnonzero(twice | edge)
        keyed = pa.array(chosen, mask=~edge[chosen])
        columns = [table.column(0).take(keyed), table.column(1).take(keyed)]
        columns += [table.column(2).take(pa.array(chosen)), pa.array(twice[chosen])]
        return pa.record_batch(columns, names=["suffix", "run", "mark", "twice"])

    found = stored(
        rows.repartitionByRange("suffix", "run", "mark")
        .sortWithinPartitions("suffix", "run")
        .mapInArrow(run, "suffix binary, run long, mark long, twice boolean"),
        "equal-neighbours",
    )
    # A run cut by the border of two ranges shows in their first and last rows.
    edges = found.where("run IS NOT NULL")
    cut = edges.groupBy("suffix", "run").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.where("twice").select("mark").unionByName(
        edges.join(cut, ["suffix", "run"]).select("mark")
    )


def repeated_starts(docs: DataFrame) -> DataFrame:
    """Rows ``name, n_bytes, lo, starts``: bit p of ``starts`` says that the string at byte
    ``lo + p`` also starts elsewhere."""
    spark = docs.sparkSession
    phrases = parse(docs)
    # Stored before it is joined: a join whose side is an aggregate's own shuffle cannot be
    # split when a core is hot.
    cores = stored(
        phrases.groupBy("core")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("phrase").alias("low"), F.max("phrase").alias("high")
        )
        .where(F.col("n") > 1)
        .select("core", (F.col("low") == F.col("high")).alias("same")),
        "cores",
    )
    release(spark)
    again = stored(phrases.join(cores, "core"), "repeated-cores")
    discard(cores)
    release(spark)
    mixed = again.where(~F.col("same"))
    dictionary = stored(
        mixed.groupBy("core", "phrase").agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct("name", "n_bytes", "lo", "shape")).alias("rep"),
        ),
        "phrase-dictionary",
    )
    pieces = stored(_pieces(dictionary, docs), "phrase-pieces")
    discard(dictionary)
    release(spark)
    order = stored(parse_order(pieces), "parse-order")
    discard(pieces)
    release(spark)
    twice = equal_neighbours(corpus_order(order)).groupBy(
        F.expr("shiftright(mark, 6)").alias("at")
    ).agg(F.bit_or(F.expr("shiftleft(1L, int(mark & 63))")).alias("starts"))
    full = F.expr(f"shiftrightunsigned(-1L, {STRETCH} - {SIZE})")  # as many ones as starts
    marks = stored(
        order.where("n > 0")
        .withColumn("at", F.expr("shiftleft(bigint(part), 36) + place"))
        .join(twice, "at", "left")
        .withColumn("starts", F.when(F.col("n") > 1, full).otherwise(F.col("starts")))
        .where("starts IS NOT NULL")
        .select("core", "phrase", "starts"),
        "phrase-marks",
    )
    discard(order)
    release(spark)
    return (
        again.where("same")
        .select("name", "n_bytes", "lo", full.alias("starts"))
        .unionByName(
            mixed.join(marks, ["core", "phrase"]).select("name", "n_bytes", "lo", "starts")
        )
    )


def removed_runs(starts: np.ndarray, size: int) -> np.ndarray:
    """Maximal runs [begin, end) of bytes that strings at ``starts`` (sorted) cover."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    gap = np.flatnonzero(np.diff(starts) > WINDOW)
    begin = starts[np.concatenate([[0], gap + 1])]
    end = starts[np.concatenate([gap, [len(starts) - 1]])] + WINDOW
    return np.stack([begin, np.minimum(end, size)], axis=1)


def without_repeats(docs: DataFrame) -> DataFrame:
    """Rows ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept``, one per document.

    ``spans`` are the removed runs as (begin, end) bytes and ``kept`` the bytes left.
    """
    docs = _identified(docs)
    found = repeated_starts(docs)
    per_text = found.groupBy("name", "n_bytes").agg(
        F.collect_list(F.struct("lo", "starts")).alias("found")
    )
    joined = docs.join(per_text, ["name", "n_bytes"], "left")
    bits = np.arange(STRETCH, dtype=np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in wordhash.slices(whole, 1, most=8 << 20):
                rows = []
                lists = part.column(2)
                for i, doc in enumerate(part.column(0).to_pylist()):
                    data = np.frombuffer(part.column(1)[i].as_buffer(), np.uint8)
                    runs = np.zeros((0, 2), np.int64)
                    if lists[i].is_valid:
                        entries = lists[i].values
                        low = np.asarray(entries.field("lo")).astype(np.int64)
                        mask = np.asarray(entries.field("starts"))
                        on = (mask[:, None] >> bits[None, :]) & 1 == 1
                        runs = removed_runs(np.unique((low[:, None] + bits[None, :])[on]), len(data))
                    drop = np.zeros(len(data) + 1, np.int8)
                    drop[runs[:, 0]] += 1
                    drop[runs[:, 1]] -= 1
                    kept = data[np.cumsum(drop[:-1], dtype=np.int8) == 0].tobytes()
                    rows.append(
                        (
                            doc, len(data), len(data) - len(kept), len(runs),
                            hashlib.sha256(kept).hexdigest(), runs.tolist(), kept,
                        )
                    )
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
                kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary()]
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names
                )

    return joined.select("doc_id", "text", "found").mapInArrow(
        cut,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<array<long>>, kept binary",
    )
