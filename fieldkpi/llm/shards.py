"""Training order on disk: every sequence gets a slot by a keyed permutation.

Documents become sequences of at most ``LENGTH`` token ids. A sequence's index is
its place in the order of a document hash; a Feistel network over the next power
of four permutes indices, walking cycles until it lands below their number. Slots
are dealt to shards by range and written with a fixed stride, so slot s is found
at byte ``s % per_shard * stride`` of shard ``s // per_shard``.

Token ids are bytes of UTF-8, 254 ending a document and 255 padding (neither can
occur in UTF-8), or two-byte ids of a rank file of a byte-level vocabulary.

Cases: null and empty texts are a document end alone; repeated rows are sequences
of their own; an empty table gives no slots and no shards; extra columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldkpi.llm.common import stored, text_or_empty, travels

travels(__name__)

LENGTH = 2048
PER_SHARD = 8192
KEY = 20240131
FEISTEL_ROUNDS = 6
BUCKETS = 1 << 12
# Documents that meet in one hash range; from so many on, there are more ranges.
RANGE_DOCS = 20_000
PAD = b"\xff"
# Closes every record; the text sink wants a separator, and readers can test it.
CLOSE = "\n"


def _mixed(v: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def feistel(index: np.ndarray, count: int, key: int) -> np.ndarray:
    """Permutation of 0 .. count-1: balanced Feistel network with cycle walking."""
    half = np.uint64(max(1, (max(count - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _mixed(np.arange(1, FEISTEL_ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                  ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF))
    out = np.asarray(index).astype(np.uint64)
    walking = np.ones(len(out), bool)
    while walking.any():
        v = out[walking]
        left, right = v >> half, v & mask
        for k in keys:
            left, right = right, left ^ (_mixed(right ^ k) & mask)
        out[walking] = left << half | right
        walking = out >= np.uint64(count)
    return out.astype(np.int64)


def byte_tokens(text: Column) -> Column:
    return F.concat(F.encode(text, "UTF-8"), F.lit(bytearray(b"\xfe")))


def bpe_tokens(path: str, pattern: str, end: int):
    """Pandas UDF: text to little-endian two-byte ids of a rank file, closed by ``end``."""
    kept: dict[str, object] = {}

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        if path not in kept:
            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            kept[path] = tiktoken.Encoding(
                "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
            )
        for texts in batches:
            yield texts.map(
                lambda t: np.array([*kept[path].encode_ordinary(t), end], "<u2").tobytes()
            )

    return encode


def training_order(
    docs: DataFrame,
    length: int = LENGTH,
    per_shard: int = PER_SHARD,
    key: int = KEY,
    tokens=byte_tokens,
    width: int = 1,
) -> DataFrame:
    """Rows ``slot, shard, byte_offset, doc_id, part, n_tokens, tokens``, one per sequence.

    Counts by hash range come to the driver, one number for ``RANGE_DOCS`` documents (or
    ``BUCKETS`` numbers, if that is more); the running count of a range is a window over it.
    """
    ranges = max(BUCKETS, -(-docs.count() // RANGE_DOCS))
    body = docs.select("doc_id", tokens(text_or_empty()).alias("tokens"))
    draw = F.xxhash64("doc_id", "tokens")
    body = body.withColumn("draw", draw).withColumn("bucket", F.pmod("draw", F.lit(ranges)))
    parts = F.ceil(F.octet_length("tokens") / (length * width))
    counts = (
        body.groupBy("bucket").agg(F.sum(parts).cast("long").alias("n")).toPandas()
    )  # one row per hash range
    sizes = np.zeros(ranges, np.int64)
    sizes[counts["bucket"].to_numpy(int)] = counts["n"].to_numpy(np.int64)
    starts, total = np.concatenate([[0], np.cumsum(sizes)[:-1]]), int(sizes.sum())

    before = (
        Window.partitionBy("bucket")
        .orderBy("draw", "doc_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = body.withColumn("n_parts", parts).withColumn(
        "first", F.coalesce(F.sum("n_parts").over(before), F.lit(0))
    )
    sequences = placed.select(
        "doc_id", "bucket", "first", "tokens", F.posexplode(F.sequence(F.lit(1), "n_parts"))
    ).select(
        "doc_id",
        F.col("pos").cast("long").alias("part"),
        "bucket",
        (F.col("first") + F.col("pos")).cast("long").alias("place"),
        F.substring("tokens", F.col("pos") * length * width + 1, F.lit(length * width)).alias(
            "tokens"
        ),
    )

    @F.pandas_udf("long")
    def slot_of(bucket: pd.Series, place: pd.Series) -> pd.Series:
        index = starts[bucket.to_numpy(int)] + place.to_numpy(np.int64)
        return pd.Series(feistel(index, total, key))

    stride = length * width + len(CLOSE)
    return (
        sequences.withColumn("slot", slot_of("bucket", "place"))
        .select(
            "slot",
            F.floor(F.col("slot") / per_shard).alias("shard"),
            (F.col("slot") % per_shard * stride).alias("byte_offset"),
            "doc_id",
            "part",
            (F.octet_length("tokens") / width).cast("long").alias("n_tokens"),
            "tokens",
        )
    )


def in_slot_order(sequences: DataFrame) -> DataFrame:
    """Range partitions by slot, each in order: what a sequential reader gets."""
    return sequences.repartitionByRange("slot").sortWithinPartitions("slot")


def write_shards(
    sequences: DataFrame, path: str, length: int = LENGTH, width: int = 1
) -> None:
    """Write ``path/shard=K/part-*``: records of fixed stride, in slot order.

    A shard lies in one range partition, so it is one file, and Spark's commit makes
    a task that is run again harmless. Records are bytes, not characters.
    """
    record = F.rpad(F.col("tokens"), F.lit(length * width), F.lit(bytearray(PAD)))
    (
        sequences.repartitionByRange("shard")
        .sortWithinPartitions("shard", "slot")
        .select("shard", record.cast("string").alias("record"))
        .write.partitionBy("shard")
        .option("lineSep", CLOSE)
        .text(path)
    )


def read_shards(
    spark: SparkSession, path: str, start: int, length: int = LENGTH, width: int = 1,
    per_shard: int = PER_SHARD,
) -> DataFrame:
    """Rows ``slot, tokens`` from slot ``start`` on: earlier shards are not opened."""
    stride = length * width + len(CLOSE)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "false")
        .load(path)
        .where(F.col("shard") >= start // per_shard)
    )
    return (
        files.select(
            F.col("shard").cast("long").alias("shard"),
            "content",
            F.posexplode(F.sequence(F.lit(1), (F.col("length") / stride).cast("int"))),
        )
        .select(
            (F.col("shard") * per_shard + F.col("pos")).alias("slot"),
            F.substring("content", F.col("pos") * stride + 1, F.lit(length * width)).alias("tokens"),
        )
        .where(F.col("slot") >= start)
    )


def materialise(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the shards under ``path`` and return the manifest of their sequences."""
    ordered = stored(training_order(docs, **options), "training-order")
    length, width = options.get("length", LENGTH), options.get("width", 1)
    write_shards(ordered, path, length, width)
    return in_slot_order(ordered.drop("tokens"))
