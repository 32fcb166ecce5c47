"""Merkle fixity audit of WARC records held in several copies.

Each record of a file is a leaf, in offset order. ``FANOUT`` neighbours hash into
one node of the next level, so a node stands for an ordered range of records. An
audit compares roots and goes down only where nodes differ. Records below differing
nodes are aligned by id and digest, so that sound records which only moved are told
from damaged ones.

Every node of a level is made from at most ``FANOUT`` children; only the numbering of a
file's records orders a whole file, and files are of bounded size. Cases: null fields are written as empty ones; repeated rows are
separate records, told apart by their place; an empty table has no tree; a file
or record only one copy holds is reported as missing from the other; extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldkpi.llm.common import checkpointed

FANOUT = 16
FILE_RECORDS = 1000
LOOSE_FILES = 1 << 20


def warc_record(uri: Column, identity: Column, body: Column) -> Column:
    """A WARC resource record as text: header lines, an empty line, the block."""
    block = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "),
        F.coalesce(uri, F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(identity.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
        block,
        F.lit("\r\n\r\n"),
    )


def page_records(pages: DataFrame, per_file: int = FILE_RECORDS) -> DataFrame:
    """Rows ``file, seq, record_id, n_bytes, digest``: pages dealt to files by id.

    The block is hashed where it is read; only digests travel. Pages without an id are
    dealt by their digest to ``LOOSE_FILES`` files, -1 and below, so that however many there
    are, no file holds them all; a changed one lies in another file and counts as missing
    there and added here. Records of a file are in order of id, then digest.
    """
    record = warc_record(F.col("url"), F.col("page_id"), F.col("html"))
    hashed = (
        pages.select("page_id", record.alias("record"))
        .select(
            F.col("page_id").alias("record_id"),
            F.octet_length("record").cast("long").alias("n_bytes"),
            F.sha2("record", 256).alias("digest"),
        )
        .select(
            F.coalesce(
                F.floor(F.col("record_id") / per_file),
                -1 - F.pmod(F.xxhash64("digest"), F.lit(LOOSE_FILES)),
            ).alias("file"),
            "record_id",
            "n_bytes",
            "digest",
        )
    )
    place = Window.partitionBy("file").orderBy("record_id", "digest")
    return hashed.withColumn("seq", (F.row_number().over(place) - 1).cast("long"))


def with_offsets(records: DataFrame) -> DataFrame:
    """Byte offset of each record in its file."""
    before = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn(
        "offset", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)).cast("long")
    )


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """One level up: ordered children, their number and their hashes in one digest."""
    kids = F.array_sort(F.collect_list(F.struct("node", "digest")))
    return nodes.groupBy("file", F.floor(F.col("node") / fanout).alias("node")).agg(
        F.sha2(F.array_join(F.transform(kids, lambda k: k["digest"]), ","), 256).alias("digest"),
    )


def merkle_levels(records: DataFrame, levels: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Level 0 are the leaves (a record's digest with its offset), the last the roots."""
    leaf = F.sha2(F.concat_ws("|", "offset", "n_bytes", "digest"), 256)
    nodes = [records.select("file", F.col("seq").alias("node"), leaf.alias("digest"))]
    for _ in range(levels):
        nodes.append(_parents(nodes[-1], fanout))
    return nodes


def levels_for(records: int, fanout: int = FANOUT) -> int:
    """Levels above the leaves until a file of so many records has one root."""
    levels = 1
    while fanout**levels < records:
        levels += 1
    return levels


def fixity_audit(
    first: DataFrame, second: DataFrame, fanout: int = FANOUT
) -> DataFrame:
    """Rows ``file, seq, first_id, second_id, first_offset, second_offset, fault``.

    ``first`` and ``second`` have the columns of ``page_records``. Fault is ``changed``,
    ``missing`` (from the second), ``added`` or ``shifted``: a sound record at another
    place or offset, since one before it was lost, came in or changed its length.
    ``seq`` is the place in the first copy, of added records that in the second.
    """
    first, second = checkpointed(with_offsets(first)), checkpointed(with_offsets(second))
    longest = (
        first.select("seq").unionByName(second.select("seq")).agg(F.max("seq").alias("n")).first()
    )
    levels = levels_for((longest["n"] or 0) + 1, fanout)
    mine = [checkpointed(x) for x in merkle_levels(first, levels, fanout)]
    theirs = [checkpointed(x) for x in merkle_levels(second, levels, fanout)]
    suspects = None
    for a, b in zip(reversed(mine), reversed(theirs)):
        if suspects is not None:
            below = suspects.select(F.col("file"), F.col("node").alias("up"))
            a = a.withColumn("up", F.floor(F.col("node") / fanout)).join(
                below, ["file", "up"], "left_semi"
            )
            b = b.withColumn("up", F.floor(F.col("node") / fanout)).join(
                below, ["file", "up"], "left_semi"
            )
        a = a.select("file", "node", F.col("digest").alias("a"))
        b = b.select("file", "node", F.col("digest").alias("b"))
        suspects = checkpointed(
            a.join(b, ["file", "node"], "full_outer")
            .where(~F.col("a").eqNullSafe(F.col("b")))
            .select("file", "node")
        )
    at = suspects.withColumnRenamed("node", "seq")

    def side(records: DataFrame) -> DataFrame:
        same = Window.partitionBy("file", "record_id", "digest").orderBy("seq")
        return checkpointed(
            records.join(at, ["file", "seq"], "left_semi").withColumn("nth", F.row_number().over(same))
        )

    def paired(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
        columns = dict.fromkeys((*kept, *key, "nth"))
        a = a.select(*(F.col(c).alias(f"first_{c}") for c in columns))
        b = b.select(*(F.col(c).alias(f"second_{c}") for c in columns))
        on = F.col("first_file") == F.col("second_file")
        for c in (*key, "nth"):
            on = on & F.col(f"first_{c}").eqNullSafe(F.col(f"second_{c}"))
        return a.join(b, on, "full_outer").select(
            *(f"{name}_{c}" for name in ("first", "second") for c in kept)
        )

    def unpaired(pairs: DataFrame, name: str, other: str) -> DataFrame:
        # Numbered again within their id: what is left of it differs in content.
        left = pairs.where(F.col(f"{other}_seq").isNull()).select(
            *(F.col(f"{name}_{c}").alias(c) for c in kept)
        )
        again = Window.partitionBy("file", "record_id").orderBy("seq")
        return left.withColumn("nth", F.row_number().over(again))

    kept = ("file", "seq", "record_id", "offset")
    alike = checkpointed(paired(side(first), side(second), "record_id", "digest"))
    moved = alike.where(F.col("first_seq").isNotNull() & F.col("second_seq").isNotNull())
    rest = paired(
        unpaired(alike, "first", "second"), unpaired(alike, "second", "first"), "record_id"
    )
    fault = (
        F.when(F.col("second_seq").isNull(), "missing")
        .when(F.col("first_seq").isNull(), "added")
        .otherwise("changed")
    )
    return (
        moved.withColumn("fault", F.lit("shifted"))
        .unionByName(rest.withColumn("fault", fault))
        .where(
            (F.col("fault") != "shifted")
            | (F.col("first_seq") != F.col("second_seq"))
            | (F.col("first_offset") != F.col("second_offset"))
        )
        .select(
            F.coalesce("first_file", "second_file").alias("file"),
            F.coalesce("first_seq", "second_seq").alias("seq"),
            F.col("first_record_id").alias("first_id"),
            F.col("second_record_id").alias("second_id"),
            "first_offset",
            "second_offset",
            "fault",
        )
    )


def damaged(pages: DataFrame) -> DataFrame:
    """A second copy with known faults: in every 97th page the last character of the block has
    become a tilde, and pages whose id ends in 999 (the last of their file) are lost."""
    struck = F.col("page_id") % 97 == 13
    block = F.expr("concat(substring(html, 1, length(html) - 1), '~')")
    lost = F.coalesce(F.col("page_id") % FILE_RECORDS == FILE_RECORDS - 1, F.lit(False))
    return pages.where(~lost).withColumn("html", F.when(struck, block).otherwise(F.col("html")))
