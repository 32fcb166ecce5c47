"""Benchmark decontamination by spaced seeds, in built-in expressions only.

A seed hashes the words under the ones of a mask; what stands under the zeros may
have been replaced. Seeds of the benchmark meet the seeds of all documents; each
(document, item, diagonal) that shares one is then compared word by word.

The benchmark is broadcast only up to ``BROADCAST_SEEDS`` seeds a time; a larger
one is worked through in blocks of its seeds, each against all documents.

Cases: null and empty texts have no words and no hits; benchmark items of fewer
than five words hold no seed and are found only as the whole text of a document; items of equal words are one item, under
its smallest id; documents are told apart by id and text, so rows that share an id, or
have none, are each judged by their own text; empty tables give an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldkpi.llm.common import fresh, stored, text_or_empty

# Offsets of the words each mask reads. Chosen by enumeration: of 8 to 20
# words, whichever MIN_EQUAL and MIN_SHARE of them are equal, one mask at least has a hit.
MASKS = (
    (0, 1, 2, 3),
    (0, 1, 2, 5),
    (0, 1, 3, 6),
    (0, 1, 3, 7),
    (0, 1, 4, 6),
    (0, 1, 7, 8),
    (0, 2, 3, 4),
    (0, 2, 7, 8),
)
MIN_WORDS = 5
BROADCAST_SEEDS = 2_000_000
MIN_EQUAL = 8
MIN_SHARE = 0.6
# A part of an item counts too, if it is this long and this dense.
MIN_RUN = 13
MIN_DENSITY = 0.75


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, as 64-bit hashes."""
    parts = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def text_key() -> Column:
    """Tells different texts under one id apart; a null text is none of them."""
    return F.xxhash64("text").alias("text_key")


def seed_rows(
    rows: DataFrame, tokens: str, masks: Sequence[Sequence[int]] = MASKS
) -> DataFrame:
    """``rows`` without ``tokens``, one for each place and mask that fits: ``at, seed``.

    Shifted copies of the words are zipped, so that a row holds all a mask reads and
    generated code hashes it; expressions that call a function per element are far slower.
    """
    others = [c for c in rows.columns if c != tokens]
    offsets = sorted({o for mask in masks for o in mask})
    shifted = F.arrays_zip(
        *(F.slice(tokens, F.lit(o + 1), F.size(tokens)).alias(f"w{o}") for o in offsets)
    )
    placed = rows.select(*others, F.posexplode(shifted).alias("at", "w"))
    hashed = [
        F.when(
            F.col(f"w.w{max(mask)}").isNotNull(),
            F.xxhash64(F.lit(k), *(F.col(f"w.w{o}") for o in mask)),
        )
        for k, mask in enumerate(masks)
    ]
    return placed.select(*others, "at", F.explode(F.array(*hashed)).alias("seed")).where(
        F.col("seed").isNotNull()
    )


def longest_run(equal_at: Column) -> Column:
    """``n, words``: equal words and words of the longest stretch with ``MIN_DENSITY``.

    Of equal words a to b (of places p) the density suffices if key[b] + 1 - MIN_DENSITY >=
    key[a], where key[i] = i - MIN_DENSITY * p[i]. Two places move on: the end as long
    as a key at or after it suffices, else the start.
    """
    keys = F.transform(equal_at, lambda p, i: i - p * MIN_DENSITY)
    bound = F.transform(
        F.array(keys),
        lambda key: F.struct(
            key.alias("key"),
            F.transform(key, lambda _, i: F.array_max(F.slice(key, i + 1, F.size(key)))).alias(
                "top"
            ),
        ),
    )[0]
    zero = F.struct(
        *(F.lit(0).alias(c) for c in ("a", "b", "n", "at")), bound.alias("of"), equal_at.alias("p")
    )

    def step(acc: Column, _: Column) -> Column:
        a, b = acc["a"], acc["b"]
        inside = b < F.size(acc["p"])
        dense = F.get(acc["of"]["top"], b) + (1 - MIN_DENSITY + 1e-9) >= F.get(acc["of"]["key"], a)
        longer = inside & dense & (b - a + 1 > acc["n"])
        return F.struct(
            F.when(inside & ~dense, a + 1).otherwise(a).alias("a"),
            F.when(inside & dense, b + 1).otherwise(b).alias("b"),
            F.when(longer, b - a + 1).otherwise(acc["n"]).alias("n"),
            F.when(longer, a).otherwise(acc["at"]).alias("at"),
            acc["of"].alias("of"),
            acc["p"].alias("p"),
        )

    def close(acc: Column) -> Column:
        first, last = F.get(acc["p"], acc["at"]), F.get(acc["p"], acc["at"] + acc["n"] - 1)
        return F.struct(acc["n"].alias("n"), (last - first + 1).alias("words"))

    return F.aggregate(F.sequence(F.lit(1), 2 * F.size(equal_at)), zero, step, close)


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """Rows ``item_id, item_words``, one per different text with words."""
    return (
        benchmark.select("item_id", words(text_or_empty()).alias("item_words"))
        .where(F.size("item_words") > 0)
        .groupBy("item_words")
        .agg(F.min("item_id").alias("item_id"))
        .select("item_id", "item_words")
    )


def document_words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_key(), words(text_or_empty()).alias("tokens"))


def seed_hits(
    docs: DataFrame, items: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS
) -> DataFrame:
    """Rows ``doc_id, text_key, item_id, diagonal, skipped, covered, n_hits``; diagonal is the
    place of the item's word 0, ``covered`` the document's words along the item, and
    ``skipped`` how many words of the item lie before the text."""
    theirs = stored(
        seed_rows(
            items.where(F.size("item_words") >= MIN_WORDS).select(
                "item_id", F.size("item_words").alias("n_words"), "item_words"
            ),
            "item_words",
        ).withColumnRenamed("at", "item_at"),
        "benchmark-seeds",
    )
    # ``seed_rows`` gives up the words it hashes: a second column takes them along.
    ours = seed_rows(document_words(docs).withColumn("held", F.col("tokens")), "tokens")
    blocks = -(-theirs.count() // broadcast_seeds) or 1
    diagonal = F.col("at") - F.col("item_at")
    first = F.greatest(diagonal, F.lit(0))
    last = F.least(diagonal + F.col("n_words"), F.size("held"))
    hits = None
    for k in range(blocks):
        block = theirs if blocks == 1 else theirs.where(F.pmod("seed", F.lit(blocks)) == k)
        found = ours.join(F.broadcast(block), "seed").select(
            "doc_id",
            "text_key",
            "item_id",
            diagonal.alias("diagonal"),
            (first - diagonal).alias("skipped"),
            F.slice("held", first + 1, last - first).alias("covered"),
        )
        hits = found if hits is None else hits.unionByName(found)
    # The covered words follow from the text and the diagonal: as a key they cost no sort.
    return hits.groupBy("doc_id", "text_key", "item_id", "diagonal", "skipped", "covered").agg(
        F.count(F.lit(1)).alias("n_hits")
    )


def whole_short_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents whose words are all of an item of fewer than ``MIN_WORDS`` words, as rows of
    ``leaked_texts``."""
    few = F.size("tokens").between(1, MIN_WORDS - 1)
    short = items.where(F.size("item_words") < MIN_WORDS)
    n = F.size("tokens").cast("long")
    return (
        document_words(docs)
        .where(few)
        .join(short, F.col("tokens") == F.col("item_words"))
        .groupBy("doc_id", "text_key", "item_id", "tokens")
        .agg(F.count(F.lit(1)).alias("n_hits"))
        .select(
            "doc_id",
            "text_key",
            "item_id",
            n.alias("item_words"),
            F.lit(0).cast("long").alias("start"),
            n.alias("n_equal"),
            n.alias("run_words"),
            "n_hits",
        )
    )


def leaked_passages(
    docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS
) -> DataFrame:
    """``leaked_texts`` without its ``text_key``."""
    return leaked_texts(docs, benchmark, broadcast_seeds).drop("text_key")


def leaked_texts(
    docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS
) -> DataFrame:
    """Rows ``doc_id, text_key, item_id, item_words, start, n_equal, run_words, n_hits``.

    One row per document (id and text) and item, its best alignment. ``start`` is the word of the
    document where the item begins (negative: before the text), ``n_equal`` the equal words
    of the whole alignment, ``run_words`` the words of its longest dense stretch.
    """
    docs = docs.select("doc_id", "text")
    items = stored(benchmark_items(benchmark), "benchmark-items")
    hits = stored(seed_hits(docs, items, broadcast_seeds), "seed-hits")
    lengths = F.size("item_words")
    aligned = (
        hits.join(items, "item_id")
        .withColumn(
            "equal_at",
            F.filter(
                F.sequence(F.lit(0), lengths - 1),
                lambda i: F.coalesce(
                    F.get("covered", F.when(i >= F.col("skipped"), i - F.col("skipped")))
                    == F.get("item_words", i),
                    F.lit(False),
                ),
            ),
        )
        .select(
            "doc_id",
            "text_key",
            "item_id",
            lengths.alias("n_words"),
            "diagonal",
            "n_hits",
            F.size("equal_at").alias("n_equal"),
            "equal_at",
        )
    )
    whole = (F.col("n_equal") >= F.least(F.lit(MIN_EQUAL), F.col("n_words"))) & (
        F.col("n_equal") >= F.col("n_words") * MIN_SHARE
    )
    judged = aligned.where(whole | (F.col("n_equal") >= MIN_RUN)).withColumn(
        "run", longest_run(F.col("equal_at"))
    )
    part = F.col("run.n") >= MIN_RUN
    best = F.max(
        F.struct(
            "n_equal",
            "n_hits",
            (-F.col("diagonal")).alias("early"),
            F.col("run.words").alias("run_words"),
            "n_words",
        )
    )
    long_items = (
        judged.where(whole | part)
        .groupBy("doc_id", "text_key", "item_id")
        .agg(best.alias("b"))
        .select(
            "doc_id",
            "text_key",
            "item_id",
            F.col("b.n_words").cast("long").alias("item_words"),
            (-F.col("b.early")).cast("long").alias("start"),
            F.col("b.n_equal").cast("long").alias("n_equal"),
            F.col("b.run_words").cast("long").alias("run_words"),
            F.col("b.n_hits").alias("n_hits"),
        )
    )
    if items.where(lengths < MIN_WORDS).isEmpty():
        return long_items
    return long_items.unionByName(whole_short_items(docs, items))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents no benchmark item was found in, with all their columns.

    Only rows with a leaked text go: not others of its id, or others without id.
    """
    leaked, key = fresh(docs, "leaked", "leaked_key")
    bad = stored(
        leaked_texts(docs, benchmark)
        .select(F.col("doc_id").alias(leaked), F.col("text_key").alias(key))
        .distinct(),
        "leaked",
    )
    found = docs["doc_id"].eqNullSafe(bad[leaked]) & (F.xxhash64(docs["text"]) == bad[key])
    return docs.join(bad, found, "left_anti")
