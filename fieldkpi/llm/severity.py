"""Toxicity severity by cumulative-link (proportional odds) regression on sparse words.

P(grade <= k | x) = sigmoid(threshold_k - w.x): one weight per word, shared by all
thresholds, which are ordered by construction. The model is fitted on a bounded
sample of labelled documents (``SAMPLE`` per label); every document is scored.

The labels only say toxic or not. The grades of toxic documents follow from how
many of its words are typical of toxic ones in the sample (a smoothed log-odds
lexicon), cut at thirds of the toxic sample: 0 clean, 1 mild, 2 medium, 3 severe.

Cases: a null or empty text has no features and gets the grade odds of the
thresholds alone; a null label is not used; repeated rows are scored and counted
each; with no labels, or of one kind only, every document gets severity 0; extra
columns stay where the caller keeps them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldkpi.llm.common import fresh, stored, travels

travels(__name__)

SAMPLE = 4000
GRADES = 4
REJECT_AT = 0.2
# Standard errors by which a word's share of toxic documents must differ to be a feature.
MIN_Z = 4.0
MIN_DOCS = 4
_WORD = re.compile(r"\w+")


@dataclass
class Model:
    """Word weights and ordered thresholds; without weights everything is grade 0."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=lambda: [math.inf] * (GRADES - 1))

    def score(self, text: str | None) -> float:
        known = self.weights
        counts = Counter(w for w in _WORD.findall((text or "").lower()) if w in known)
        return math.fsum(known[w] * (1.0 + math.log(c)) for w, c in counts.items())

    def grade_chances(self, scores: np.ndarray) -> np.ndarray:
        """One row per score, one column per grade."""
        cuts = np.asarray(self.thresholds)[None, :] - np.asarray(scores, float)[:, None]
        upto = 1.0 / (1.0 + np.exp(-np.clip(cuts, -700, 700)))
        edges = np.hstack([np.zeros((len(scores), 1)), upto, np.ones((len(scores), 1))])
        return np.diff(edges, axis=1)


def labelled_words(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """``(documents, rows, spelled)`` of at most ``sample`` documents of each label:
    ``row, toxic`` of those with a common word, ``row, key, n`` of words that can be features
    or grade a document, as hashes, and these words by hash. Rows are Arrow columns.

    The sample is drawn by a hash of the id, so it is the same in every run. Only it is
    broadcast (two times ``sample`` ids). Words are counted and chosen in Spark: what comes
    to the driver are the sampled ids and the counts of the chosen words.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select(
        "doc_id", "toxic"
    )
    drawn = None
    for value in (0, 1):
        part = (
            known.where(F.col("toxic") == value)
            .orderBy(F.xxhash64("doc_id"), "doc_id")
            .limit(sample)
        )
        drawn = part if drawn is None else drawn.unionByName(part)
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for doc, text, toxic in zip(rows["doc_id"], rows["text"], rows["toxic"]):
                words = Counter(_WORD.findall((text or "").lower()))
                out += [(doc, toxic, w, n) for w, n in words.items()]
            yield pd.DataFrame(out, columns=["row", "toxic", "word", "n"])

    counted = stored(
        texts.mapInPandas(count, "row long, toxic int, word string, n int"), "labelled-words"
    )
    common = (
        counted.groupBy("word")
        .agg(F.count(F.lit(1)).alias("d"), F.sum("toxic").alias("in_bad"))
        .where(F.col("d") >= MIN_DOCS)
    )
    documents = (
        counted.join(common, "word").groupBy("row").agg(F.max("toxic").alias("toxic")).toArrow()
    )
    toxic = documents["toxic"].to_numpy()
    n_bad, n_good = int((toxic == 1).sum()), int((toxic == 0).sum())
    if not n_bad or not n_good:
        return documents, None, {}
    in_bad, in_good = F.col("in_bad"), F.col("d") - F.col("in_bad")
    p = F.col("d") / (n_bad + n_good)
    error = F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) * (1 / n_bad + 1 / n_good))
    # A little wider than ``telling`` and ``derive_grades``, which decide.
    tells = F.abs(in_bad / n_bad - in_good / n_good) >= MIN_Z * error * 0.999
    grades = in_bad >= 0.0099 * n_bad
    key = F.xxhash64("word").alias("key")
    chosen = common.where(tells | grades).select("word", key)
    rows = counted.join(chosen, "word").select("row", "key", "n").toArrow()
    names = chosen.toArrow()
    return documents, rows, dict(zip(names["key"].to_pylist(), names["word"].to_pylist()))


def derive_grades(
    rows: np.ndarray, words: np.ndarray, counts: np.ndarray, toxic: np.ndarray
) -> np.ndarray:
    """Grade of each sampled document from its label and its toxic-typical words."""
    n_words = int(words.max(initial=-1)) + 1
    bad = toxic[rows] == 1
    in_bad = np.bincount(words[bad], minlength=n_words)
    in_good = np.bincount(words[~bad], minlength=n_words)
    n_bad, n_good = max(1, int((toxic == 1).sum())), max(1, int((toxic == 0).sum()))
    odds = np.log((in_bad + 0.5) / (n_bad + 1.0)) - np.log((in_good + 0.5) / (n_good + 1.0))
    typical = (odds >= 2.0) & (in_bad >= 0.01 * n_bad)
    hits = np.bincount(rows, weights=counts * typical[words], minlength=len(toxic))
    cuts = np.quantile(hits[toxic == 1], [1 / 3, 2 / 3]) if (toxic == 1).any() else [0.0, 0.0]
    return np.where(toxic == 1, 1 + (hits > cuts[0]) + (hits > cuts[1]), 0).astype(int)


def fit_ordinal(
    rows: np.ndarray,
    cols: np.ndarray,
    vals: np.ndarray,
    grades: np.ndarray,
    n_cols: int,
    l2: float = 1e-3,
    steps: int = 200,
    rate: float = 0.1,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that minimise the mean cumulative-link loss (Adam).

    Thresholds are a first one and positive gaps, so their order cannot break.
    """
    n, cuts = len(grades), GRADES - 1
    params = np.zeros(n_cols + cuts)
    params[n_cols] = 1.0
    first = np.zeros_like(params)
    second = np.zeros_like(params)

    def sigmoid(v: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(v, -500, 500)))

    for step in range(1, steps + 1):
        w, gaps = params[:n_cols], np.exp(params[n_cols + 1 :])
        theta = params[n_cols] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, weights=vals * w[cols], minlength=n)
        high = np.where(grades < cuts, sigmoid(theta[np.minimum(grades, cuts - 1)] - score), 1.0)
        low = np.where(grades > 0, sigmoid(theta[np.maximum(grades - 1, 0)] - score), 0.0)
        chance = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / chance / n, low * (1 - low) / chance / n
        slope = d_high - d_low  # of the loss, by score
        grad = np.empty_like(params)
        grad[:n_cols] = np.bincount(cols, weights=vals * slope[rows], minlength=n_cols) + l2 * w
        by_cut = np.zeros(cuts)
        np.add.at(by_cut, np.minimum(grades, cuts - 1), np.where(grades < cuts, -d_high, 0.0))
        np.add.at(by_cut, np.maximum(grades - 1, 0), np.where(grades > 0, d_low, 0.0))
        above = np.cumsum(by_cut[::-1])[::-1]
        grad[n_cols] = above[0]
        grad[n_cols + 1 :] = above[1:] * gaps
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        params -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(params[n_cols + 1 :])
    return params[:n_cols], params[n_cols] + np.concatenate([[0.0], np.cumsum(gaps)])


def telling(rows: np.ndarray, words: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Words whose shares of toxic and of clean documents differ by ``MIN_Z`` errors."""
    n = int(words.max(initial=-1)) + 1
    bad = toxic[rows] == 1
    n_bad, n_good = int((toxic == 1).sum()), int((toxic == 0).sum())
    in_bad, in_good = np.bincount(words[bad], minlength=n), np.bincount(words[~bad], minlength=n)
    p = (in_bad + in_good) / (n_bad + n_good)
    error = np.sqrt(p * (1 - p) * (1 / n_bad + 1 / n_good) + 1e-12)
    return np.abs(in_bad / n_bad - in_good / n_good) >= MIN_Z * error


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    documents, found, spelled = labelled_words(docs, labels, sample)
    if found is None:
        return Model()
    # In order of document and word, so that sums of doubles come out the same in every run.
    by_row = np.argsort(documents["row"].to_numpy())
    ids = documents["row"].to_numpy()[by_row]
    toxic = documents["toxic"].to_numpy()[by_row].astype(int)
    order = np.lexsort((found["key"].to_numpy(), found["row"].to_numpy()))
    rows = np.searchsorted(ids, found["row"].to_numpy()[order])
    hashes, words = np.unique(found["key"].to_numpy()[order], return_inverse=True)
    names = [spelled[int(h)] for h in hashes]
    counts = found["n"].to_numpy()[order].astype(float)
    grades = derive_grades(rows, words, counts, toxic)
    used = telling(rows, words, toxic)[words]
    weights, thresholds = fit_ordinal(
        rows[used], words[used], 1.0 + np.log(counts[used]), grades, len(names)
    )
    kept = np.abs(weights) > 1e-4
    return Model(
        {names[i]: float(weights[i]) for i in np.flatnonzero(kept)},
        [float(t) for t in thresholds],
    )


def severity_udf(model: Model):
    """Pandas UDF: text to (chances, expected severity)."""
    sent = model

    @F.pandas_udf("chances array<double>, expected double")
    def severity(text: pd.Series) -> pd.DataFrame:
        scores = np.fromiter((sent.score(t) for t in text), float, len(text))
        chances = sent.grade_chances(scores)
        return pd.DataFrame(
            {"chances": list(chances), "expected": chances @ np.arange(GRADES, dtype=float)}
        )

    return severity


def severity_report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows ``doc_id, expected_severity, grade, p_0 .. p_3, toxic``, one per document."""
    found = docs.select(
        "doc_id", severity_udf(train(docs, labels, sample))(F.col("text")).alias("s")
    )
    chances = F.col("s.chances")
    return found.select(
        "doc_id",
        F.round("s.expected", 9).alias("expected_severity"),
        (F.array_position(chances, F.array_max(chances)) - 1).cast("int").alias("grade"),
        *(F.round(F.get(chances, F.lit(k)), 9).alias(f"p_{k}") for k in range(GRADES)),
        (F.col("s.expected") >= REJECT_AT).alias("toxic"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents below the rejection severity, with all their columns."""
    severity = severity_udf(train(docs, labels, sample))
    (expected,) = fresh(docs, "expected_severity")
    scored = docs.withColumn(expected, severity(F.col("text"))["expected"])
    return scored.where(F.col(expected) < REJECT_AT).drop(expected)
