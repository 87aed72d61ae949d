"""Quality classifier by Bradley-Terry pairwise ranking.

A preference pair says that one document is better than another. The probability of that
is the logistic function of the difference of their scores, a score being linear in the
document's features, so the model is a logistic regression without a constant on feature
differences. A quantile of the training scores is the threshold. The weights come from a
bounded sample; mean, spread, the share of bad labels and the quantile from all training rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import map_texts, pick, ship, stored

# Labelled rows that the weights are fitted on, at most; which ones follows from their doc_id.
MAX_LABELLED = 30_000
# Keys of scores that are sorted on the driver; more are counted in bins first.
MAX_KEYS = 30_000
# Parts of 1 that features, and squares of their distances, are added up in: sums of whole
# numbers come out the same in any order.
_FINE, _FINER = 2.0**40, 2.0**48
MAX_PAIRS = 150_000
PENALTY = 1e-3
# Score of a document on the threshold.
THRESHOLD = 0.7
_UPPER, _LOWER = slice(65, 91), slice(97, 123)
FEATURES = (
    "log_words",
    "word_length",
    "upper",
    "digits",
    "marks",
    "commas_stops",
    "blanks",
    "lines",
    "non_ascii",
    "distinct",
    "top_word",
    "repeats",
    "pairs",
    "same_lines",
    "odd_ends",
    "empty",
)


def features(text: str | None) -> list[float]:
    """What a text looks like, whatever its language; all zero but ``empty`` for none."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, n_words = len(data), len(words)
    upper, lower = int(count[_UPPER].sum()), int(count[_LOWER].sum())
    digits, high = int(count[48:58].sum()), int(count[128:].sum())
    blanks = int(count[32] + count[9:14].sum())
    plain = int(count[44] + count[46])
    marks = n - upper - lower - digits - high - blanks - plain
    times = Counter(words)
    lines = [line for line in data.split(b"\n") if line]
    ends = sum(word[-1] < 128 and not word[-1:].isalnum() and word[-1] not in b".,;:?)" for word in words)
    return [
        np.log(n_words),
        np.log(n / n_words),
        upper / max(1, upper + lower),
        digits / n,
        marks / n,
        plain / n_words,
        blanks / n,
        np.log(n_words / max(1, len(lines))),
        high / n,
        np.log(len(times)) / np.log(n_words + 1),
        np.log(max(times.values()) / n_words + 0.01),
        sum(a == b for a, b in zip(words, words[1:])) / n_words,
        len(set(zip(words, words[1:]))) / n_words,
        1 - len(set(lines)) / max(1, len(lines)),
        ends / n_words,
        0.0,
    ]


def expanded(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised features, cut at 4 spreads, and their squares."""
    z = np.clip((x - mean) / spread, -4, 4)
    return np.hstack([z, z * z])


class Model(NamedTuple):
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Added up row by row, so a row's score does not depend on the rows beside it."""
        return (expanded(x, self.mean, self.spread) * self.weights).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """In (0, 1), :data:`THRESHOLD` on the threshold; keeps the order of the raw scores."""
        raw = self.raw(x)
        shift = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(self.scale * (raw - self.threshold) + shift, -30, 30)))


def fit(
    x: np.ndarray,
    good: np.ndarray,
    seed: int = 42,
    max_pairs: int = MAX_PAIRS,
    mean: np.ndarray | None = None,
    spread: np.ndarray | None = None,
) -> Model:
    """Bradley-Terry by Newton steps on pairs of a good and a bad document.

    Each document is in about as many pairs as any other of its class. The threshold is
    the quantile of the scores that leaves the share of bad labels below it, moved to the
    middle of the gap there. With labels of one kind only there is no pair, every score
    is equal, and all documents count as that kind. ``mean`` and ``spread`` are those of
    ``x`` if not given.
    """
    mean = x.mean(0) if mean is None else mean
    spread = np.maximum(x.std(0) if spread is None else spread, 1e-6)
    z = expanded(x, mean, spread)
    above, below = np.flatnonzero(good), np.flatnonzero(~good)
    weights = np.zeros(z.shape[1])
    if not len(above) or not len(below):
        return Model(mean, spread, weights, -1.0 if len(above) else 1.0, 4.0)
    rng = np.random.default_rng(seed)
    n = min(max_pairs, len(above) * len(below))
    pairs = [np.concatenate([rng.permutation(side) for _ in range(-(-n // len(side)))])[:n] for side in (above, below)]
    d = z[pairs[0]] - z[pairs[1]]
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(d @ weights, -30, 30)))
        gradient = d.T @ (1 - p) / n - PENALTY * weights
        curve = (d * (p * (1 - p))[:, None]).T @ d / n + PENALTY * np.eye(len(weights))
        step = np.linalg.solve(curve, gradient)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    model = Model(mean, spread, weights, 0.0, 1.0)
    raw = np.sort(model.raw(x))
    at = min(max(len(below), 1), len(raw) - 1)
    return model._replace(threshold=float(raw[at - 1] + raw[at]) / 2)


def statistics(docs: DataFrame) -> DataFrame:
    """Per row: doc_id and the features of its whole text as an array; narrow."""
    return map_texts(docs, lambda: lambda texts: [(features(text),) for text in texts], "x array<double>")


def labelled_rows(rows: DataFrame, labels: DataFrame, use: Column) -> DataFrame:
    """All labelled rows that ``use`` takes: x, quality, digest (md5 of doc_id)."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return rows.filter(use).join(known, "doc_id").select("x", "quality", F.md5(F.col("doc_id").cast("string")).alias("digest"))


def labelled_sample(found: DataFrame, n: int, limit: int) -> DataFrame:
    """Up to ``limit`` of the ``n`` labelled rows, those of the smallest md5 of doc_id.

    A bound on the md5 that a few more rows than that stay below is applied first, so
    that tasks do not each send as many to the driver.
    """
    if n > limit:
        # Four standard deviations above what is wanted.
        share = min(1.0, (limit + 4 * limit**0.5 + 10) / n)
        found = found.filter(F.col("digest") < F.lit(f"{int(share * 0xFFFFFFFF):08x}"))
    return found.orderBy("digest", "x").limit(limit).drop("digest")


def _means(found: DataFrame, value: Callable[[Column, int], Column], parts: float) -> tuple[np.ndarray, int, int]:
    """The mean of a value of each feature over all rows, how many rows there are, and
    how many of them are bad."""
    sums = [F.sum(F.floor(value(F.col("x")[i], i) * parts).cast("decimal(20,0)")) for i in range(len(FEATURES))]
    bad = F.coalesce(F.sum(F.when(F.col("quality") > 0, 0).otherwise(1)), F.lit(0))
    *totals, n, n_bad = found.agg(*[F.coalesce(total, F.lit(0)) for total in sums], F.count("*"), bad).first()
    return np.array([int(total) / parts / max(n, 1) for total in totals]), n, n_bad


def score_keys(found: DataFrame, model: Model) -> DataFrame:
    """key: a whole number for each row's raw score, in the order of the scores."""
    ship(found.sparkSession)

    @F.pandas_udf("long")
    def key(x):
        import pandas as pd

        return pd.Series(_keys(model.raw(np.stack(x.to_numpy()))) if len(x) else [], dtype="int64")

    return found.select(key("x").alias("key"))


def _keys(raw: np.ndarray) -> np.ndarray:
    # Of numbers below 0 all bits but the sign turn round; 0.0 takes the place of -0.0.
    bits = (raw + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF)


def order_statistics(keys: DataFrame, rank: int, most: int = MAX_KEYS) -> tuple[float, float]:
    """The raw scores at ``rank`` (from 0) and right after it, exactly.

    Rows are counted by the first 16 bits of their keys, then, within the bin that holds
    the rank, by the next 16, until a bin is small enough to be sorted.
    """
    left, before = keys, 0
    for shift in (48, 32, 16, 0):
        bins = left.groupBy(F.shiftright("key", shift).alias("bin")).agg(F.count("*").alias("n")).orderBy("bin").collect()
        for row in bins:
            if before + row.n > rank:
                break
            before += row.n
        left = left.filter(F.shiftright("key", shift) == row.bin)
        if row.n <= most or not shift:
            break
    # In the last bin all keys are equal, and any number of them can be.
    some = sorted(r.key for r in left.collect()) if row.n <= most else None
    first = some[rank - before] if some else row.bin
    if rank + 1 < before + row.n:
        after = some[rank + 1 - before] if some else first
    else:
        after = keys.filter(F.col("key") > first).agg(F.min("key")).first()[0]
        after = first if after is None else after
    low, high = _scores([first, after]).tolist()
    return low, high


def _scores(keys: list[int]) -> np.ndarray:
    bits = np.array(keys, np.int64)
    return (bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF)).view(np.float64)


def train(rows: DataFrame, labels: DataFrame, use: Column, limit: int = MAX_LABELLED) -> Model:
    found = stored(labelled_rows(rows, pick(labels, "doc_id", "quality"), use), "labelled")
    mean, n, n_bad = _means(found, lambda x, i: x, _FINE)
    if not n:
        return fit(np.zeros((1, len(FEATURES))), np.array([True]))
    square, *_ = _means(found, lambda x, i: (x - F.lit(float(mean[i]))) * (x - F.lit(float(mean[i]))), _FINER)
    sample = labelled_sample(found, n, limit).collect()
    x = np.array([row.x for row in sample], float).reshape(-1, len(FEATURES))
    good = np.array([row.quality > 0 for row in sample])
    model = fit(x, good, mean=mean, spread=np.sqrt(square))
    if good.all() or not good.any():
        return model
    # The quantile of all rows, not of the sampled ones.
    at = min(max(n_bad, 1), n - 1)
    return model._replace(threshold=sum(order_statistics(stored(score_keys(found, model), "keys"), at - 1)) / 2)


def held_out(modulus: int = 4, remainder: int = 2) -> Column:
    """Rows that training leaves out; a null doc_id has no label and counts as not held out."""
    number = F.crc32(F.col("doc_id").cast("string")) % modulus
    return F.coalesce(number == remainder, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.7, else 0).

    The features are made once, in one narrow pass over the texts, and written; labels
    are joined to them, so no text is shuffled. Of labelled rows that are not held out the
    weights come from at most ``limit``; mean, spread and threshold from all. A null text counts as empty and is scored like one;
    repeated rows each give a row; of several labels of a document the lowest counts; a
    label above 0 is good; an empty table gives no rows, and without labels all score alike; a very
    long text is read whole by one task; other columns are ignored.
    """
    rows = stored(statistics(docs), "quality")
    model = train(rows, labels, ~held_out(), limit)

    @F.pandas_udf("double")
    def score(x):
        import pandas as pd

        return pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

    scored = rows.select("doc_id", held_out().alias("held_out"), score("x").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
