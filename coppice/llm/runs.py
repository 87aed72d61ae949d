"""Runs of words that repeat with a period, found by minimizers on several scales.

Equal words a period apart are found directly for periods up to :data:`SHORT`, one lag
after the other. For longer ones each scale covers the periods of (2^s, 2^(s+1)]: inside
a run the minimum of a window of word k-grams is again a minimum one period on, so
pairs of equal minimizers that far apart are the seeds, and a seed whose neighbourhood
repeats is extended word by word. K-grams that lie inside a run of a period under a third
of their length are no minimizers; so one of a kind stands on every k/3 places at most,
and a place has a dozen partners at most, in whatever text. A longer run has a k-gram that
is none of these in each of its periods, or it would itself be one of the short period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from coppice.llm.common import pick, ship

# Shortest run, in words, and fewest repeats of the period.
MIN_WORDS, MIN_PERIODS = 24, 3
# Periods that are found by direct scans; the k-grams of the first scale have half as many words.
SHORT = 64
# Bytes of text that are scanned together.
BYTES = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Run(NamedTuple):
    start: int
    length: int
    period: int


def planted(words: list[bytes], doc_id) -> list[bytes]:
    """The words, of one document in ten with a tail that repeats (fixed rule of the query)."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _primes(q: int) -> list[int]:
    return [p for p in range(2, q + 1) if q % p == 0 and all(p % d for d in range(2, p))]


_FACTORS = {q: [q // p for p in _primes(q)] for q in range(1, SHORT + 1)}


def _stretches(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Begin and end of each maximal run of true values of at least the given length."""
    if len(equal) < least:
        return []
    # Such a stretch covers a place that is a multiple of its least length.
    at = np.flatnonzero(equal[least - 1 :: least])
    if not len(at):
        return []
    hits = np.flatnonzero(equal)
    cuts = np.flatnonzero(np.diff(hits) > 1)
    begins, ends = hits[np.r_[0, cuts + 1]], hits[np.r_[cuts, len(hits) - 1]] + 1
    long = ends - begins >= least
    return list(zip(begins[long].tolist(), ends[long].tolist()))


def _short_runs(ids: np.ndarray) -> list[Run]:
    """Runs with a period up to :data:`SHORT`, from one comparison of all words per lag."""
    found = []
    for q in range(1, SHORT + 1):
        for begin, end in _stretches(ids[q:] == ids[:-q], max(MIN_WORDS, MIN_PERIODS * q) - q):
            stretch = ids[begin : end + q]
            # A shorter period of a stretch this long divides q.
            if not any(np.array_equal(stretch[d:], stretch[:-d]) for d in _FACTORS[q] if d < q):
                found.append(Run(begin, end + q - begin, q))
    return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of word k-grams from one pass of prefix sums; equal k-grams have equal ones."""

    def __init__(self, ids: np.ndarray) -> None:
        n = len(ids)
        powers = np.full(n + 1, _BASE, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        back = np.full(n + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
        back[0] = 1
        self.back = np.multiply.accumulate(back)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_mixed(ids.astype(np.uint64) + np.uint64(1)) * powers[:n], out=self.prefix[1:])

    def grams(self, k: int) -> np.ndarray:
        """Of all k-grams, by place."""
        return (self.prefix[k:] - self.prefix[:-k]) * self.back[: len(self.prefix) - k]

    def at(self, places: np.ndarray, k: np.ndarray) -> np.ndarray:
        return (self.prefix[places + k] - self.prefix[places]) * self.back[places]


def _window(x: np.ndarray, width: int, best) -> np.ndarray:
    """Minimum or maximum of each window whose width is a power of two."""
    step = 1
    while step < width:
        x = best(x[:-step], x[step:])
        step *= 2
    return x


def _seeds(ids: np.ndarray, hashes: Hashes, owner: np.ndarray, found: Sequence[Run], scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of equal minimizers 2^scale + 1 to 2^(scale + 1) words apart."""
    k = 1 << (scale - 1)
    none = np.zeros(0, np.int64)
    if len(ids) < 2 * k:
        return none, none
    grams = _mixed(hashes.grams(k))
    grams[grams == _NONE] = 0
    # A k-gram lies in one document, and in no run of a period under a third of its length.
    inside = owner[: len(grams)] == owner[k - 1 :]
    for run in found:
        if run.period * 3 <= k <= run.length:
            inside[run.start : run.start + run.length - k + 1] = False
    grams[~inside] = _NONE
    least = _window(grams, k, np.minimum)
    # The largest minimum of the windows around a place is its own if it is one of them.
    around = np.concatenate([np.zeros(k - 1, np.uint64), least, np.zeros(k - 1, np.uint64)])
    places = np.flatnonzero((_window(around, k, np.maximum) == grams) & (grams != _NONE))
    order = np.argsort(grams[places], kind="stable")
    places = places[order]
    keys = grams[places]
    seeds, lags = [none], [none]
    for step in count(1):
        far = places[step:] - places[:-step]
        near = (keys[step:] == keys[:-step]) & (far <= 2 << scale)
        if not near.any():
            break
        kept = near & (far > 1 << scale) & (owner[places[step:]] == owner[places[:-step]])
        seeds.append(places[:-step][kept])
        lags.append(far[kept])
    return np.concatenate(seeds), np.concatenate(lags)


def _grown(ids: np.ndarray, at: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """The stretch around a place within [low, high) whose words equal those a lag later."""
    begin, end, step = at, at, 64
    while end + lag < high:
        stop = min(end + step, high - lag)
        differ = np.flatnonzero(ids[end:stop] != ids[end + lag : stop + lag])
        if len(differ):
            end += int(differ[0])
            break
        end, step = stop, step * 2
    step = 64
    while begin > low:
        stop = max(begin - step, low)
        differ = np.flatnonzero(ids[stop:begin] != ids[stop + lag : begin + lag])
        if len(differ):
            begin = stop + int(differ[-1]) + 1
            break
        begin, step = stop, step * 2
    return begin, end


def _long_runs(ids: np.ndarray, owner: np.ndarray, starts: np.ndarray, found: list[Run]) -> list[Run]:
    """Runs with a period above :data:`SHORT`; ``found`` has those of shorter periods."""
    lengths = np.diff(starts)
    found = list(found)
    hashes = None
    scale = SHORT.bit_length() - 1
    while MIN_PERIODS << scale < lengths.max(initial=0):
        hashes = hashes or Hashes(ids)
        places, lags = _seeds(ids, hashes, owner, found, scale)
        if len(places):
            # What repeats around a seed has two periods to one side of it or the other.
            low, high = starts[owner[places]], starts[owner[places] + 1]
            square = np.zeros(len(places), bool)
            for shift in (0, 1):
                begin = places - shift * lags
                fits = np.flatnonzero((begin >= low) & (begin + 2 * lags <= high))
                b, q = begin[fits], lags[fits]
                square[fits] |= hashes.at(b, q) == hashes.at(b + q, q)
            done: dict[tuple[int, int], int] = {}
            new = set()
            for i in np.flatnonzero(square)[np.argsort(places[square], kind="stable")].tolist():
                at, lag, doc = int(places[i]), int(lags[i]), int(owner[places[i]])
                if done.get((doc, lag), -1) > at:
                    continue
                begin, end = _grown(ids, at, lag, int(low[i]), int(high[i]))
                done[doc, lag] = max(end, at + 1)
                if end + lag - begin >= max(MIN_WORDS, MIN_PERIODS * lag):
                    new.add(Run(begin, end + lag - begin, lag))
            for run in sorted(new, key=lambda run: run.period):
                stretch = ids[run.start : run.start + run.length]
                if not any(np.array_equal(stretch[d:], stretch[:-d]) for d in _proper(run.period)):
                    found.append(run)
        scale += 1
    return found


def _proper(q: int) -> list[int]:
    """q divided by each of its prime factors: every shorter period of a run with period q
    divides one of these."""
    out, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return [*out, *([q // rest] if rest > 1 else [])]


def find_runs(texts: Sequence[Sequence]) -> list[list[Run]]:
    """Per sequence of words its runs, by start and then period."""
    number: defaultdict = defaultdict(count().__next__)
    lengths = np.array([len(words) for words in texts], np.int64)
    # One word of its own after each sequence, so that nothing equal reaches across.
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    ids = np.empty(starts[-1], np.int32)
    for i, words in enumerate(texts):
        ids[starts[i] : starts[i + 1] - 1] = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
        ids[starts[i + 1] - 1] = -1 - i
    owner = np.repeat(np.arange(len(texts)), lengths + 1)
    runs: list[list[Run]] = [[] for _ in texts]
    found = _short_runs(ids) if len(ids) else []
    # Only sequences that are long enough for it are searched for long periods.
    long = np.flatnonzero(lengths > MIN_PERIODS * SHORT)
    if len(long):
        keep = np.isin(owner, long)
        moved = np.cumsum(keep) - 1
        begins = np.concatenate([[0], np.cumsum(lengths[long] + 1)])
        short = [run._replace(start=int(moved[run.start])) for run in found if keep[run.start]]
        all_runs = _long_runs(ids[keep], np.repeat(np.arange(len(long)), lengths[long] + 1), begins, short)
        back = np.flatnonzero(keep)
        found += [run._replace(start=int(back[run.start])) for run in all_runs[len(short) :]]
    for run in found:
        i = int(owner[run.start])
        runs[i].append(run._replace(start=run.start - int(starts[i])))
    return [sorted(own, key=lambda run: (run.start, run.period)) for own in runs]


def strongest(runs: Sequence[Run]) -> Run | None:
    """The run with the greatest exact length / period; the smallest start, then period, of equals."""
    best = None
    for run in sorted(runs, key=lambda run: (run.start, run.period)):
        if best is None or run.length * best.period > best.length * run.period:
            best = run
    return best


def collapsed(words: Sequence, runs: Sequence[Run]) -> list:
    """The words without those that a run holds after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for run in runs:
        drop[run.start + run.period] += 1
        drop[run.start + run.length] -= 1
    gone = np.cumsum(drop)[:-1]
    return [word for word, n in zip(words, gone.tolist()) if not n]


def periodic_runs(docs: DataFrame, rewrite=None) -> DataFrame:
    """Per row: doc_id, n_runs, start, length, period and exponent_milli of the run with the
    greatest length / period (nulls where there is none), runs_sha256 (of a line
    ``start,length,period`` for each run), collapsed_sha256 (of the words left, joined by a
    blank), n_words, n_kept.

    A run is a stretch of at least 24 words and three times its smallest period that no
    neighbouring word extends. Words are what stands between blanks, numbered from 0;
    ``rewrite`` may change the words of a row (words, doc_id) before they are searched.
    A null or empty text has no words, hence no runs and the digests of nothing. Rows that
    agree come back as often; a null doc_id is a row like others; an empty table gives none;
    other columns are ignored. Very long texts are searched whole, each by itself.
    """
    ship(docs.sparkSession)
    rows = pick(docs, "doc_id", "text")
    types = (
        "n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string, n_words long, n_kept long"
    )
    made = StructType.fromDDL(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(made)
        for batch in batches:
            for part in _parts(batch):
                texts = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    words = text.encode().split() if text else []
                    texts.append(rewrite(words, doc_id) if rewrite else words)
                found = [_row(words, runs) for words, runs in zip(texts, find_runs(texts))]
                arrays = [pa.array(values, field.type) for values, field in zip(zip(*found), arrow)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=["doc_id", *arrow.names])

    return rows.mapInArrow(run, StructType([rows.schema["doc_id"], *made]))


def _row(words: list[bytes], runs: list[Run]) -> tuple:
    best = strongest(runs)
    lines = "".join(f"{run.start},{run.length},{run.period}\n" for run in runs)
    kept = collapsed(words, runs) if runs else words
    shown = (*best, 1000 * best.length // best.period) if best else (None,) * 4
    digests = hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()
    return (len(runs), *shown, *digests, len(words), len(kept))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of some megabytes of text; a longer text is a part of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if batch.num_rows:
        yield batch.slice(start)
