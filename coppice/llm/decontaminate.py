"""Benchmark decontamination with a positional inverted index.

The index is a stored table, cut by documents: a row per shard of documents holds the
terms that occur there, in order, each with its postings (the places where it stands),
and whose documents they are. A window of item words is looked up from its rarest
term in a shard: the lists are shifted by each term's place in the window and
intersected, the next rarest first, until one is empty. So a common term's list is only
probed for the few starts that rarer ones left, and a window with too many terms that
a shard lacks is not looked up there at all. An index is built once and serves any benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from coppice.llm.common import alnum_words, pick, ship, stored

WINDOW = 10
# Terms of a window that may be missing or differ in a proximity match.
SLACK = 2
# Bytes of benchmark windows that may go to the tasks at a time.
MAX_ITEM_BYTES = 16 * 1024 * 1024
# Words indexed together; a shard is a row of the index, and such rows are held in memory whole.
SHARD_WORDS = 200_000
# Shards that a task decodes at once.
GROUP_SHARDS = 8
# Word hashes a worker keeps.
MAX_KEPT = 50_000


class _Terms(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_terms = _Terms()


def term_hashes(words: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(_terms.__getitem__, words), np.uint64, len(words)).view(np.int64)


class Windows(NamedTuple):
    terms: dict[bytes, int]
    windows: list[tuple[int, ...]]  # distinct, as term numbers
    items: list[list[str]]  # of each window


def item_windows(items: Sequence[tuple[object, str | None]], size: int) -> Windows:
    """Distinct windows of ``size`` consecutive words; fewer words make one window, none none."""
    terms: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        for window in windows_of(text, size):
            owners.setdefault(tuple(terms.setdefault(word, len(terms)) for word in window), set()).add(str(item))
    return Windows(terms, list(owners), [sorted(names) for names in owners.values()])


def windows_of(text: str | None, size: int) -> Iterator[list[bytes]]:
    words = alnum_words(text)
    for i in range(max(len(words) - size, 0) + 1 if words else 0):
        yield words[i : i + size]


class Shard:
    """Postings of the terms of some windows in a run of documents that stand one after the
    other; a gap wider than any window keeps matches inside a document."""

    def __init__(self, starts: np.ndarray, sizes: np.ndarray, lists: Sequence[np.ndarray]):
        """``lists`` has the places of each term, in order."""
        self.starts, self.sizes = starts, sizes
        self.counts = np.array([len(places) for places in lists], np.int64)
        self.places = np.concatenate(lists).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.span = int(starts[-1] + sizes[-1]) + 1 if len(starts) else 1
        # All lists as one, in order of term and place.
        self.keys = np.repeat(np.arange(len(lists)), self.counts) * self.span + self.places

    def holds(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether the list of each term has the place."""
        wanted = terms * self.span + places
        at = np.searchsorted(self.keys, wanted)
        inside = (at < len(self.keys)) & (places >= 0) & (places < self.span)
        return inside & (self.keys[np.minimum(at, len(self.keys) - 1)] == wanted) if len(self.keys) else inside

    def starts_of(self, windows: np.ndarray, terms: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of a term of each window, shifted by the term's place in it: window, start."""
        n = self.counts[terms]
        index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[terms], n)
        return np.repeat(windows, n), self.places[index] - np.repeat(offsets, n)

    def document(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, starts, side="right") - 1


class Lookup:
    """Windows to look up in shards, with their terms as hashes."""

    def __init__(self, windows: Sequence[Sequence[int]], items: Sequence[Sequence[str]], slack: int | None):
        self.items, self.slack = items, slack
        self.lengths = np.array([len(window) for window in windows], np.int64)
        self.terms = np.unique(np.array([term for window in windows for term in window], np.int64))
        # Windows side by side; what a shorter one lacks comes last.
        self.table = np.full((len(windows), int(self.lengths.max(initial=1))), len(self.terms))
        for i, window in enumerate(windows):
            self.table[i, : len(window)] = np.searchsorted(self.terms, window)

    def phrases(self, shard: Shard, rows: np.ndarray, terms: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and start of every occurrence: the lists of a window's terms intersected, from the rarest."""
        window, start = shard.starts_of(rows, terms[rows, 0], offsets[rows, 0])
        for k in range(1, terms.shape[1]):
            if not len(window):
                break
            kept = (k >= self.lengths[window]) | shard.holds(terms[window, k], start + offsets[window, k])
            window, start = window[kept], start[kept]
        return window, start

    def near(self, shard: Shard, rows: np.ndarray, terms: np.ndarray, offsets: np.ndarray, slack: int) -> np.ndarray:
        """Starts where at most ``slack`` terms of a window differ, once for each. One of its ``slack + 1``
        rarest must be in its place, so their lists hold every start."""
        found = [shard.starts_of(rows, terms[rows, k], offsets[rows, k]) for k in range(slack + 1)]
        window, start = (np.concatenate(column) for column in zip(*found))
        width = terms.shape[1]
        window, start = np.divmod(np.unique(window * (shard.span + width) + start + width), shard.span + width)
        start -= width
        misses = np.zeros(len(window), np.int64)
        for k in range(width):
            misses += (k < self.lengths[window]) & ~shard.holds(terms[window, k], start + offsets[window, k])
            kept = misses <= slack
            window, start, misses = window[kept], start[kept], misses[kept]
        at = shard.document(start)
        inside = (at >= 0) & (start >= shard.starts[at]) & (start + self.lengths[window] <= shard.starts[at] + shard.sizes[at])
        return start[inside]

    def find(self, row: dict[str, np.ndarray]) -> Iterator[tuple]:
        """Per document of a shard: covered word ranges, items with an occurring window,
        number of proximity matches."""
        at = np.searchsorted(row["terms"], self.terms)
        bounds = row["bounds"]
        none = np.zeros(0, np.int64)
        lists = [
            row["places"][bounds[i] : bounds[i + 1]] if i < len(row["terms"]) and row["terms"][i] == term else none
            for i, term in zip(at.tolist(), self.terms.tolist())
        ]
        shard = Shard(row["starts"], row["sizes"], lists)
        n = len(shard.starts)
        ranges: list[list] = [[] for _ in range(n)]
        names: list[set] = [set() for _ in range(n)]
        near = np.zeros(n, np.int64)
        counts = np.append(shard.counts, np.iinfo(np.int64).max)[self.table]
        order = np.argsort(counts, axis=1, kind="stable")
        terms = np.take_along_axis(self.table, order, axis=1)
        absent = (counts == 0).sum(axis=1)
        sizes = np.take_along_axis(counts, order, axis=1)
        for rows in _blocks(np.flatnonzero(absent == 0), sizes[:, 0]):
            for w, start in zip(*self.phrases(shard, rows, terms, order)):
                d = int(shard.document(start))
                begin = int(start - shard.starts[d])
                ranges[d].append((begin, begin + int(self.lengths[w])))
                names[d].update(self.items[w])
                # A window no longer than the slack is near where it is exact.
                near[d] += self.slack is not None and self.lengths[w] <= self.slack
        if self.slack is not None:
            possible = np.flatnonzero((absent <= self.slack) & (self.lengths > self.slack))
            for rows in _blocks(possible, sizes[:, : self.slack + 1].sum(axis=1)):
                np.add.at(near, shard.document(self.near(shard, rows, terms, order, self.slack)), 1)
        for own, found, count in zip(ranges, names, near.tolist()):
            yield merge(own), sorted(found), count


def _blocks(rows: np.ndarray, sizes: np.ndarray, most: int = 500_000) -> Iterator[np.ndarray]:
    """Rows whose lists have about ``most`` places together."""
    if len(rows):
        cuts = np.flatnonzero(np.diff(np.cumsum(np.minimum(sizes[rows], most)) // most)) + 1
        yield from np.split(rows, cuts)


def merge(ranges: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(ranges):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def build_index(docs: DataFrame, gap: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The stored index of all words of all documents: a row per shard, with ``doc_ids``, each
    one's first place in the shard (``starts``) and words (``sizes``), ``terms`` (sorted hashes),
    and ``places``, the lists of the terms one after the other, cut at ``bounds``.

    A null text has no words, and its document no places; repeated rows are documents of
    their own; a document longer than a shard is one shard, alone or with those before it. ``gap`` is the longest
    window that can be looked up. Other columns are ignored. Words are compared as 64-bit hashes.
    """
    ship(docs.sparkSession)
    rows = pick(docs, "doc_id", "text")
    made = StructType.fromDDL("shard long").add("doc_ids", ArrayType(rows.schema["doc_id"].dataType))
    made = StructType([*made, *StructType.fromDDL("starts array<long>, sizes array<long>, terms array<long>, bounds array<long>, places array<int>")])

    def row(number: int, ids: list, sizes: list[int], codes: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array(sizes, np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths + gap)))[:-1]
        words = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        places = (np.arange(len(words), dtype=np.int64) + np.repeat(np.arange(len(lengths)) * gap, lengths)).astype(np.int32)
        order = np.argsort(words, kind="stable")
        words, places = words[order], places[order]
        bounds = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1]))) if len(words) else np.zeros(0, np.int64)
        arrow = to_arrow_schema(made)
        columns = [ids, starts, lengths, words[bounds], np.append(bounds, len(words)), places]
        arrays = [pa.array([number], pa.int64())]
        for column, field in zip(columns, list(arrow)[1:]):
            # One list, its values as they are.
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), pa.array(column, field.type.value_type)))
        return pa.RecordBatch.from_arrays(arrays, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, sizes, codes, total = TaskContext.get().partitionId() << 32, [], [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    words = alnum_words(text)
                    ids.append(doc_id)
                    sizes.append(len(words))
                    codes.append(term_hashes(words))
                    total += len(words) + gap
                    if total >= shard_words:
                        yield row(number, ids, sizes, codes)
                        number, ids, sizes, codes, total = number + 1, [], [], [], 0
        if ids:
            yield row(number, ids, sizes, codes)

    return stored(rows.mapInArrow(run, made), "index", GROUP_SHARDS)


def benchmark_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """A row per distinct window of all items: line (its words with blanks), items (of those that
    hold it, as text, sorted), n_bytes. An item of fewer words is one window, one without words none."""
    ship(benchmark.sparkSession)
    rows = pick(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("None")).alias("item"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                lines = [[b" ".join(w) for w in windows_of(text, size)] for text in part.column("text").to_pylist()]
                owners = pa.array(np.repeat(np.arange(len(lines)), [len(own) for own in lines]))
                found = pa.array([line.decode() for own in lines for line in own], pa.string())
                yield pa.RecordBatch.from_arrays([found, part.column("item").take(owners)], names=["line", "item"])

    found = rows.mapInArrow(run, "line string, item string")
    grouped = found.groupBy("line").agg(F.array_sort(F.collect_set("item")).alias("items"))
    n_bytes = F.length("line") + F.aggregate("items", F.lit(0), lambda total, item: total + F.length(item))
    return stored(grouped.withColumn("n_bytes", n_bytes), "windows")


def _look_up(index: DataFrame, windows: list, slack: int | None) -> DataFrame:
    """Per document of the index: shard, number (there), doc_id, n_words, and what the windows find."""
    lookup = Lookup([term_hashes(line.encode().split()).tolist() for line, _ in windows], [items for _, items in windows], slack)
    id_type = index.schema["doc_ids"].dataType.elementType
    found = StructType.fromDDL("n_words long, ranges array<struct<begin:long,end:long>>, items array<string>, n_near long")
    made = StructType([*StructType.fromDDL("shard long, number long"), StructField("doc_id", id_type), *found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(made)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                shard = {name: one.column(name).flatten().to_numpy(zero_copy_only=False) for name in ("starts", "sizes", "terms", "bounds", "places")}
                ids = one.column("doc_ids").flatten()
                ranges, items, near = zip(*lookup.find(shard))
                ranges = [[{"begin": begin, "end": end} for begin, end in row] for row in ranges]
                numbers = [np.full(len(ids), one.column("shard")[0].as_py()), np.arange(len(ids))]
                columns = [pa.array(v, arrow.field(k).type) for k, v in zip(("ranges", "items", "n_near"), (ranges, items, near))]
                arrays = [*map(pa.array, numbers), ids, pa.array(shard["sizes"]), *columns]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return index.mapInArrow(run, made)


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    slack: int | None = SLACK,
    max_bytes: int = MAX_ITEM_BYTES,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Per row: doc_id, n_words, ranges (begin and end of covered words), items (ids of
    those with an occurring window, as text), n_near (places where at most ``slack``
    words of some window differ, the exact ones included; 0 where ``slack`` is None).

    Documents are indexed once (:func:`build_index`); the distinct windows of all items go to the
    tasks in parts of about ``max_bytes``, each of which reads the stored index, and what
    the parts find is added up per document. A null text has no words; an item
    without words has no window; items that share a window all count; repeated rows each
    give a row; an empty benchmark finds nothing, and an empty table gives no rows; a very long text
    is whole in one shard; other columns are ignored.
    """
    index = build_index(docs, window, shard_words)
    windows = benchmark_windows(benchmark, window)
    total = windows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("total")).first()["total"]
    parts = max(1, -(-total // max_bytes))
    found = []
    for part in range(parts):
        own = windows.filter(F.pmod(F.xxhash64("line"), F.lit(parts)) == part)
        found.append(_look_up(index, [(row.line, row["items"]) for row in own.select("line", "items").toLocalIterator()], slack))
    if parts == 1:
        return found[0].drop("shard", "number")

    @F.pandas_udf("array<struct<begin:long,end:long>>")
    def joined(lists):
        return lists.map(lambda ranges: [{"begin": a, "end": b} for a, b in merge([(r["begin"], r["end"]) for r in ranges])])

    # Few documents have anything found, and a document has as many rows as there are parts at most.
    hits = stored(reduce(DataFrame.unionByName, [one.filter("n_near > 0 or size(ranges) > 0") for one in found]), "hits")
    added = hits.groupBy("shard", "number").agg(
        joined(F.flatten(F.collect_list("ranges"))).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.sum("n_near").alias("n_near"),
    )
    every = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "sizes")).alias("number", "d"))
    every = every.select("shard", F.col("number").cast("long").alias("number"), F.col("d.doc_ids").alias("doc_id"), F.col("d.sizes").alias("n_words"))
    none = {"ranges": "array<struct<begin:long,end:long>>", "items": "array<string>"}
    return every.join(added, ["shard", "number"], "left").select(
        "doc_id",
        "n_words",
        *[F.coalesce(name, F.array().cast(kind)).alias(name) for name, kind in none.items()],
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )


def contamination(found: DataFrame) -> DataFrame:
    """The digest of :func:`matches`: words hit, items, and whether any word is hit."""
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda total, r: total + r["end"] - r["begin"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("ranges") > 0).alias("contaminated"),
        "n_near",
    )
