"""Substring dedup by hashing runs of words: lines and sentences, and runs cut by content.

Two kinds of runs are hashed, as words in lower case with single blanks. From each line or
sentence on, the shortest run of whole ones that reaches a minimum of words. And of every
so many places in a row, the run of the minimum's words that begins with the word of the
smallest hash: which one that is follows from the words alone, so a passage of twice the minimum holds one
wherever it begins and ends. Digests are grouped over all documents; the earliest
occurrence by (doc_id, text, place) stays, all others go. Runs of a document that touch
make a passage, and it is widened word by word as far as the words beside it are those
beside the occurrence that stays.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from coppice.llm.common import pick, release, ship, sliced, stored
from coppice.llm.counters import TABLE_BITS, added, frequent_from, packed

# Words of the shortest passage that counts as repeated, and the most a passage is widened by on a side.
MIN_WORDS = 25
_END = re.compile(rb"[.!?] |\n")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
KEY = ["doc_id", "version"]
# Occurrences from which a run is sent to every task, and how many can be at most.
OFTEN, MAX_FREQUENT = 500, 50_000
# Words whose hashes a worker keeps.
MAX_KEPT = 50_000
# Fixed odd factor of the hash of a run.
_FACTOR = 0x9E3779B97F4A7C15


class _Hashes(dict):
    """The first 64 bits of a word's md5, of which the first 32 give its place in the order of hashes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_KEPT:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.md5(word).digest()[:8], "big")
        return value


_hashes = _Hashes()


def chosen_starts(hashes: np.ndarray, min_words: int) -> np.ndarray:
    """First words of the runs cut by content: of any ``min_words`` places in a row at which
    a whole run can begin, the first one of the smallest hash."""
    places = len(hashes) - min_words + 1
    if places < 1:
        return np.zeros(0, np.int64)
    ranks = hashes[:places] >> np.uint64(32)
    width = min(min_words, places)
    least = np.lib.stride_tricks.sliding_window_view(ranks, width).argmin(axis=1)
    return np.unique(least + np.arange(len(least)))


def runs(text: str, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of a text's words, and first word and end of each of its runs, in order."""
    data = text.encode().lower()
    words = data.split()
    hashes = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    if len(words) < min_words:
        return hashes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = _BLANK[np.frombuffer(data, np.uint8)]
    begins = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    # Words before the end of each line or sentence.
    ends = np.fromiter((match.end() for match in _END.finditer(data)), np.int64)
    upto = np.concatenate(([0], np.searchsorted(begins, ends), [len(words)]))
    upto = np.unique(upto)
    # The first line or sentence with which a run reaches the minimum.
    last = np.searchsorted(upto, upto + min_words)
    whole = last < len(upto)
    cut = chosen_starts(hashes, min_words)
    starts = np.concatenate([upto[whole], cut])
    stops = np.concatenate([upto[last[whole]], cut + min_words])
    both = np.unique((starts << 32) | stops)
    return hashes, both >> 32, both & 0xFFFFFFFF


def digests(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run, signed, from one pass of sums over all words."""
    n = len(hashes)
    powers, back = (np.full(n + 1, f, np.uint64) for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64)))
    powers[0] = back[0] = 1
    powers, back = np.multiply.accumulate(powers), np.multiply.accumulate(back)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(hashes) * powers[:n], dtype=np.uint64)))
    # Runs of other lengths differ too.
    return _mixed((sums[stops] - sums[starts]) * back[starts] + (stops - starts).astype(np.uint64)).view(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def occurrences(docs: DataFrame, min_words: int) -> tuple[DataFrame, np.ndarray]:
    """A row per run: doc_id, version (hash of the text), start, n_words, digest; narrow. And how
    many runs of the whole corpus each counter has."""
    ship(docs.sparkSession)
    rows = pick(docs, "doc_id", "text").filter("text is not null").withColumn("version", F.xxhash64("text"))
    made = StructType.fromDDL("version long, start int, n_words int, digest long, counts binary")
    schema = StructType([rows.schema["doc_id"], *made])

    def out(batch: pa.RecordBatch, parts: list[tuple]) -> pa.RecordBatch:
        at = pa.array(np.repeat([i for i, *_ in parts], [len(starts) for _, starts, *_ in parts]).astype(np.int64))
        columns = [np.concatenate(column) for column in list(zip(*parts))[1:]] or [np.zeros(0, np.int64)] * 3
        arrays = [pa.array(column, field.type) for column, field in zip(columns, list(to_arrow_schema(made))[1:])]
        none = pa.nulls(len(at), pa.binary())
        return pa.RecordBatch.from_arrays([*[batch.column(name).take(at) for name in KEY], *arrays, none], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << TABLE_BITS, np.int64)
        for batch in sliced(batches, 500):
            parts, n = [], 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                hashes, starts, stops = runs(text, min_words)
                if len(starts):
                    found = digests(hashes, starts, stops)
                    np.add.at(table, found.view(np.uint64) >> np.uint64(64 - TABLE_BITS), 1)
                    parts.append((i, starts.astype(np.int32), (stops - starts).astype(np.int32), found))
                    n += len(starts)
                if n >= 50_000:
                    yield out(batch, parts)
                    parts, n = [], 0
            yield out(batch, parts)
        if table.any():
            arrays = [pa.nulls(1, field.type) for field in to_arrow_schema(schema)]
            yield pa.RecordBatch.from_arrays([*arrays[:-1], pa.array([packed(table)], pa.binary())], schema=to_arrow_schema(schema))

    found = stored(rows.mapInArrow(run, schema), "runs")
    return found.filter("counts is null").drop("counts"), added(found.filter("counts is not null").select("counts"))


# A repeated run or passage goes from word ``start`` to before ``-right.stop``. ``left`` is the
# place that stays, beside which the words before the passage may be the same; ``closed`` where a passage
# begins right behind the occurrence that stays. ``right`` is the same for its end. So of
# spans that begin, or end, together the smallest struct decides.
_PLACE = "none boolean, doc_id {id}, version long, at int"
SPAN = f"struct<start int, closed boolean, left struct<{_PLACE}>, right struct<stop int, {_PLACE}>>"
# The same with the places in the text, in code points.
PASSAGE = f"struct<start int, closed boolean, left struct<{_PLACE}>, right struct<stop int, {_PLACE}, end int>, begin int>"


def _later(rows: DataFrame) -> DataFrame:
    """Of occurrences with ``first`` those that go: doc_id, version, span."""
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("version") == F.col("first.version"))
    stop = F.col("first.start") + F.col("n_words")
    end = F.col("start") + F.col("n_words")
    closed = same & (F.col("start") < stop)
    place = lambda at: [F.col("first.none"), F.col("first.doc_id"), F.col("first.version"), at.cast("int").alias("at")]
    span = F.struct(
        F.when(closed, stop).otherwise(F.col("start")).cast("int").alias("start"),
        closed.alias("closed"),
        F.struct(*place(F.col("first.start"))).alias("left"),
        F.struct((-end).cast("int").alias("stop"), *place(stop)).alias("right"),
    )
    return rows.filter(~(same & (F.col("start") == F.col("first.start")))).select(*KEY, span.alias("span"))


def _frequent_spans(rows: DataFrame, frequent: dict[int, tuple], id_type: str) -> DataFrame:
    """Later occurrences of the most frequent runs, those of a document that touch as one
    span. They are looked up in each task, so no key of the join is hot."""
    made = StructType([rows.schema["doc_id"], rows.schema["version"], *StructType.fromDDL(f"span {SPAN.format(id=id_type)}")])
    digests = pa.array(list(frequent), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(made)
        for batch in batches:
            hits = batch.filter(pc.is_in(batch.column("digest"), digests))
            out: list[tuple] = []
            for doc_id, version, start, n, digest in zip(*[column.to_pylist() for column in hits.columns]):
                kept_id, kept_version, kept = frequent[digest]
                same = (doc_id, version) == (kept_id, kept_version)
                if same and start == kept:
                    continue
                closed = same and start < kept + n
                left, right = (
                    {"none": kept_id is None, "doc_id": kept_id, "version": kept_version, "at": at} for at in (kept, kept + n)
                )
                span = {"start": kept + n if closed else start, "closed": closed, "left": left, "right": {"stop": -start - n, **right}}
                if out and out[-1][:2] == (doc_id, version) and _touch(out[-1][2], span):
                    out[-1] = (doc_id, version, _joined(out[-1][2], span))
                else:
                    out.append((doc_id, version, span))
            columns = list(zip(*out)) if out else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, arrow)], schema=arrow)

    return rows.select(*KEY, "start", "n_words", "digest").mapInArrow(run, made)


def _rank(place: dict) -> tuple:
    return (place["none"], *([] if place["none"] else [place["doc_id"]]), place["version"], place["at"])


def _left_rank(span: dict) -> tuple:
    return (span["start"], span["closed"], _rank(span["left"]))


def _touch(one: dict, other: dict) -> bool:
    return other["start"] <= -one["right"]["stop"] and one["start"] <= -other["right"]["stop"]


def _joined(one: dict, other: dict) -> dict:
    """Two spans as one: the left side of the one that begins first, the right side of the
    one that ends last; of equals those of the earliest place that stays."""
    right = min(one["right"], other["right"], key=lambda right: (right["stop"], _rank(right)))
    return {**min(one, other, key=_left_rank), "right": right}


def _merged(spans: Column, kind: str, fields: Sequence[str]) -> Column:
    """Of a list of spans those that overlap or touch as one, in order."""

    def absorb(done: Column, span: Column) -> Column:
        top = F.try_element_at(done, F.lit(-1))
        grown = F.struct(*[(F.least(top[f], span[f]) if f == "right" else top[f]).alias(f) for f in fields])
        touches = (F.size(done) > 0) & (span["start"] <= -top["right"]["stop"])
        before = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(touches, F.concat(before, F.array(grown))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.array().cast(f"array<{kind}>"), absorb)


def _spans(docs: DataFrame, min_words: int, often: int) -> DataFrame:
    """Per document with something to remove: doc_id, version, its ``spans`` before they are widened."""
    rows, counts = occurrences(docs, min_words)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    often = max(often, -(-int(counts.sum()) // MAX_FREQUENT))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version", "start")
    # A run that is frequent has a full counter; few others have.
    slots = [(int(slot),) for slot in np.flatnonzero(counts > frequent_from(counts, often) - counts.mean())]
    full = F.broadcast(docs.sparkSession.createDataFrame(slots, "slot long"))
    slot = F.shiftrightunsigned("digest", 64 - TABLE_BITS)
    firsts = rows.join(full, slot == F.col("slot"), "left_semi").groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
    found = firsts.filter(F.col("n") >= often).collect()
    frequent = {row.digest: (row.first.doc_id, row.first.version, row.first.start) for row in found}
    known = F.broadcast(docs.sparkSession.createDataFrame([(digest,) for digest in frequent], "digest long"))
    # The others have under ``often`` places each.
    alike = Window.partitionBy("digest")
    met = rows.join(known, "digest", "left_anti").select(
        "*", F.min(rank).over(alike).alias("first"), F.count("*").over(alike).alias("n")
    )
    later = _later(met.filter("n > 1"))
    if frequent:
        later = later.unionByName(_frequent_spans(rows, frequent, id_type))
    # All runs of one document, as many as its words at most.
    spans = later.groupBy(*KEY).agg(F.collect_set("span").alias("spans"))
    merged = _merged(F.col("spans"), SPAN.format(id=id_type), ("start", "closed", "left", "right"))
    return stored(spans.select(*KEY, merged.alias("spans")), "spans")


def passages(docs: DataFrame, min_words: int, often: int) -> DataFrame:
    """Per document with something to remove: doc_id, version and its ``spans``, widened, with
    ``begin`` and ``right.end`` in code points.

    The words beside a span and those beside the places that stay are looked up in their
    texts in one go, as hashes, and then compared; texts move at most once.
    """
    spans = _spans(docs, min_words, often)
    release(docs.sparkSession)
    each = spans.select(*KEY, F.posexplode("spans").alias("i", "span"))
    own = {-1: F.col("span.start"), 1: -F.col("span.right.stop")}
    kept = {-1: "span.left", 1: "span.right"}
    asked = [each.select(*KEY, own[side].alias("at"), F.lit(side).alias("side")) for side in (-1, 1)]
    asked += [each.select(*[F.col(f"{kept[side]}.{name}") for name in (*KEY, "at")], F.lit(side).alias("side")) for side in (-1, 1)]
    near = _neighbours(docs, reduce(DataFrame.union, asked), min_words)
    for side, name in ((-1, "left"), (1, "right")):
        half = near.filter(F.col("side") == side).drop("side")
        mine = half.toDF("_doc_id", "_version", "_at", f"{name}_own", f"{name}_places")
        theirs = half.drop("places").toDF("_doc_id", "_version", "_at", f"{name}_kept")
        at = {"doc_id": F.col("doc_id"), "version": F.col("version"), "at": own[side]}
        there = {c: F.col(f"{kept[side]}.{c}") for c in (*KEY, "at")}
        for other, place in ((mine, at), (theirs, there)):
            same = place["doc_id"].eqNullSafe(F.col("_doc_id")) & (place["version"] == F.col("_version")) & (place["at"] == F.col("_at"))
            each = each.join(other, same).drop("_doc_id", "_version", "_at")

    def matching(name: str) -> Column:
        """Length of the run of equal words two lists begin with."""
        pairs = F.arrays_zip(F.col(f"{name}_own").alias("a"), F.col(f"{name}_kept").alias("b"))
        end = F.array_position(F.transform(pairs, lambda pair: F.coalesce(pair["a"] == pair["b"], F.lit(False))), False)
        return F.when(end == 0, F.size(f"{name}_own")).otherwise(end - 1).cast("int")

    more = each.withColumn("before", F.when(F.col("span.closed"), 0).otherwise(matching("left"))).withColumn("behind", matching("right"))
    left = [F.col(f"span.left.{name}") for name in ("none", *KEY)]
    right = [F.col(f"span.right.{name}") for name in ("none", *KEY, "at")]
    span = F.struct(
        (F.col("span.start") - F.col("before")).alias("start"),
        F.col("span.closed").alias("closed"),
        F.struct(*left, (F.col("span.left.at") - F.col("before")).alias("at")).alias("left"),
        F.struct(
            (F.col("span.right.stop") - F.col("behind")).alias("stop"), *right, F.get("right_places", F.col("behind")).alias("end")
        ).alias("right"),
        F.get("left_places", F.col("before")).alias("begin"),
    )
    grown = more.select(*KEY, span.alias("span")).groupBy(*KEY).agg(F.collect_list("span").alias("spans"))
    id_type = spans.schema["doc_id"].dataType.simpleString()
    merged = _merged(F.col("spans"), PASSAGE.format(id=id_type), ("start", "closed", "left", "right", "begin"))
    return grown.select(*KEY, merged.alias("spans"))


def word_hash(word: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(word)).astype(np.int64))


def _neighbours(docs: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """doc_id, version, at, side, ``words``: the hashes of up to ``most`` words before (side -1) or
    from (1) word ``at``, nearest first, and ``places``: where in the text word ``at`` begins and
    each further one on that side; behind the last word that is the text's end."""
    asked = asked.distinct().groupBy(*KEY).agg(F.collect_list(F.struct("at", "side")).alias("asked")).toDF("_id", "_version", "asked")
    rows = pick(docs, "doc_id", "text").filter("text is not null").withColumn("version", F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version"))
    met = rows.join(asked, same).select(*KEY, "text", "asked")
    types = "version long, at int, side int, words array<long>, places array<int>"
    made = StructType([rows.schema["doc_id"], *StructType.fromDDL(types)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(made)
        for batch in sliced(batches, 200):
            out = []
            for doc_id, version, text, wanted in zip(*[column.to_pylist() for column in batch.columns]):
                words = text.encode().lower().split()
                begins = [match.start() for match in _WORD.finditer(text)] + [len(text)]
                for place in wanted:
                    at, side = place["at"], place["side"]
                    if side < 0:
                        near, places = words[max(at - most, 0) : at][::-1], begins[max(at - most, 0) : at + 1][::-1]
                    else:
                        near, places = words[at : at + most], begins[at : at + most + 1]
                    out.append((doc_id, version, at, side, [word_hash(word) for word in near], places))
            columns = list(zip(*out)) if out else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, arrow)], schema=arrow)

    # Rows that agree are one document.
    return stored(met.mapInArrow(run, made).dropDuplicates(["doc_id", "version", "at", "side"]), "beside")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, often: int = OFTEN) -> DataFrame:
    """A row per passage to remove: doc_id, version, begin, end (code points, up to the next
    word), kept_doc_id, kept_word (the document that keeps what the passage begins with,
    and the number of the word it begins with there).

    Every passage of twice ``min_words`` less one words that an earlier document holds is found, and of
    ``min_words`` where it has whole lines or sentences. Runs are compared as 64-bit
    hashes. What occurs again in a document while its first
    occurrence goes on is cut from that one's end. Rows that agree in doc_id and text are
    one document. A null doc_id ranks after all others; a null, empty or short text has no
    passages; a very long one is read whole by one task; ties go to the smaller text hash; an empty table gives
    no rows; other columns are ignored. Runs that occur ``often`` or more, or make up more than a
    :data:`MAX_FREQUENT`-th of all where that is more, have their first occurrence from an
    aggregate that is combined in each task before its shuffle, and are sent to every task; so
    a passage of a third of all documents is no hot group. All others meet by digest, once.
    """
    found = passages(docs, min_words, often).select(*KEY, F.explode("spans").alias("span"))
    return found.select(
        *KEY,
        F.col("span.begin").alias("begin"),
        F.col("span.right.end").alias("end"),
        F.col("span.left.doc_id").alias("kept_doc_id"),
        F.col("span.left.at").alias("kept_word"),
    )


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut out of ``text``, and ``removed``:
    the cut spans as begin and end in the original text, an empty list where none is. A
    column of that name is replaced; all others stay as they are. What counts as repeated,
    and odd rows, are as in :func:`repeats`; a null text stays null."""
    cuts = F.transform("spans", lambda s: F.struct(s["begin"].alias("begin"), s["right"]["end"].alias("end")))
    asked = passages(docs, min_words, OFTEN).select(*KEY, cuts.alias("cuts")).toDF("_id", "_version", "_cuts")
    names = docs.columns
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    text = F.col(f"_{names.index('text')}")
    same = F.col(f"_{names.index('doc_id')}").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_version"))
    joined = plain.join(asked, same, "left")
    # What lies before the first cut, between two, and behind the last.
    starts = F.concat(F.array(F.lit(0)), F.col("_cuts.end"))
    stops = F.concat(F.col("_cuts.begin"), F.array(F.length(text)))
    parts = F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda p: F.substring(text, p["a"] + 1, p["b"] - p["a"]))
    left = F.when(F.col("_cuts").isNull(), text).otherwise(F.array_join(parts, ""))
    columns = {i: F.col(f"_{i}") for i in range(len(names)) if names[i] != "removed"} | {names.index("text"): left}
    kept = [column.alias(names[i]) for i, column in sorted(columns.items())]
    none = F.expr("cast(array() as array<struct<begin:int,end:int>>)")
    return joined.select(*kept, F.coalesce("_cuts", none).alias("removed"))
