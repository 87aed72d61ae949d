"""Document fingerprints by randomised edit embedding.

All texts take the same random walk: at each step a bit that follows from the step and
the character read says whether to go on to the next character. Written down step by
step, the characters read are a string in which texts at small edit distance differ in
few places (Hamming distance), because two walks apart by an edit soon meet again. The
fingerprint keeps samples of that string: hashes of short runs at shared random steps,
one in each of up to 128 equal stretches. Samples of a coarser grid are some of those of
a finer one, so texts of unlike length can be compared.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from coppice.llm.common import map_texts, pick, ship, stored

SAMPLES = 128
# Steps of the embedding that a sample covers.
RUN = 8
# The walk's bits repeat after so many steps, and there are so many classes of characters.
PERIOD, CLASSES = 4096, 64
# Samples that must agree for two texts to meet.
BAND = 3


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of integers."""
    x = np.asarray(x, np.uint64).copy()
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x


@functools.cache
def _dwell() -> list[int]:
    """Steps spent on a character, by its class and the step on which it is reached."""
    bits = _mixed(np.arange(PERIOD * CLASSES) + 1).reshape(CLASSES, PERIOD) >> np.uint64(63) == 1
    out = np.zeros((CLASSES, PERIOD), np.int64)
    wait = np.zeros(CLASSES, np.int64)
    for step in range(2 * PERIOD - 1, -1, -1):
        wait = np.where(bits[:, step % PERIOD], 1, wait + 1)
        out[:, step % PERIOD] = wait
    return out.ravel().tolist()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def walk(codes: np.ndarray, step: int = 0) -> list[int]:
    """The step on which each character is reached, and the one on which the walk ends."""
    dwell, mask = _dwell(), PERIOD - 1
    bases = ((codes * np.uint32(2654435761) >> np.uint32(20)) % CLASSES * PERIOD).tolist()
    out = [step]
    for base in bases:
        step += dwell[base + (step & mask)]
        out.append(step)
    return out


def level_of(n_chars: int) -> int:
    """Grid on which three steps per character make up to :data:`SAMPLES` stretches."""
    return max(0, (-(-3 * n_chars // SAMPLES) - 1).bit_length()) if n_chars else 0


def _child(level: int, k: np.ndarray) -> np.ndarray:
    """The sample of the next finer grid that sample ``k`` of this one is."""
    return 2 * k + (_mixed(k.astype(np.uint64) * np.uint64(64) + np.uint64(level)) >> np.uint64(63)).astype(np.int64)


@functools.cache
def sample_steps(level: int) -> np.ndarray:
    k = np.arange(SAMPLES)
    for grid in range(level, 0, -1):
        k = _child(grid, k)
    return k


_RUN_FACTORS = _mixed(np.arange(RUN) + 1000) | np.uint64(1)


def samples(codes: np.ndarray, steps: list[int]) -> tuple[int, np.ndarray]:
    """Grid and samples (1 to 255; 0 past the end of the walk) of a walked text."""
    level = level_of(len(codes))
    at = sample_steps(level)
    embedded = np.repeat(codes, np.diff(steps)).astype(np.uint64)
    end = len(embedded)
    inside = at < end
    embedded = np.concatenate([embedded, np.zeros(RUN, np.uint64)])
    runs = (embedded[at[inside, None] + np.arange(RUN)] * _RUN_FACTORS).sum(1, dtype=np.uint64)
    out = np.zeros(SAMPLES, np.uint8)
    out[inside] = _mixed(runs) % np.uint64(255) + np.uint64(1)
    return level, out


def to_text(level: int, values: np.ndarray) -> str:
    return f"{level:02x}{values.tobytes().hex()}"


def fingerprint(text: str | None) -> str:
    codes = _codes(text or "")
    return to_text(*samples(codes, walk(codes)))


def _parsed(text: str) -> tuple[int, np.ndarray]:
    return int(text[:2], 16), np.frombuffer(bytes.fromhex(text[2:]), np.uint8)


def coarser(level: int, values: np.ndarray, to: int) -> np.ndarray:
    """The samples of a coarser grid, which are some of these."""
    for grid in range(level + 1, to + 1):
        k = _child(grid, np.arange(SAMPLES))
        values = np.where(k < SAMPLES, values[np.minimum(k, SAMPLES - 1)], 0)
    return values


def likeness(one: tuple[int, np.ndarray], other: tuple[int, np.ndarray]) -> float:
    """Share of the samples, on the coarser grid of the two, that agree; 1 for two empty texts."""
    level = max(one[0], other[0])
    a, b = coarser(*one, level), coarser(*other, level)
    some = (a != 0) | (b != 0)
    return float(((a == b) & some).sum() / some.sum()) if some.any() else 1.0


class _Walked:
    """A text with its walk, kept until the next document is known."""

    def __init__(self, doc_id: int | None, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.codes = _codes(self.text)
        self.steps = walk(self.codes)
        self.samples = samples(self.codes, self.steps)

    def row(self, following: _Walked) -> tuple:
        """The result for this text when ``following`` comes next. The walk over what an
        edit leaves in place is the same, so only the new end is walked."""
        n = len(self.text)
        keep = n - n // 4
        end = following.text[: n // 4]
        codes = np.concatenate([self.codes[:keep], _codes(end)])
        steps = [*self.steps[:keep], *walk(codes[keep:], self.steps[keep])]
        edited = samples(codes, steps)
        digest = sha256((self.text[:keep] + end).encode()).hexdigest()
        near = likeness(self.samples, edited), likeness(self.samples, following.samples)
        return (self.doc_id, n, digest, to_text(*self.samples), to_text(*edited), *near)


_ROW = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)
_SIZE = 500


def with_next(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text has its last quarter of characters replaced by the first as many of
    the next document's; the next is that of the next doc_id (null first, equal ids by
    text), after the last the first. A null text counts as empty; the only row is its
    own next; an empty table gives no rows; a very long text is walked whole by one task;
    other columns are ignored.

    The texts are dealt into ranges of doc_id and sorted there, the one shuffle. Each
    task goes through its range as a stream. Only the first and the last text of each
    range are written, and matched with their neighbours afterwards.
    """
    ship(docs.sparkSession)
    rows = pick(docs, "doc_id", "text")
    id_field = rows.schema["doc_id"]
    made = StructType([id_field, *StructType.fromDDL(f"{_ROW}, place int, edge string, edge_text string")])
    text = F.coalesce("text", F.lit(""))
    ranged = rows.select("doc_id", text.alias("text"), F.lit(0).alias("place"))
    ranged = ranged.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ranged = ranged.withColumn("place", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(made)
        out: list[tuple] = []
        before = None
        place = 0
        for batch in batches:
            ids, texts, places = (batch.column(name).to_pylist() for name in ("doc_id", "text", "place"))
            for doc_id, text, place in zip(ids, texts, places):
                now = _Walked(doc_id, text)
                if before is None:
                    out.append((doc_id, *[None] * 6, place, "first", text))
                else:
                    out.append((*before.row(now), place, None, None))
                before = now
                if len(out) >= _SIZE:
                    yield _as_batch(out, arrow)
                    out = []
        if before is not None:
            out.append((before.doc_id, *[None] * 6, place, "last", before.text))
        yield _as_batch(out, arrow)

    walked = stored(ranged.mapInArrow(run, made), "fingerprints")
    names = [name for name in made.fieldNames() if name not in ("place", "edge", "edge_text")]
    return walked.filter("edge is null").select(names).unionByName(_across(walked).select(names))


def _as_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, arrow)], schema=arrow)


def _across(walked: DataFrame) -> DataFrame:
    """Results for the last text of each range, from the first one of the range after it.
    One row per range takes part."""
    edges = walked.filter("edge is not null").groupBy("place").agg(
        F.max(F.when(F.col("edge") == "first", F.col("edge_text"))).alias("first_text"),
        F.max(F.when(F.col("edge") == "last", F.struct("doc_id", "edge_text"))).alias("last"),
    )
    order = Window.orderBy("place")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead("first_text").over(order), F.first("first_text").over(whole))
    pairs = edges.select(F.col("last.doc_id").alias("doc_id"), F.col("last.edge_text").alias("text"), following.alias("next_text"))
    made = StructType([walked.schema["doc_id"], *StructType.fromDDL(_ROW)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(made)
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("doc_id", "text", "next_text")]
            yield _as_batch([_Walked(i, text).row(_Walked(None, after)) for i, text, after in zip(*columns)], arrow)

    return pairs.mapInArrow(run, made)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id and the fingerprint of its whole text; narrow. A null text counts as empty."""
    return map_texts(docs, lambda: lambda texts: [(fingerprint(text),) for text in texts], "fingerprint string")


def _bands(text: str) -> list[str]:
    """Runs of agreeing samples by which texts meet, on this grid and the next coarser one."""
    level, values = _parsed(text)
    out = []
    for grid in (level, level + 1):
        found = coarser(level, values, grid)
        for at in range(0, SAMPLES - BAND + 1, BAND):
            band = found[at : at + BAND]
            if band.all() or (at == 0 and band.any()):
                out.append(f"{grid}:{at}:{band.tobytes().hex()}")
    return out


def similar(queries: DataFrame, prints: DataFrame, least: float = 0.5) -> DataFrame:
    """Per pair: query_id, doc_id, likeness, for a set of queries (query_id, fingerprint)
    against all fingerprints (doc_id, fingerprint).

    Texts meet if a band of samples agrees, and all their samples are then compared.
    Equal fingerprints are compared once, and rows that share one all come back. Empty texts,
    and null fingerprints, meet nothing; an empty table on either side gives no rows.
    """
    ship(prints.sparkSession)

    @F.pandas_udf("array<string>")
    def bands(texts):
        return texts.map(_bands)

    @F.pandas_udf("double")
    def near(a, b):
        import pandas as pd

        return pd.Series([likeness(_parsed(x), _parsed(y)) for x, y in zip(a, b)], dtype=float)

    prints = prints.filter("fingerprint is not null")
    queries = queries.filter("fingerprint is not null")
    known = prints.select(F.col("fingerprint").alias("other")).distinct().withColumn("band", F.explode(bands("other")))
    asked = queries.select("fingerprint").distinct().withColumn("band", F.explode(bands("fingerprint")))
    met = asked.join(known, "band").select("fingerprint", "other").distinct().withColumn("likeness", near("fingerprint", "other"))
    return (
        met.filter(F.col("likeness") >= least)
        .join(queries, "fingerprint")
        .join(prints.withColumnRenamed("fingerprint", "other"), "other")
        .select("query_id", "doc_id", "likeness")
    )
