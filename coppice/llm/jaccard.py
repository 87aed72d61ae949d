"""N-gram Jaccard join: documents whose sets of word n-grams overlap enough, all of them.

1. Every n-gram of the corpus meets its holders by hash, in packed lists, and so its exact
   number of holders is known; equal sets are one holder. Rare ones first, that gives an order of all
   n-grams. Those of very many rows, by a table of counters of fixed size, are ordered
   last, by that table, and are not gathered.
2. Two sets that overlap enough share one of the first n-grams, in that order, of each
   (the prefix: what may be missing, and one more). Sets that share one form a tile;
   a set with enough n-grams of its own is in none, and a passage many documents share makes no
   tile unless they hold little else.
3. In a tile, cut by size, sets meet as hashed bitmaps: bits that one has and the other
   lacks bound the overlap from above. A tile too large for a task is cut in blocks, and
   blocks meet in pairs.
4. What the bound leaves is decided by intersecting the sorted n-gram arrays. First each
   class with its likeliest partner only, and some times more with that of another component,
   which links most of a group without all its pairs; then, inside the block, pairs that are still in different components, and a
   block returns the links that join components, fewer than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from coppice.llm.common import blank_words, numbered, pick, release, ship, sliced, stored
from coppice.llm.components import connected, joined
from coppice.llm.counters import TABLE_BITS, added, frequent_from, packed

WORDS, PERCENT = 5, 75
# N-grams in one packed list and, on average, in one group of hashes; documents in one list.
LIST_GRAMS, GROUP_GRAMS, LIST_DOCS = 2_000_000, 1_000_000, 60_000
MAX_GROUPS = 1 << 16
# Bits of a signature per n-gram, at least.
DENSITY = 4
# Members of a tile, and n-grams of them, that meet in one task; a larger tile is cut in blocks.
TILE, BLOCK_GRAMS = 1024, 1_000_000
# N-grams whose counter is so far above the mean are ordered last and make tiles undealt.
HOT = 1_000_000
# Links checked beside one center in a task.
STAR = 2048
# Rounds, at most, in which each class is checked with its likeliest partner of another component, and
# the n-grams of members still involved, as a share of the corpus's, with which no further one is needed.
ROUNDS, FEW = 3, 0.25
# A round that leaves more than this share of those n-grams has brought too little for another.
LEFT = 0.75
# Places of involved classes that may be sent to every task, at 40 bytes or so each.
MAX_SENT = 200_000
# Classes, tiles or pairs that a task remembers, so as not to pass them on twice.
MAX_SEEN = 200_000


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        x = x ^ (x >> np.uint64(shift))
        x = x * np.uint64(factor)
    return x


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams; of all its words if they
    are fewer, of nothing if there are none."""
    return shingles_of([text], words)[0]


def shingles_of(texts: Sequence[str | None], words: int = WORDS) -> list[np.ndarray]:
    """:func:`shingles` of each text; a word is hashed once for all of them."""
    kinds, lines = numbered(map(blank_words, texts))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, kinds), np.uint64, len(kinds))
    return [_grams(hashes[line], words) for line in lines]


def _grams(codes: np.ndarray, words: int) -> np.ndarray:
    if len(codes) < words:
        # A shorter sequence is one n-gram, and differs from any of another length.
        factors = _mixed(np.arange(len(codes), dtype=np.uint64) + np.uint64(1000 * len(codes)))
        return _mixed((codes * factors).sum(keepdims=True, dtype=np.uint64)) if len(codes) else codes
    factors = _mixed(np.arange(words, dtype=np.uint64) + np.uint64(1)) | np.uint64(1)
    n = len(codes) - words + 1
    total = np.zeros(n, np.uint64)
    for i in range(words):
        total += codes[i : i + n] * factors[i]
    return _distinct(np.sort(_mixed(total)))


def _distinct(values: np.ndarray) -> np.ndarray:
    """Each of sorted values once."""
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def class_of(grams: np.ndarray) -> int:
    """One number for equal sets, signed."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).astype(np.int64))


def prefix_size(n: int, percent: int) -> int:
    """N-grams of a set of ``n`` of which a similar set must hold one."""
    return n - -(-percent * n // 100) + 1


def signature(grams: np.ndarray) -> bytes:
    """Bitmap of a power of two of bits, :data:`DENSITY` per n-gram or more."""
    bits = max(64, 1 << (DENSITY * len(grams) - 1).bit_length())
    marks = np.zeros(bits, np.uint8)
    marks[(grams & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


def folded(bitmap: np.ndarray, n_bytes: int) -> np.ndarray:
    """The bitmap the same n-grams have at a smaller width."""
    return np.bitwise_or.reduce(bitmap.reshape(-1, n_bytes), axis=0)


def similar(common: int | np.ndarray, n_a, n_b, percent: int):
    return 100 * common >= percent * (n_a + n_b - common)


def _sets(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """Per row: doc_id, version (hash of the text), n, class and, on the first row of a class in
    each task, its signature. And how often each counter's n-grams occur in the whole corpus."""
    size = 1 << TABLE_BITS
    rows = pick(docs, "doc_id", "text").withColumn("version", F.xxhash64("text"))
    id_field = rows.schema["doc_id"]
    made = StructType([id_field, *StructType.fromDDL("version long, n long, class long, bitmap binary, counts binary")])

    def one(grams: np.ndarray, seen: set[int]) -> tuple:
        if not len(grams):
            return 0, None, None, None
        key = class_of(grams)
        if key in seen:
            return len(grams), key, None, None
        if len(seen) < MAX_SEEN:
            seen.add(key)
        return len(grams), key, signature(grams), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(made)
        table, seen = np.zeros(size, np.int64), set()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = shingles_of(part.column("text").to_pylist(), words)
                slots = (np.concatenate(found) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                table += np.bincount(slots, minlength=size)
                columns = list(zip(*[one(grams, seen) for grams in found]))
                arrays = [pa.array(values, field.type) for values, field in zip(columns, list(arrow)[2:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("version"), *arrays], schema=arrow)
        if table.any():
            last = [pa.nulls(1, field.type) for field in arrow]
            last[-1] = pa.array([packed(table)], pa.binary())
            yield pa.RecordBatch.from_arrays(last, schema=arrow)

    found = stored(rows.mapInArrow(run, made), "sets")
    tables = found.filter("counts is not null").select("counts")
    return found.filter("counts is null").drop("counts"), added(tables)


def keys_of(grams: np.ndarray, groups: int) -> np.ndarray:
    """Sorted distinct keys of sorted n-grams: the group of their hash, and 32 bits of its place there."""
    high, low = grams >> np.uint64(32), grams & np.uint64(0xFFFFFFFF)
    # The hash times the groups, less 32 bits; so it is in the hashes' order.
    return _distinct(high * np.uint64(groups) + ((low * np.uint64(groups)) >> np.uint64(32)))


def slots_of(keys: np.ndarray, groups: int) -> np.ndarray:
    """The counter of the first hash that has each key."""
    whole, rest = np.divmod(keys, np.uint64(groups))
    first = (whole << np.uint64(32)) + (rest << np.uint64(32)) // np.uint64(groups)
    return (first >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class _Chunk:
    """Classes of a task and their keys, until there are enough to pack."""

    def __init__(self, groups: int, orders: np.ndarray):
        self.groups, self.orders = groups, orders
        self.clear()

    def clear(self) -> None:
        self.holders, self.keys, self.late, self.n = [], [], [], 0

    def add(self, grams: np.ndarray, percent: int) -> None:
        keys = keys_of(grams, self.groups)
        order = self.orders[slots_of(keys, self.groups)]
        late = order > 0
        # So many of the first keys there are in the prefix, less all keys.
        self.holders.append((class_of(grams), len(grams), prefix_size(len(grams), percent) - len(keys)))
        if late.any():
            number = np.full(int(late.sum()), len(self.holders) - 1, np.int64)
            self.late.append(np.stack([number, keys[late].astype(np.int64), order[late]]))
            keys = keys[~late]
        self.keys.append(keys)
        self.n += len(keys)

    def full(self) -> bool:
        return self.n >= LIST_GRAMS or len(self.holders) >= LIST_DOCS

    def lists(self, chunk: int) -> Iterator[tuple[int, bytes]]:
        """A list of keys and holders' numbers for each group, and the holders, for any."""
        if not self.holders:
            return
        keys = np.concatenate(self.keys)
        number = np.repeat(np.arange(len(self.keys)), [len(k) for k in self.keys]).astype(np.uint16)
        order = np.argsort(keys, kind="stable")
        keys, number = keys[order], number[order]
        edges = np.searchsorted(keys, np.arange(self.groups + 1, dtype=np.uint64) << np.uint64(32))
        places = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for group in np.flatnonzero(np.diff(edges)).tolist():
            a, b = edges[group], edges[group + 1]
            yield group, b"K" + np.int64(chunk).tobytes() + places[a:b].tobytes() + number[a:b].tobytes()
        late = np.concatenate(self.late, axis=1) if self.late else np.zeros((3, 0), np.int64)
        holders = np.array(self.holders, np.int64).T
        sizes = np.array([chunk, holders.shape[1], late.shape[1]], np.int64)
        yield chunk % self.groups, b"H" + sizes.tobytes() + holders.tobytes() + late.tobytes()
        self.clear()


def _lists(docs: DataFrame, counts: np.ndarray, words: int, percent: int, hot: int, groups: int) -> DataFrame:
    """Packed lists of n-grams with their holders, by group of hashes: group, data; narrow.

    A class comes once per task, as long as the memory for that lasts. Frequent n-grams
    go with the holders, in the order of their counters.
    """
    rows = pick(docs, "text")
    orders = np.where(counts > frequent_from(counts, hot), counts, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        first = TaskContext.get().partitionId() << 32
        chunk = _Chunk(groups, orders)
        number = 0
        for part in sliced(batches, 500):
            for grams in shingles_of(part.column("text").to_pylist(), words):
                key = class_of(grams)
                if not len(grams) or key in seen:
                    continue
                if len(seen) < MAX_SEEN:
                    seen.add(key)
                chunk.add(grams, percent)
                if chunk.full():
                    yield from _data(chunk.lists(first + number), "group", pa.int32())
                    number += 1
        yield from _data(chunk.lists(first + number), "group", pa.int32())

    return rows.mapInArrow(run, "group int, data binary")


def _data(lists: Iterator[tuple[int, bytes]], name: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows of a number and bytes, some megabytes at a time."""
    numbers, data, size = [], [], 0
    for number, one in lists:
        numbers.append(number)
        data.append(one)
        size += len(one)
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(numbers, kind), pa.array(data, pa.binary())], names=[name, "data"])
            numbers, data, size = [], [], 0
    if numbers:
        yield pa.RecordBatch.from_arrays([pa.array(numbers, kind), pa.array(data, pa.binary())], names=[name, "data"])


def shared_keys(group: int, lists: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """For each list of a group those of its keys that another holder has too, and how often
    they are held, in steps of an eighth of a doubling; by the list's chunk."""
    sizes = [(len(data) - 9) // 6 for data in lists]
    places = np.concatenate([np.frombuffer(data, np.uint32, n, 9) for data, n in zip(lists, sizes)])
    order = np.argsort(places, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], places[order][1:] != places[order][:-1])))
    holders = np.diff(np.append(starts, len(places)))
    often = np.empty(len(places), np.int64)
    often[order] = np.repeat(holders, holders)
    steps = np.minimum(np.floor(8 * np.log2(often)), 255).astype(np.uint8)
    at = 0
    for data, n in zip(lists, sizes):
        held = often[at : at + n] > 1
        if held.any():
            number = np.frombuffer(data, np.uint16, n, 9 + 4 * n)
            columns = (places[at : at + n][held], number[held], steps[at : at + n][held])
            (chunk,) = np.frombuffer(data, np.int64, 1, 1).tolist()
            yield chunk, b"S" + np.int64(group).tobytes() + b"".join(column.tobytes() for column in columns)
        at += n


def first_keys(lists: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of the holders of a chunk class, n, key and whether it is frequent, of the keys of its prefix that
    others may have: by rarity, then by key."""
    numbers, keys, orders, holders = [], [], [], None
    for data in lists:
        if data[:1] == b"H":
            _, n, m = np.frombuffer(data, np.int64, 3, 1).tolist()
            holders = np.frombuffer(data, np.int64, 3 * n, 25).reshape(3, n)
            late = np.frombuffer(data, np.int64, 3 * m, 25 + 24 * n).reshape(3, m)
            numbers.append(late[0])
            keys.append(late[1])
            orders.append(late[2] + 256)
        else:
            n = (len(data) - 9) // 7
            (group,) = np.frombuffer(data, np.int64, 1, 1).tolist()
            keys.append((group << 32) + np.frombuffer(data, np.uint32, n, 9).astype(np.int64))
            numbers.append(np.frombuffer(data, np.uint16, n, 9 + 4 * n).astype(np.int64))
            orders.append(np.frombuffer(data, np.uint8, n, 9 + 6 * n).astype(np.int64))
    number, key, often = (np.concatenate(column) for column in (numbers, keys, orders))
    order = np.lexsort((key, often, number))
    number, key, often = number[order], key[order], often[order]
    shared = np.bincount(number, minlength=holders.shape[1])
    place = np.arange(len(number)) - np.repeat(np.cumsum(shared) - shared, shared)
    chosen = place < (holders[2] + shared)[number]
    number = number[chosen]
    return holders[0][number], holders[1][number], key[chosen], often[chosen] >= 256


def _prefixes(docs: DataFrame, counts: np.ndarray, words: int, percent: int, hot: int) -> DataFrame:
    """Of the classes that may have a partner the n-grams of their prefix that others may have:
    class, n, gram, late (whether it is a frequent one).

    Lists meet by group of hashes, which gives an n-gram's holders; what several hold goes
    back to the chunk of classes it came from.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = min(max(4 * partitions, -(-int(counts.sum()) // GROUP_GRAMS)), MAX_GROUPS)
    by_group = _lists(docs, counts, words, percent, hot, groups).repartition(max(partitions, groups // 4), "group")

    def gather(batches: Iterator[pa.RecordBatch]) -> dict[int, list[bytes]]:
        found: dict[int, list[bytes]] = {}
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(number, []).append(data)
        return found

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = gather(batches)
        for group in list(found):
            lists = found.pop(group)
            through = [(int(np.frombuffer(data, np.int64, 1, 1)[0]), data) for data in lists if data[:1] == b"H"]
            yield from _data(iter(through), "chunk", pa.int64())
            lists = [data for data in lists if data[:1] == b"K"]
            if lists:
                yield from _data(shared_keys(group, lists), "chunk", pa.int64())

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = gather(batches)
        for chunk in list(found):
            columns = first_keys(found.pop(chunk))
            for start in range(0, len(columns[0]), 100_000):
                arrays = [pa.array(column[start : start + 100_000]) for column in columns]
                yield pa.RecordBatch.from_arrays(arrays, names=["class", "n", "gram", "late"])

    by_chunk = by_group.mapInArrow(share, "chunk long, data binary").repartition("chunk")
    return by_chunk.mapInArrow(choose, "class long, n long, gram long, late boolean")


def _tiles(sets: DataFrame, most: int = 100_000) -> DataFrame:
    """Tiles of two classes or more, from the prefixes of sets: tile, class, n. Tiles of the same
    classes are one; those of frequent n-grams are taken as they are."""
    late = sets.select(F.explode("hot").alias("tile"), "class", "n")
    return _dealt_tiles(sets.select("class", "n", F.explode("prefix").alias("gram")), late, most)


def _dealt_tiles(grams: DataFrame, late: DataFrame, most: int = 100_000) -> DataFrame:
    dealt = grams.repartition("gram").sortWithinPartitions("gram", "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        rest = [np.zeros(0, np.int64)] * 3
        long_tile = None
        for batch in batches:
            fresh = [batch.column(name).to_numpy(zero_copy_only=False) for name in ("gram", "class", "n")]
            gram, key, n = (np.concatenate([old, new]) for old, new in zip(rest, fresh))
            starts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
            end = int(starts[-1])
            if end == 0 and len(gram) > most:
                # A tile that goes on and on leaves in pieces, under its n-gram's name.
                long_tile = int(gram[0])
                end = len(gram) - 1
                yield _members([(long_tile, key[:end], n[:end])])
            else:
                yield _members(_runs(gram[:end], key[:end], n[:end], starts, seen, long_tile))
                if end:
                    long_tile = None
            rest = [gram[end:], key[end:], n[end:]]
        if len(rest[0]):
            yield _members(_runs(*rest, np.zeros(1, np.int64), seen, long_tile))

    made = dealt.mapInArrow(run, "tile long, class long, n long")
    return stored(made.union(late).distinct(), "tiles")


def _runs(gram, key, n, starts, seen: set[int], long_tile: int | None) -> Iterator[tuple]:
    """Runs of one n-gram with two classes or more; one that repeats a set of classes
    this task has seen is left out."""
    if not len(gram):
        return
    edges = np.append(starts[starts < len(gram)], len(gram))
    goes_on = long_tile is not None and gram[0] == long_tile
    if goes_on:
        yield long_tile, key[: edges[1]], n[: edges[1]]
    for i in np.flatnonzero(np.diff(edges) > 1):
        a, b = edges[i], edges[i + 1]
        if i == 0 and goes_on:
            continue
        first = np.concatenate(([True], key[a + 1 : b] != key[a : b - 1]))
        members = key[a:b][first]
        if len(members) > 1:
            tile = class_of(members)
            if tile not in seen:
                if len(seen) < MAX_SEEN:
                    seen.add(tile)
                yield tile, members, n[a:b][first]


def _members(tiles) -> pa.RecordBatch:
    tiles = list(tiles)
    names = ["tile", "class", "n"]
    columns = [
        np.concatenate([np.full(len(key), tile, np.int64) for tile, key, _ in tiles] or [np.zeros(0, np.int64)]),
        np.concatenate([key for _, key, _ in tiles] or [np.zeros(0, np.int64)]),
        np.concatenate([n for _, _, n in tiles] or [np.zeros(0, np.int64)]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _blocks(tiles: DataFrame, size: int) -> DataFrame:
    """Members dealt to the blocks they meet in: block, side, class, n.

    A tile of more than ``size`` members, or of very many n-grams, is cut by hash, and each piece meets itself and
    every other one; pieces of one block are told apart by ``side``.
    """
    pieces = F.greatest(F.ceil(F.count("*") / size), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int")
    counted = stored(tiles.groupBy("tile").agg(pieces.alias("pieces")), "sizes")
    cut = tiles.join(counted, "tile").withColumn("piece", F.pmod(F.xxhash64("class", "tile"), F.col("pieces")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    met = cut.withColumn("other", other).select(
        F.xxhash64("tile", F.least("piece", "other"), F.greatest("piece", "other"), "pieces").alias("block"),
        (F.when(F.col("piece") == F.col("other"), 0).when(F.col("piece") < F.col("other"), 1).otherwise(2)).alias("side"),
        "class",
        "n",
    )
    return stored(met, "blocks")


class Members:
    """Sets of a block by size, with their bitmaps side by side where they are of one width."""

    def __init__(self, n: np.ndarray, bitmaps: list[np.ndarray]):
        self.n, self.bitmaps = n, bitmaps
        widths = np.array([len(bitmap) for bitmap in bitmaps])
        # A larger set has no narrower bitmap, so each width is a run.
        self.runs = []
        for width in np.unique(widths):
            begin, end = np.searchsorted(widths, [width, width + 1])
            self.runs.append((int(width), int(begin), np.stack(bitmaps[begin:end]).view(np.uint64)))

    def bounds(self, i: int, low: int) -> np.ndarray:
        """Upper bounds of the overlap of set ``i`` with each from ``low`` to before it."""
        out = np.empty(i - low, np.int64)
        for width, begin, maps in self.runs:
            a, b = max(low, begin), min(i, begin + len(maps))
            if a < b:
                mine, theirs = folded(self.bitmaps[i], width).view(np.uint64), maps[a - begin : b - begin]
                only_mine = np.bitwise_count(mine & ~theirs).sum(1, dtype=np.int64)
                only_theirs = np.bitwise_count(theirs & ~mine).sum(1, dtype=np.int64)
                out[a - low : b - low] = np.minimum(self.n[i] - only_mine, self.n[a:b] - only_theirs)
        return out


def _band(n: np.ndarray, side: np.ndarray, i: int, percent: int) -> tuple[int, np.ndarray]:
    """Of the sets before one by size, the first that is large enough, and which meet it."""
    low = int(np.searchsorted(n[:i], -(-percent * n[i] // 100)))
    return low, (side[low:i] == 0) | (side[low:i] != side[i])


def _likeliest(blocks: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Per class of a block its likeliest partner among those before it by size that the bound
    allows: a, b, bound. Signatures join their members here, so that only those of members that meet are moved.
    Where members have ``root`` and ``failed``, partners have another root and are not among those."""
    rooted = "root" in blocks.columns

    def compare(rows: dict[str, list]) -> list[tuple]:
        order = np.lexsort((rows["class"], rows["n"]))
        key, n, side = (np.array(rows[name], np.int64)[order] for name in ("class", "n", "side"))
        root = np.array(rows["root"], np.int64)[order] if rooted else key
        members = Members(n, [np.frombuffer(rows["bitmap"][k], np.uint8) for k in order])
        out = []
        for i in range(1, len(key)):
            low, meet = _band(n, side, i, percent)
            meet &= (key[low:i] != key[i]) & (root[low:i] != root[i])
            failed = rows["failed"][order[i]] if rooted else None
            if failed:
                meet &= ~np.isin(key[low:i], failed)
            if not meet.any():
                continue
            bound = members.bounds(i, low)
            fits = np.flatnonzero(meet & similar(bound, n[i], n[low:i], percent))
            if len(fits):
                share = bound[fits] / (n[i] + n[low + fits] - bound[fits])
                best = fits[int(np.argmax(share))]
                out.append((int(key[low + best]), int(key[i]), int(bound[best])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The best of each class so far; tiles overlap, and a class leaves a task once if the memory for that lasts.
        best: dict[int, tuple[float, int]] = {}
        for rows in _groups(batches, ["block"]):
            for a, b, bound in compare(rows):
                best[b] = max(best.get(b, (0, 0)), (bound, a))
            if len(best) >= MAX_SEEN:
                yield _pairs([(a, b, bound) for b, (bound, a) in best.items()], ("a", "b", "bound"))
                best = {}
        yield _pairs([(a, b, bound) for b, (bound, a) in best.items()], ("a", "b", "bound"))

    more = ["root", "failed"] if rooted else []
    dealt = blocks.join(maps, "class").select("block", "side", "class", "n", "bitmap", *more)
    dealt = dealt.repartition("block").sortWithinPartitions("block")
    best = dealt.mapInArrow(run, "a long, b long, bound long")
    return stored(best.groupBy("b").agg(F.max_by("a", F.struct("bound", "a")).alias("a")).select("a", "b"), "likeliest")


def _pairs(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(names))


def _involved(blocks: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Of blocks whose members have ``root`` those members that the bound allows to be similar to
    one of another root: block, side, class, n, root."""
    names = ["block", "side", "class", "n", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["block"]):
            order = np.lexsort((rows["class"], rows["n"]))
            n, side, root = (np.array(rows[name], np.int64)[order] for name in ("n", "side", "root"))
            members = Members(n, [np.frombuffer(rows["bitmap"][k], np.uint8) for k in order])
            marked = np.zeros(len(n), bool)
            for i in range(1, len(n)):
                low, meet = _band(n, side, i, percent)
                meet &= root[low:i] != root[i]
                if meet.any():
                    fits = np.flatnonzero(meet & similar(members.bounds(i, low), n[i], n[low:i], percent))
                    marked[low + fits] = True
                    marked[i] |= len(fits) > 0
            kept = order[marked]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(rows[name], np.int64)[kept]) for name in names], names=names)

    dealt = blocks.join(maps, "class").select(*names, "bitmap").repartition("block").sortWithinPartitions("block")
    return stored(dealt.mapInArrow(run, "block long, side long, class long, n long, root long"), "involved")


def spanning(key: np.ndarray, n: np.ndarray, side: np.ndarray, root: np.ndarray, grams: list[np.ndarray], percent: int, failed: set) -> list[tuple]:
    """Links of a block that join components, by exact intersection of what the bound leaves;
    fewer than members. Members come by size; ``failed`` remembers pairs that are not similar."""
    members = Members(n, [np.frombuffer(signature(g), np.uint8) for g in grams])
    root = root.copy()
    out = []
    for i in range(1, len(key)):
        low, meet = _band(n, side, i, percent)
        if not (meet & (root[low:i] != root[i])).any():
            continue
        fits = low + np.flatnonzero(meet & similar(members.bounds(i, low), n[i], n[low:i], percent))
        for j in fits.tolist():
            pair = (int(key[j]), int(key[i]))
            if root[j] == root[i] or pair in failed:
                continue
            if similar(len(np.intersect1d(grams[j], grams[i], assume_unique=True)), n[j], n[i], percent):
                out.append(pair)
                root[root == root[i]] = root[j]
            elif len(failed) < MAX_SEEN:
                failed.add(pair)
    return out


def _joining(blocks: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join different components, from blocks whose members have ``root``. The
    n-grams of the members come to the block, and no pair leaves it unverified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed: set[tuple] = set()
        done: set[tuple] = set()
        for rows in _groups(batches, ["block"]):
            order = np.lexsort((rows["class"], rows["n"]))
            key, n, side, root = (np.array(rows[name], np.int64)[order] for name in ("class", "n", "side", "root"))
            grams = [np.frombuffer(rows["grams"][k], np.uint64) for k in order]
            found = [pair for pair in spanning(key, n, side, root, grams, percent, failed) if pair not in done]
            if len(done) < MAX_SEEN:
                done.update(found)
            if found:
                yield _pairs(found, ("a", "b"))

    columns = ["block", "side", "class", "n", "root", "grams"]
    dealt = blocks.join(arrays, "class").select(columns).repartition("block").sortWithinPartitions("block")
    return stored(dealt.mapInArrow(run, "a long, b long"), "joining")


def _arrays(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """class and its sorted n-grams (eight bytes each), from the text of the row that stands for it."""
    rows = pick(docs, "doc_id", "text")
    asked = stored(wanted.select("class", F.col("doc_id").alias("_id"), F.col("version").alias("_version")), "wanted")
    asked = F.broadcast(asked) if asked.count() <= MAX_SENT else asked
    same = rows["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_version"))
    met = rows.join(asked, same).select("class", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                grams = [found.tobytes() for found in shingles_of(part.column("text").to_pylist(), words)]
                yield pa.RecordBatch.from_arrays([part.column("class"), pa.array(grams, pa.binary())], names=["class", "grams"])

    # Rows that agree stand for one class together.
    return stored(met.mapInArrow(run, "class long, grams binary").groupBy("class").agg(F.first("grams").alias("grams")), "grams")


def _open(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Blocks whose members are in several components, with each one's ``root``."""
    roots = blocks.join(found.select(F.col("node").alias("class"), "root"), "class", "left")
    roots = roots.withColumn("root", F.coalesce("root", "class"))
    apart = roots.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
    return stored(roots.join(apart.select("block"), "block", "left_semi"), "open")


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, list]]:
    """Rows of one key after the other, from rows sorted by key."""
    now, rows = None, None
    for batch in batches:
        columns = batch.to_pydict()
        keys = list(zip(*[columns[name] for name in names]))
        start = 0
        while start < len(keys):
            end = start
            while end < len(keys) and keys[end] == keys[start]:
                end += 1
            if keys[start] != now:
                if rows is not None:
                    yield rows
                now, rows = keys[start], {name: [] for name in columns}
            for name, values in columns.items():
                rows[name] += values[start:end]
            start = end
    if rows is not None:
        yield rows


def _checked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar, by exact intersection.

    Each text goes once to the star of every partner it is paired with; the partner's own
    text goes to each piece of the star. Only texts of paired classes are moved.
    """
    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    pieces = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("pieces"))
    leaves = pairs.join(pieces, "a").select(
        F.col("b").alias("class"), F.col("a").alias("star"), F.pmod(F.xxhash64("b"), F.col("pieces")).cast("int").alias("piece")
    )
    centers = pieces.select(
        F.col("a").alias("class"), F.col("a").alias("star"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")
    )
    stands = classes.select("class", F.col("doc_id").alias("_id"), F.col("version").alias("_version"))
    places = stored(leaves.union(centers).join(stands, "class"), "places")
    few = places.count() <= MAX_SENT
    places = places.groupBy("_id", "_version", "class").agg(F.collect_list(F.struct("star", "piece")).alias("places"))
    wanted = F.broadcast(places) if few else places
    texts = pick(docs, "doc_id", "text")
    same = texts["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_version"))
    texts = texts.join(wanted, same).select("class", "text", F.explode("places").alias("place"))
    dealt = texts.select("place.*", "class", "text").repartition("star", "piece")
    dealt = dealt.sortWithinPartitions("star", "piece", (F.col("class") != F.col("star")).cast("int"), "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, center, done = None, None, None
        for batch in batches:
            found = []
            for star, piece, key, text in zip(*[batch.column(c).to_pylist() for c in ("star", "piece", "class", "text")]):
                if (star, piece) != now:
                    now, center, done = (star, piece), None, None
                if key == done:
                    continue
                grams = shingles(text, words)
                done = key
                if key == star:
                    center = grams
                else:
                    common = len(np.intersect1d(center, grams, assume_unique=True))
                    if similar(common, len(center), len(grams), percent):
                        found.append((star, key))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return stored(dealt.mapInArrow(run, "a long, b long"), "similar")


def similar_groups(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, tile: int = TILE, hot: int = HOT
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id: the smallest doc_id reachable over links.

    Two documents are linked if ``100 * common >= percent * union`` of their sets of word
    n-grams (64-bit hashes), A-Z in lower case. A document of fewer words is one n-gram; one without words or
    text has an empty set and is linked with nothing. A null doc_id ranks after all
    others; repeated rows each give a row and are linked; an empty table gives no rows; a very
    long text is one set like others, in a block of its own; other columns are ignored.
    """
    ship(docs.sparkSession)
    sets, counts = _sets(docs, words)
    known = sets.filter("class is not null")
    stands = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "version")).alias("stands")
    classes = known.groupBy("class").agg(stands).select("class", "stands.doc_id", "stands.version")
    classes = stored(classes, "classes")
    prefixes = stored(_prefixes(docs, counts, words, percent, hot), "prefixes")
    release(docs.sparkSession)
    late = prefixes.filter("late").select(F.col("gram").alias("tile"), "class", "n")
    blocks = _blocks(_dealt_tiles(prefixes.filter("not late").select("class", "n", "gram"), late), tile)
    maps = known.filter("bitmap is not null").groupBy("class").agg(F.first("bitmap").alias("bitmap"))
    maps = stored(maps.join(blocks.select("class").distinct(), "class", "left_semi"), "signatures")

    tried = _likeliest(blocks, maps, percent)
    links = _checked(tried, docs, classes, words, percent)
    nodes = classes.select(F.col("class").alias("node"), F.col("doc_id").alias("label"))
    found = connected(nodes, links)
    release(docs.sparkSession)
    involved = _involved(_open(blocks, found), maps, percent)
    last = None
    for _ in range(ROUNDS):
        # The exact stage moves the n-grams of members still involved; if they are few, or rounds no longer
        # make them fewer, it takes them as they are.
        left = involved.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if left <= FEW * int(counts.sum()) or (last is not None and left > LEFT * last):
            break
        last = left
        failed = tried.join(links, ["a", "b"], "left_anti").groupBy("b").agg(F.collect_list("a").alias("failed"))
        again = involved.join(failed.withColumnRenamed("b", "class"), "class", "left")
        next_tried = _likeliest(again, maps, percent)
        if next_tried.isEmpty():
            break
        tried = tried.union(next_tried)
        fresh = _checked(next_tried, docs, classes, words, percent)
        links = links.union(fresh)
        found = joined(nodes, found, fresh)
        # Members that no bound lets meet another component do not come to be involved later.
        involved = _involved(_open(involved.drop("root"), found), maps, percent)
        release(docs.sparkSession)
    wanted = classes.join(involved.select("class").distinct(), "class", "left_semi")
    found = joined(nodes, found, _joining(involved, _arrays(docs, wanted, words), percent))

    members = sets.select("doc_id", "n", "class").join(classes.select("class", F.col("doc_id").alias("lowest")), "class", "left")
    members = members.join(found.select(F.col("node").alias("class"), "label"), "class", "left")
    alone = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("lowest"))
    return members.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", alone).alias("component_id"))
