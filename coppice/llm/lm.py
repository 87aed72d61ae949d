"""Language-model scores by a log-bilinear model, trained with noise-contrastive estimation.

The model predicts a word's class from the two classes before it. The most frequent
words are classes of their own; all others, the unknown ones too, belong to the class of their
ending, as far as that is frequent, else to one class that is left. A context's vectors, each turned
by the matrix of its place, add up to a prediction; its product with a class's vector,
plus the class's bias, is the logarithm of the class's share. Within the class of an ending
words count by how often they occur, plus one, and unknown words count once. So the
probabilities of all words and one unknown word of each ending add up to 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Collection, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from coppice.llm.common import blank_words, numbered, pick, ship, sliced, stored

# Words whose counts go to every task, at 16 bytes; the counts of all others are joined.
MAX_FREQUENT = 200_000
CLASSES, SIZE, NOISE = 512, 16, 64
# Bytes of a word that are its ending.
ENDING = 2
BATCH, RATE, LEAST_STEPS = 4096, 0.1, 200
# Squared steps that a parameter starts with, so that its first ones are small.
SQUARES = 1e-3
# Tokens of a trainer, and words a task counts before it passes them on.
TRAINER_TOKENS, CHUNK_WORDS = 4_000_000, 400_000
# Trained models added up by one task.
_AVERAGE_AT_A_TIME = 64
# A token that no word can be.
END = b"\n"
_BINS = 1024


def held_out(modulus: int = 7, remainder: int = 2) -> Column:
    """Rows that training leaves out; a null doc_id does not count as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def hash_of(word: bytes) -> int:
    return int(hashes_of([word])[0])


def hashes_of(words: Collection[bytes]) -> np.ndarray:
    """Signed 64-bit hashes."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def ending_of(word: bytes) -> int:
    """A number for a word's last bytes."""
    return int.from_bytes(word[-ENDING:], "big")


def endings_of(words: Collection[bytes]) -> np.ndarray:
    """:func:`ending_of` of each word."""
    line = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    last = np.cumsum(lengths) - 1
    found = np.zeros(len(words), np.int64)
    for place in range(ENDING):
        has = lengths > place
        found[has] += line[last[has] - place] << (8 * place)
    return found


class Tokens(NamedTuple):
    hashes: np.ndarray
    endings: np.ndarray


def tokens(text: str | None) -> Tokens:
    """Hashes and endings of a text's words and of the end."""
    words = [*blank_words(text), END]
    return Tokens(hashes_of(words), endings_of(words))


def tokens_of(texts: Sequence[str | None]) -> tuple[Tokens, list[np.ndarray]]:
    """Hashes and endings of the distinct words of some texts and of the end, and for each text the
    numbers of its words and of the end among them. What follows from a word is found once a batch."""
    kinds, lines = numbered([*blank_words(text), END] for text in texts)
    return Tokens(hashes_of(kinds), endings_of(kinds)), lines


def word_counts(docs: DataFrame) -> DataFrame:
    """Occurrences of every token, the end included: word (64-bit hash), ending, n. Counted in
    each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            texts = batch.column("text")
            found[END] += len(texts)
            for text in texts:
                found.update(blank_words(text.as_py()))
                if len(found) > CHUNK_WORDS:
                    yield _counted(found)
                    found = Counter()
        yield _counted(found)

    partial = pick(docs, "text").mapInArrow(count, "word long, ending long, n long")
    return stored(partial.groupBy("word").agg(F.max("ending").alias("ending"), F.sum("n").alias("n")), "words")


def _counted(found: Counter) -> pa.RecordBatch:
    n = np.fromiter(found.values(), np.int64, len(found))
    columns = {"word": hashes_of(found), "ending": endings_of(found), "n": n}
    return pa.RecordBatch.from_pydict({name: pa.array(values) for name, values in columns.items()})


class Lexicon(NamedTuple):
    """What every task knows of the counts."""

    words: np.ndarray  # hashes of the frequent words, sorted
    counts: np.ndarray
    own: np.ndarray  # class of each, or -1 if it has none of its own
    endings: np.ndarray  # frequent endings, sorted
    classes: np.ndarray  # class of each
    unigram: np.ndarray  # share of each class, above 0
    rest: np.ndarray  # of each class what its words count together, an unknown one included
    least: int  # a word with this count or more is frequent
    total: int  # tokens
    distinct: int

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each token is frequent, and where it is if so."""
        return _found(self.words, hashes)

    def classes_of(self, line: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Class of each token, and whether others are in it too."""
        frequent, at = self.find(line.hashes)
        known, place = _found(self.endings, line.endings)
        by_ending = np.where(known, self.classes[place], SHARED) if len(self.classes) else np.full(len(known), SHARED)
        own = np.where(frequent, self.own[at], -1) if len(self.own) else np.full(len(known), -1)
        return np.where(own >= 0, own, by_ending), own < 0


def _found(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among the sorted known ones, and where."""
    if not len(known):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values, at


SHARED = 0


def lexicon(counts: DataFrame, classes: int = CLASSES, most: int = MAX_FREQUENT) -> Lexicon:
    """The frequent words: all from some count on, the lowest that leaves at most ``most``. Half of
    the classes are words, the others endings of all other words, and one is what is left."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # Counts in bins of a 16th of a doubling; there are never more bins than this.
    width = F.floor(F.log2("n") * 16)
    bins = counts.groupBy(width.alias("bin")).agg(F.count("*").alias("words"), F.min("n").alias("low"))
    least, kept = 1 << 62, 0
    for row in bins.orderBy(F.desc("bin")).limit(_BINS).collect():
        if kept + row.words > most:
            break
        least, kept = row.low, kept + row.words
    table = counts.filter(F.col("n") >= least).toArrow()
    words, ending, n = (table.column(name).to_numpy().astype(np.int64) for name in ("word", "ending", "n"))
    order = np.argsort(words)
    words, ending, n = words[order], ending[order], n[order]
    # The end is always a class; then the most frequent words, equal ones by hash.
    is_end = words == hash_of(END)
    first = np.lexsort((words, -n, ~is_end))[: classes // 2]
    own = np.full(len(words), -1)
    own[first] = np.arange(1, len(first) + 1)
    # Endings, of which there are 65,792 at most, by what words without a class count.
    found = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("words")).toArrow()
    endings, by_ending, kinds = (found.column(name).to_numpy().astype(np.int64) for name in ("ending", "n", "words"))
    order = np.argsort(endings)
    endings, by_ending, kinds = endings[order], by_ending[order], kinds[order]
    place = np.searchsorted(endings, ending[first])
    np.subtract.at(by_ending, place, n[first])
    np.subtract.at(kinds, place, 1)
    chosen = np.lexsort((endings, -by_ending))[: classes - classes // 2 - 1]
    chosen = np.sort(chosen[by_ending[chosen] > 0])
    of_ending = np.full(len(endings), SHARED)
    of_ending[chosen] = len(first) + 1 + np.arange(len(chosen))
    share, rest = np.zeros(classes), np.ones(classes)
    np.add.at(share, own[first], n[first])
    np.add.at(share, of_ending, by_ending)
    np.add.at(rest, of_ending, by_ending + kinds)
    share = (share + 1) / (share + 1).sum()
    return Lexicon(words, n, own, endings[chosen], of_ending[chosen], share, rest, int(least), int(total), int(distinct))


class Weights(NamedTuple):
    context: np.ndarray  # classes x size
    turn: np.ndarray  # places x size x size
    target: np.ndarray  # classes x size
    bias: np.ndarray  # classes

    def flat(self) -> np.ndarray:
        return np.concatenate([part.ravel() for part in self])

    def like(self, flat: np.ndarray) -> Weights:
        cuts = np.cumsum([part.size for part in self])[:-1]
        return Weights(*[x.reshape(part.shape) for x, part in zip(np.split(flat, cuts), self)])


def beginning(unigram: np.ndarray, size: int = SIZE, seed: int = 42) -> Weights:
    """Small random vectors, and biases that give each class its own share."""
    rng = np.random.default_rng(seed)
    n = len(unigram)
    return Weights(
        rng.normal(0, 0.1, (n, size)),
        np.stack([np.eye(size), np.eye(size) * 0.5]),
        rng.normal(0, 0.1, (n, size)),
        np.log(unigram),
    )


def trigrams(classes: Sequence[np.ndarray], n: int, end: int) -> np.ndarray:
    """Codes of (class two before, class before, class) for all tokens of some texts; the
    end stands before a text."""
    out = []
    for own in classes:
        padded = np.concatenate(([end, end], own))
        out.append((padded[:-2] * n + padded[1:-1]) * n + padded[2:])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def nce(weights: Weights, codes: np.ndarray, unigram: np.ndarray, rng: np.random.Generator, squares: Weights) -> Weights:
    """AdaGrad steps over the trigrams: one pass, or as many as make up ``LEAST_STEPS``.
    Equal trigrams are taken together, in lots of up to 8, and count as often as they occur."""
    n = len(unigram)
    kinds, times = np.unique(codes, return_counts=True)
    lots = -(-times // 8)
    kinds, times = np.repeat(kinds, lots), np.repeat(times / lots, lots)
    passes = -(-LEAST_STEPS // -(-len(kinds) // BATCH))
    order = np.concatenate([rng.permutation(len(kinds)) for _ in range(passes)])
    log_noise = np.log(NOISE * unigram).astype(np.float32)
    times = times.astype(np.float32)
    for start in range(0, len(order), BATCH):
        at = order[start : start + BATCH]
        code, often = kinds[at], times[at]
        often = often / often.sum()
        w2, w1, word = code // (n * n), code // n % n, code % n
        context, turn, target, bias = (part.astype(np.float32) for part in weights)
        r2, r1 = context[w2], context[w1]
        q = r1 @ turn[0] + r2 @ turn[1]
        noise = rng.choice(n, NOISE, p=unigram)
        known, other = target[word], target[noise]
        real = np.einsum("ij,ij->i", q, known) + (bias - log_noise)[word]
        false = q @ other.T + (bias - log_noise)[noise]
        up = often / (1 + np.exp(np.clip(real, -30, 30)))
        down = often[:, None] / (1 + np.exp(np.clip(-false, -30, 30)))
        dq = up[:, None] * known - down @ other
        both = np.concatenate([word, noise])
        grad = Weights(
            _added(np.concatenate([w1, w2]), np.concatenate([dq @ turn[0].T, dq @ turn[1].T]), n),
            np.stack([r1.T @ dq, r2.T @ dq]),
            _added(both, np.concatenate([up[:, None] * q, -(down.T @ q)]), n),
            np.bincount(both, np.concatenate([up, -down.sum(0)]), n),
        )
        for part, square, step in zip(weights, squares, grad):
            square += step * step
            part += RATE * step / (np.sqrt(square) + 1e-6)
    return weights


def _added(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Values added up by row."""
    width = values.shape[1]
    slots = (rows[:, None] * width + np.arange(width)).ravel()
    return np.bincount(slots, values.ravel(), n * width).reshape(n, width)


def train(docs: DataFrame, known: Lexicon) -> Weights:
    """The texts are dealt by hash to trainers of about :data:`TRAINER_TOKENS` tokens, which
    take them in order of that hash; so a model follows from the rows, however they lie. Each trainer starts
    from the same beginning, and the models are averaged by tokens, some at a time, level by level."""
    start = beginning(known.unigram)
    end = _end_class(known)
    dealt = pick(docs, "doc_id", "text").withColumn("deal", F.xxhash64("doc_id", "text"))
    trainers = max(1, -(-known.total // TRAINER_TOKENS))
    dealt = dealt.repartition(trainers, "deal").sortWithinPartitions("deal").select("text")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(*[part.copy() for part in start])
        squares = Weights(*[np.full_like(part, SQUARES) for part in start])
        rng = np.random.default_rng(7)
        seen, waiting, classes = 0, 0, []
        for part in sliced(batches, 500):
            kinds, lines = tokens_of(part.column("text").to_pylist())
            class_of = known.classes_of(kinds)[0].astype(np.int32)
            for line in lines:
                own = class_of[line]
                classes.append(own)
                waiting += len(own)
                if waiting >= TRAINER_TOKENS:
                    nce(weights, trigrams(classes, len(known.unigram), end), known.unigram, rng, squares)
                    seen, waiting, classes = seen + waiting, 0, []
        if waiting:
            nce(weights, trigrams(classes, len(known.unigram), end), known.unigram, rng, squares)
        if seen + waiting:
            yield _model(float(seen + waiting), weights.flat())

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0.0, np.zeros(start.flat().size)
        for batch in batches:
            for n, flat in zip(batch.column("n").to_pylist(), batch.column("flat")):
                count += n
                total += n * np.frombuffer(flat.as_py())
        if count:
            yield _model(count, total / count)

    types = "n double, flat binary"
    models = stored(dealt.mapInArrow(fit, types), "models")
    n = models.count()
    while n > 1:
        n = -(-n // _AVERAGE_AT_A_TIME)
        # Sorted, so that sums come out the same again.
        models = stored(models.repartition(n, F.xxhash64("flat")).sortWithinPartitions("n", "flat").mapInArrow(average, types), "models")
    found = sorted((row.n, bytes(row.flat)) for row in models.collect())
    if not found:
        return start
    return start.like(sum(n * np.frombuffer(flat) for n, flat in found) / sum(n for n, _ in found))


def _model(n: float, flat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"n": pa.array([n]), "flat": pa.array([flat.tobytes()], pa.binary())})


def _end_class(known: Lexicon) -> int:
    return int(known.classes_of(tokens(None))[0][0])


class Scorer:
    """Normalised log-probabilities; a context's normaliser is made once, with its batch."""

    def __init__(self, weights: Weights, known: Lexicon):
        self.known, self.target, self.bias = known, weights.target, weights.bias
        self.near = weights.context @ weights.turn[0]
        self.far = weights.context @ weights.turn[1]
        self.n = len(weights.bias)
        self.end = _end_class(known)
        self.normaliser = np.full(self.n * self.n, np.nan, np.float32)

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Natural logarithm of each trigram's last class, given the two before."""
        contexts, word = codes // self.n, codes % self.n
        missing = np.unique(contexts[np.isnan(self.normaliser[contexts])])
        for start in range(0, len(missing), 8192):
            some = missing[start : start + 8192]
            scores = (self.far[some // self.n] + self.near[some % self.n]) @ self.target.T + self.bias
            top = scores.max(1)
            self.normaliser[some] = top + np.log(np.exp(scores - top[:, None]).sum(1))
        q = self.far[contexts // self.n] + self.near[contexts % self.n]
        return np.einsum("ij,ij->i", q, self.target[word]) + self.bias[word] - self.normaliser[contexts]

    def score(self, texts: Sequence[str | None]) -> Iterator[tuple]:
        """Per text: tokens; how many are frequent; their sum of log10(count + 1), and
        that of those without a class of their own; sum of log10 of class probabilities; sum of log10 of what
        the classes of those without one count; the other words' hashes and how often each occurs."""
        kinds, lines = tokens_of(texts)
        lengths = np.array([len(line) for line in lines])
        line = np.concatenate(lines)
        frequent, at = self.known.find(kinds.hashes)
        own, shared = self.known.classes_of(kinds)
        plus_one = np.where(frequent, np.log10(self.known.counts[at] + 1.0), 0.0) if len(self.known.words) else np.zeros(len(own))
        within = np.where(shared, np.log10(self.known.rest)[own], 0.0)
        hashes, frequent, own, shared, plus_one, within = (kind[line] for kind in (kinds.hashes, frequent, own, shared, plus_one, within))
        cuts = np.concatenate(([0], np.cumsum(lengths)))
        codes = trigrams([own[a:b] for a, b in zip(cuts, cuts[1:])], self.n, self.end)
        chance = self.log_probabilities(codes) / np.log(10)
        for a, b in zip(cuts, cuts[1:]):
            rare, times = np.unique(hashes[a:b][~frequent[a:b]], return_counts=True)
            part = plus_one[a:b]
            yield (
                int(b - a),
                int(frequent[a:b].sum()),
                float(part.sum()),
                float(part[shared[a:b]].sum()),
                float(chance[a:b].sum()),
                float(within[a:b].sum()),
                rare,
                times,
            )


def score_texts(docs: DataFrame, classes: int = CLASSES, most: int = MAX_FREQUENT) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Counts and model come from all rows that are not held out. ``base_score`` is the
    add-one unigram score; ``score`` is the model's, log10 of the text with its end. A
    null text counts as empty and has the end only; without training rows all counts are
    0; repeated rows each give a row; other columns are ignored.

    Counts of frequent words are at hand in each task. All other words of a document
    meet theirs in a join, one row per document and word. Very long texts are whole in one
    task; rows that agree in doc_id and text have one trainer.
    """
    ship(docs.sparkSession)
    rows = pick(docs, "doc_id", "text")
    training = rows.filter(~held_out())
    counts = word_counts(training)
    known = lexicon(counts, classes, most)
    weights = train(training, known)

    made = StructType.fromDDL(
        "n_tokens long, n_frequent long, plus_one double, shared_plus_one double, chance double, within double,"
        "rare array<long>, times array<long>"
    )
    schema = StructType([rows.schema["doc_id"], *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(made)
        scorer = Scorer(weights, known)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                columns = list(zip(*scorer.score(part.column("text").to_pylist())))
                arrays = [pa.array(values, field.type) for values, field in zip(columns, arrow)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=schema.names)

    parts = rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    parts = stored(parts, "parts")
    words = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", "x.rare", "x.times")
    others = counts.filter(F.col("n") < known.least).select(F.col("word").alias("rare"), "n")
    met = words.join(others, "rare").groupBy("row").agg(
        F.sum("times").alias("n_met"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("met_plus_one")
    )
    whole = parts.drop("rare", "times").join(met, "row", "left")
    met_plus_one = F.coalesce("met_plus_one", F.lit(0.0))
    base = F.col("plus_one") + met_plus_one - F.col("n_tokens") * F.lit(float(np.log10(known.total + known.distinct + 1)))
    score = F.col("chance") + F.col("shared_plus_one") + met_plus_one - F.col("within")
    return whole.select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("n_met", F.lit(0))).cast("long").alias("n_known"),
        F.lit(known.total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        score.alias("score"),
    )
