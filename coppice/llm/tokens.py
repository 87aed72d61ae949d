"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

The BPE rule (merge the best-scored adjacent pair, leftmost first) has two properties
that make it a left-to-right machine. A boundary that survives in the tokens of a text
splits it: both sides have the tokens they have alone. And tokens ``a`` then ``b`` can
stand side by side exactly if the two characters' strings together give ``[a, b]``. So
the last token of every prefix is the one suffix that fits the last token before it, and
a state needs only the prefixes that a piece may still continue.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

from coppice.llm.common import map_texts

# Fixed value: how the vocabulary writes a blank.
BLANK = "▁"
# Code points per chunk of a long text.
CHUNK = 1 << 16
# States kept compiled; beyond them the machine starts anew, so its memory is bounded.
MAX_STATES = 200_000
# Words whose tokens are kept, as transitions over a whole word; bounded like the states.
MAX_WORDS = 400_000
_WORDS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
PROBES = ("", " ", "a", "  two  blanks ", "line\n\tend", "½ﬁ　x", "<s>\x00\U0010fffe")


class State(dict):
    """Transitions of one state, compiled when first taken: character -> (tokens, state).

    ``entries`` holds (open prefix, token before it, tokens counted there less those
    counted here); ``last`` is the character before.
    """

    __slots__ = ("machine", "entries", "last")

    def __missing__(self, char: str) -> tuple[int, State]:
        step = self[char] = self.machine.compile(self, char)
        return step


class Transducer:
    """Deterministic machine whose transitions say by how many tokens a character changes the count."""

    def __init__(self, pieces: Iterable[tuple[str, float]], max_states: int = MAX_STATES):
        self.scores = dict(pieces)
        self.max_states = max_states
        prefixes = {piece[:i] for piece in self.scores for i in range(1, len(piece) + 1)}
        self.open = {piece[:i] for piece in self.scores for i in range(1, len(piece))}
        self.known = prefixes
        self.pairs = {piece[i : i + 2] for piece in self.scores for i in range(len(piece) - 1)}
        missing = {char for piece in self.scores for char in piece} - set(self.scores)
        if missing:
            raise ValueError(f"characters without a piece of their own: {sorted(missing)[:5]}")
        # True if no piece holds a blank after another character: then every word starts anew.
        self.words_apart = not any(b == BLANK != a for a, b in self.pairs)
        self.words: dict[str, int] = {}
        self.fits: dict[tuple[str | None, str], bool] = {}
        self._restart()

    def _restart(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self._state((("", None, 0),), "")

    def _state(self, entries: tuple, last: str) -> State:
        state = self.states.get((entries, last))
        if state is None:
            state = self.states[entries, last] = State()
            state.machine, state.entries, state.last = self, entries, last
        return state

    def merged(self, text: str) -> list[str]:
        """Tokens of a short string by the merge rule itself."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.scores.get(a + b) for a, b in zip(parts, parts[1:])]
            best = max((s for s in scores if s is not None), default=None)
            if best is None:
                break
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fit(self, before: str | None, piece: str) -> bool:
        key = (before, piece)
        known = self.fits.get(key)
        if known is None:
            alone = [piece] if before is None else [before, piece]
            if len(self.fits) >= 4 * self.max_states:
                self.fits.clear()
            known = self.fits[key] = self.merged("".join(alone)) == alone
        return known

    def compile(self, state: State, char: str) -> tuple[int, State]:
        """The transition on a character; where no piece spans the gap before it, the
        machine goes on from its start, whatever the state was."""
        if len(self.states) > self.max_states:
            self._restart()
        if char not in self.scores:
            return len(char.encode()), self.start
        entries = state.entries if state.last + char in self.pairs else self.start.entries
        tokens, piece, still = None, None, []
        for prefix, before, counted in entries:
            grown = prefix + char
            if grown not in self.known:
                continue
            if grown in self.scores and tokens is None and self._fit(before, grown):
                tokens, piece = counted + 1, grown
            if grown in self.open:
                still.append((grown, before, counted))
        entries = (*[(p, t, n - tokens) for p, t, n in still], ("", piece, 0))
        return tokens, self._state(entries, char)

    def step(self, state: State, text: str) -> tuple[int, State]:
        total = 0
        for char in text:
            tokens, state = state[char]
            total += tokens
        return total, state

    def run(self, state: State, text: str) -> tuple[int, State]:
        """Tokens a string adds, and the state after it; inner words go in one transition each."""
        parts = _WORDS.findall(text) if self.words_apart else [text]
        if len(parts) < 3:
            return self.step(state, text)
        total = self.step(state, parts[0])[0]
        words = self.words
        for word in parts[1:-1]:
            tokens = words.get(word)
            if tokens is None:
                if len(words) >= MAX_WORDS:
                    words.clear()
                tokens = words[word] = self.step(self.start, word)[0]
            total += tokens
        tokens, state = self.step(self.start, parts[-1])
        return total + tokens, state

    def resets(self, before: str, char: str) -> bool:
        return before + char not in self.pairs

    def chunk_map(self, chunk: str, first: bool) -> tuple[str, int, State | None]:
        """What a chunk does to any state: ``(head, tokens, end)``.

        The head runs from the state that comes in; after it the machine restarts, so the
        tokens of the rest and the state at its end do not depend on what came in. A
        chunk without a restart is all head, and its end is None.
        """
        at = 0 if first else next((i for i in range(1, len(chunk)) if self.resets(chunk[i - 1], chunk[i])), None)
        if at is None:
            return chunk, 0, None
        return chunk[:at], *self.run(self.start, chunk[at:])

    def compose(self, left: tuple, right: tuple) -> tuple:
        """The map of two neighbouring chunks; associative."""
        if left[2] is None:
            return left[0] + right[0], right[1], right[2]
        tokens, state = self.run(left[2], right[0])
        return left[0], left[1] + tokens + right[1], right[2] if right[2] is not None else state

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a text: maps of its chunks, each made on its own, composed in pairs."""
        if not text:
            return 0
        text = BLANK + text.replace(" ", BLANK)
        if len(text) <= chunk:
            return self.run(self.start, text)[0]
        maps = [self.chunk_map(text[i : i + chunk], i == 0) for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            pairs = [self.compose(*maps[i : i + 2]) for i in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[len(maps) - len(maps) % 2 :]
        return maps[0][1]


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece BPE model with byte fallback, identity
    normalisation and a blank put first; another kind of model is an error."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    ids = [i for i in range(model.vocab_size()) if not any(test(i) for test in special)]
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in ids]
    machine = Transducer(pieces)
    if any(machine.count(text) != len(model.encode(text)) for text in PROBES):
        raise ValueError(f"{path} is not a BPE model of the kind this operator compiles")
    return pieces


_machines: dict[int, Transducer] = {}


def _machine(pieces: Sequence[tuple[str, float]]) -> Transducer:
    """One machine per Python worker, kept from task to task."""
    key = hash(tuple(pieces))
    if key not in _machines:
        _machines.clear()
        _machines[key] = Transducer(pieces)
    return _machines[key]


def token_counts(docs: DataFrame, pieces: Sequence[tuple[str, float]], limit: int = 4096) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    Narrow: no shuffle. A null text counts as empty, an empty one has no tokens. Repeated
    rows each give a row; a null doc_id stays null; an empty table gives no rows; a very long
    text is cut in chunks, whose maps are composed; other columns are ignored.
    """

    def start():
        machine = _machine(pieces)

        def count(texts: list[str | None]) -> list[tuple]:
            found = [(len((text or "").encode()), machine.count(text or "")) for text in texts]
            return [(n_bytes, n_tokens, n_tokens > limit) for n_bytes, n_tokens in found]

        return count

    return map_texts(docs, start, "n_bytes long, n_tokens long, over_limit boolean")
