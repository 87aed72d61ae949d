"""License scans: notice phrases by Aho-Corasick, tagged expressions by a shunting-yard parser."""

from __future__ import annotations

import re
from collections.abc import Mapping

import ahocorasick
from pyspark.sql import DataFrame

from coppice.llm.common import alnum_words, map_texts

# Base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notices.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
# How freely a text under a label may be used; others count as UNKNOWN.
FREEDOM = {
    "public-domain": 1.0,
    "mit": 1.0,
    "bsd": 1.0,
    "isc": 1.0,
    "apache": 0.9,
    "cc-by": 0.8,
    "mpl": 0.6,
    "epl": 0.6,
    "lgpl": 0.5,
    "gpl": 0.4,
    "agpl": 0.3,
    "all-rights-reserved": 0.0,
}
UNKNOWN = 0.2
TAG = "spdx license identifier"
_TAGGED = re.compile(r"spdx-license-identifier[ \t]*:", re.IGNORECASE)
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*", re.IGNORECASE)
_PART = re.compile(_TOKEN.pattern + r"|[\r\n]", re.IGNORECASE)
_BINDING = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    """Label of an identifier: ``GPL-3.0-only`` is gpl, ``Apache-2.0`` is apache."""
    name = identifier.lower()
    known = [label for label in FREEDOM if name == label or name.startswith(f"{label}-")]
    return max(known, key=len, default=name)


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting yard; ``with`` binds closest, then ``and``, then ``or``. Raises ValueError."""
    out, waiting, operand_next = [], [], True
    for token in tokens:
        word = token.lower()
        if word == "(":
            if not operand_next:
                raise ValueError("( after an operand")
            waiting.append(word)
        elif operand_next:
            if word == ")" or word in _BINDING:
                raise ValueError(f"{token} where a license is due")
            out.append(token)
            operand_next = False
        elif word == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise ValueError(") without (")
            waiting.pop()
        elif word in _BINDING:
            while waiting and waiting[-1] != "(" and _BINDING[waiting[-1]] >= _BINDING[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand_next = True
        else:
            raise ValueError(f"{token} after a license")
    if operand_next or "(" in waiting:
        raise ValueError("unfinished expression")
    return out + waiting[::-1]


def evaluate(expression: str) -> tuple[float, set[str]]:
    """Freedom and labels of an expression: ``or`` lets the user choose the freer side,
    ``and`` binds to the stricter, an exception added by ``with`` changes neither."""
    stack: list[tuple[float, set[str]]] = []
    for token in to_postfix(_TOKEN.findall(expression)):
        if token in _BINDING and len(stack) > 1:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                stack.append(left)
            else:
                choose = max if token == "or" else min
                stack.append((choose(left[0], right[0]), left[1] | right[1]))
        else:
            label = family(token)
            stack.append((FREEDOM.get(label, UNKNOWN), {label}))
    return stack.pop()


def beginning(text: str, at: int) -> str:
    """The longest valid expression that begins at a place of a text, on its line; empty
    if there is none. Reading stops at the first token that cannot go on the expression, and after one
    that ends a sentence."""
    tokens, valid, depth, operand_next = [], 0, 0, True
    for match in _PART.finditer(text, at):
        token = match[0].rstrip(".:-")
        word = token.lower()
        if word in ("", "\r", "\n") or _TAGGED.match(text, match.start()):
            break
        if word == "(" or operand_next:
            if not operand_next or word == ")" or word in _BINDING:
                break
            depth += word == "("
            operand_next = word == "("
        elif word == ")":
            if not depth:
                break
            depth -= 1
        elif word in _BINDING:
            operand_next = True
        else:
            break
        tokens.append(token)
        if not operand_next and not depth:
            valid = len(tokens)
        if token != match[0]:
            break
    return " ".join(tokens[:valid])


def tagged(text: str) -> list[tuple[float, set[str]]]:
    """Every identifier tag of a text, its longest valid beginning evaluated; one without is left out."""
    found = [beginning(text, match.end()) for match in _TAGGED.finditer(text)]
    return [evaluate(expression) for expression in found if expression]


def automaton(phrases: Mapping[str, str]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for phrase in phrases:
        machine.add_word(f" {phrase} ", phrase)
    machine.make_automaton()
    return machine


def scan(text: str, machine: ahocorasick.Automaton, base: Mapping[str, str], more: Mapping[str, str]) -> tuple:
    words = alnum_words(text)
    line = b" ".join([b"", *words, b""]).decode("latin-1")
    places, own, others = [], set(), []
    tags = False
    for end, phrase in machine.iter(line):
        if phrase in base:
            places.append(line.count(" ", 0, end - len(phrase)) - 1)
            own.add(base[phrase])
        elif phrase == TAG:
            tags = True
        else:
            others.append(more[phrase])
    expressions = tagged(text) if tags else []
    labels = own.union(others, *[names for _, names in expressions])
    values = [FREEDOM.get(label, UNKNOWN) for label in own.union(others)] + [value for value, _ in expressions]
    first, last = (min(places), max(places)) if places else (None, None)
    score = min(values, default=0.0)
    return len(words), len(places), first, last, ",".join(sorted(own)), ",".join(sorted(labels)), score


def license_scan(docs: DataFrame, base: Mapping[str, str] = BASE_PHRASES, more: Mapping[str, str] = NOTICES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A phrase is found wherever its words stand one after the other, whatever separates
    them; places may overlap. ``score`` is the freedom the strictest of all notices
    leaves, 0 without any. Narrow: no shuffle. A null text counts as empty and has no
    notices; repeated rows each give a row; an empty table gives no rows; a very long text is
    read whole by one task; other columns are ignored.
    """
    base, more = dict(base), {k: v for k, v in more.items() if k not in base}

    def start():
        machine = automaton({**base, **more, TAG: ""})
        return lambda texts: [scan(text or "", machine, base, more) for text in texts]

    types = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_texts(docs, start, types)
