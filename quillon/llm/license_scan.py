"""License scans (operator 9): Aho-Corasick over words, shunting-yard over expressions.

A text's words, A-Z lowered, joined by one space, run once through an automaton
of notice phrases and of the identifier tag. Where the tag occurs, the
expressions behind it are parsed to postfix order and evaluated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

# Phrases of the contract and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notice phrases of well-known licences.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons": "cc",
    "unlicense": "unlicense",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
_EXPRESSION = re.compile(rb"spdx-license-identifier:", re.I)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_STEP = re.compile(rb"[ \t]*(\(|\)|[A-Za-z0-9.+:-]+)")
# Operators by rank.
_RANK = {"or": 1, "and": 2, "with": 3}

_letters = bytes(range(97, 123))
_keep = bytes(range(48, 58)) + _letters + bytes(range(128, 256))
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _keep else 32 for b in range(256))


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: operands and operators (or, and, with) in postfix order. `with` joins a licence and an exception, both single names. Raises ValueError if it is no expression."""
    out: list[str] = []
    held: list[str] = []
    operand = True  # what may come next
    last, bare = "", False  # the token before; whether it is a licence that may take an exception
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if word == "(":
            if not operand or last == "with":
                raise ValueError(f"operator expected before ( in {expression!r}")
            held.append(word)
        elif word == ")":
            if operand:
                raise ValueError(f"operand expected before ) in {expression!r}")
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ValueError(f"unopened ) in {expression!r}")
            held.pop()
            bare = False
        elif word in _RANK:
            if operand or (word == "with" and not bare):
                raise ValueError(f"operand expected before {token} in {expression!r}")
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[word]:
                out.append(held.pop())
            held.append(word)
            operand = True
        else:
            if not operand:
                raise ValueError(f"operator expected before {token} in {expression!r}")
            out.append(word)
            operand, bare = False, last != "with"
        last = word
    if operand or "(" in held:
        raise ValueError(f"incomplete expression {expression!r}")
    return out + held[::-1]


@dataclass
class Terms:
    """Licences and sub-expressions under one operator; nested uses of the same operator are one."""

    kind: str
    names: set[str] = field(default_factory=set)
    parts: list[Terms] = field(default_factory=list)


def evaluate(expression: str) -> Terms:
    """The tree of an expression, of a size linear in it; an exception rides on its licence as `licence with exception`."""
    stack: list[str | Terms] = []
    for token in to_postfix(expression):
        if token not in _RANK:
            stack.append(token)
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with":
            stack.append(f"{a} with {b}")
            continue
        x, y = (t if isinstance(t, Terms) and t.kind == token else Terms(token, {t}) if isinstance(t, str) else Terms(token, parts=[t]) for t in (a, b))
        if len(x.names) + len(x.parts) < len(y.names) + len(y.parts):
            x, y = y, x
        x.names |= y.names
        x.parts += y.parts
        stack.append(x)
    return stack[0] if isinstance(stack[0], Terms) else Terms("or", {stack[0]})


def licences(tree: Terms) -> set[str]:
    """All licences that an expression names."""
    found, todo = set(), [tree]
    while todo:
        x = todo.pop()
        found |= x.names
        todo += x.parts
    return found


def shown(tree: Terms) -> str:
    """An expression with | and &, names in order before sub-expressions."""
    out: list[str] = []
    todo: list[str | Terms] = [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        items: list[str | Terms] = []
        for name in sorted(x.names):
            items += [" | " if x.kind == "or" else " & ", name]
        for part in x.parts:
            items += [" | " if x.kind == "or" else " & ", "(", part, ")"]
        todo += items[:0:-1]
    return "".join(out)


def satisfied(expression: str, accepted: set[str]) -> bool:
    """Whether the accepted licences (lower case) suffice for an expression."""
    stack: list[bool | str] = []
    for token in to_postfix(expression):
        if token not in _RANK:
            stack.append(token)
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with":
            stack.append(f"{a} with {b}")
            continue
        x, y = (t if isinstance(t, bool) else t in accepted for t in (a, b))
        stack.append(x or y if token == "or" else x and y)
    return stack[0] if isinstance(stack[0], bool) else stack[0] in accepted


def leading_expression(raw: bytes, start: int = 0) -> str:
    """The longest valid expression that begins at a place of a text, empty if there is none.

    It ends at the first token that can't continue it, at a character that is in
    no token, and at dashes or full stops that end or make up a token.
    """
    end = at = start
    depth = 0
    operand = True  # what may come next
    last, bare = "", False
    while m := _STEP.match(raw, at):
        token = m[1].decode()
        word = token.rstrip(".:-")
        name = word.lower()
        if token == "(" and operand and last != "with":
            depth += 1
        elif token == ")" and not operand and depth:
            depth -= 1
            bare = False
        elif name in _RANK and not operand and word == token and (bare or name != "with"):
            operand = True
        elif token not in ("(", ")") and name not in _RANK and operand and word[:1].isalnum():
            operand, bare = False, last != "with"
        else:
            break
        last = name
        at = m.end()
        if not operand and not depth:
            end = at - (len(token) - len(word) if token not in ("(", ")") else 0)
        if token not in ("(", ")") and word != token:
            break
    return raw[start:end].decode().strip()


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in NOTICES.items():
        found.add_word(f" {phrase} ", (phrase, label, False))
    for phrase, label in BASE.items():
        found.add_word(f" {phrase} ", (phrase, label, True))
    found.add_word(f" {TAG} ", (TAG, None, False))
    found.make_automaton()
    return found


def scan(raw: bytes) -> tuple[int, int, int | None, int | None, str, str, float, list[str]]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions of one text."""
    words = raw.translate(_TABLE).split()
    line = f" {b' '.join(words).decode()} "
    places: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    doubt, tagged = 1.0, False
    for end, (phrase, label, counts) in _automaton().iter(line):
        start = end - len(phrase) - 1
        if label is None:
            tagged = True
        else:
            labels.add(label)
            doubt *= 0.2 if counts else 0.4
        if counts:
            places.append(start)
            base.add(label)
    expressions: list[str] = []
    if tagged:
        for m in _EXPRESSION.finditer(raw):
            text = leading_expression(raw, m.end())
            if not text:
                continue
            tree = evaluate(text)
            expressions.append(shown(tree))
            labels |= licences(tree)
            doubt *= 0.05
    spots = [line.count(" ", 0, p) for p in (min(places), max(places))] if places else [None, None]
    return len(words), len(places), spots[0], spots[1], ",".join(sorted(base)), ",".join(sorted(labels)), 1 - doubt, expressions


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (0 to 1), expressions.

    Words are runs of 0-9, a-z (A-Z lowered) and non-ASCII characters. n_base
    counts all places of BASE phrases, first_word and last_word are the least and
    greatest word at which one starts (null without any). Of what
    follows a tag the longest valid expression at its start counts. Null counts as empty; doc_id may be null or
    repeated; other columns are not looked at.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string())]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t.as_py() or b"") for t in batch.column(1).cast(pa.large_binary())]
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>")
