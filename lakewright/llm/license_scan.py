"""Licence scans: Aho-Corasick over words and tags, and a shunting-yard parser for licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import lean, slices, utf8

#: Notice phrases (words, lower case) and the label each stands for.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Phrases whose labels come on top.
OWN_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "creative commons zero": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "reserved",
}
#: The tag that an expression follows, as text and as words.
TAG = "spdx-license-identifier:"
TAG_WORDS = "spdx license identifier"
#: Identifiers (lower case) that an expression may rest on to be permissive.
PERMISSIVE = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense", "cc0-1.0", "cc-by-4.0", "cc-by-3.0", "bsl-1.0", "0bsd", "python-2.0"})
#: Score of the strongest evidence: a parsed expression, a base phrase, another phrase or a malformed tag.
SCORES = (1.0, 0.9, 0.5)

_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_ASCII_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_BINDS = {"or": 1, "and": 2, "with": 3}


def parse(text: str, at: int = 0, end: int | None = None) -> list[str] | None:
    """The licence expression that text holds from `at`, up to `end` at most, in postfix order, lower case, or None if there is none.

    `with` binds closest, then `and`, then `or`; parentheses group. The expression ends where the
    next word cannot continue it; an operator left without its right side, and an open parenthesis, spoil it.
    """
    out: list[str] = []
    ops: list[str] = []
    want, depth = True, 0  # want: an operand comes next
    end = len(text) if end is None else end
    while m := _TOKEN.match(text, at, end):
        token = m[1].lower()
        if token == "(":
            if not want:
                break
            ops.append(token)
            depth += 1
        elif token == ")":
            if want or not depth:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
            depth -= 1
        elif token in _BINDS:
            if want:
                return None
            while ops and ops[-1] != "(" and _BINDS[ops[-1]] >= _BINDS[token]:
                out.append(ops.pop())
            ops.append(token)
            want = True
        else:
            if not want:
                break
            out.append(token.rstrip(".:"))
            want = False
        at = m.end()
    if want or depth:
        return None
    return out + ops[::-1]


def permitted(postfix: list[str], allowed: frozenset[str] = PERMISSIVE) -> bool:
    """Whether the expression leaves a choice within `allowed`: `or` needs one side, `and` both, `with` its licence."""
    stack: list[bool] = []
    for token in postfix:
        if token in _BINDS:
            b, a = stack.pop(), stack.pop()
            stack.append(a or b if token == "or" else a and b if token == "and" else a)
        else:
            stack.append(token.removesuffix("+") in allowed)
    return stack[0]


def licences(postfix: list[str]) -> list[str]:
    """The licence identifiers of an expression, without exceptions."""
    stack: list[list[str]] = []
    for token in postfix:
        if token in _BINDS:
            b, a = stack.pop(), stack.pop()
            stack.append(a if token == "with" else a + b)
        else:
            stack.append([token])
    return stack[0]


@lru_cache(maxsize=4)
def _machine(phrases: tuple[str, ...], whole_words: bool):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for p in phrases:
        machine.add_word(f" {p} " if whole_words else p, p)
    machine.make_automaton()
    return machine


def scan(text: bytes) -> tuple:
    """(n_words, base places, labels of own, [word, phrase] spans, expressions, permitted, score) of UTF-8 bytes."""
    words = text.translate(_WORDS).split()
    line = f" {b' '.join(words).decode('utf-8', 'replace')} "
    base, own, spans, tagged = [], set(), [], False
    at = blanks = 0
    found = []
    for end, phrase in _machine((*BASE_PHRASES, *OWN_PHRASES, TAG_WORDS), True).iter(line):
        found.append((end - len(phrase) - 1, phrase))
    for start, phrase in sorted(found):
        blanks += line.count(" ", at, start)  # blanks before the phrase's own: its place in words
        at = start
        if phrase == TAG_WORDS:
            tagged = True
            continue
        spans.append((blanks, phrase))
        if phrase in BASE_PHRASES:
            base.append((blanks, BASE_PHRASES[phrase]))
        else:
            own.add(OWN_PHRASES[phrase])
    expressions, allowed, malformed = [], None, False
    if tagged:
        low = text.translate(_ASCII_LOWER).decode("utf-8", "replace")
        stop = -1
        for end, _ in _machine((TAG,), False).iter(low):
            if stop <= end:  # the line's end is looked for once a line
                stop = low.find("\n", end + 1)
                stop = len(low) if stop < 0 else stop
            postfix = parse(low, end + 1, stop)
            if postfix:
                expressions.append(" ".join(postfix))
                allowed = permitted(postfix) and allowed is not False
                own.update(f"spdx:{x}" for x in licences(postfix))
            else:
                malformed = True
    score = SCORES[0] if expressions else SCORES[1] if base else SCORES[2] if own or malformed else 0.0
    return len(words), base, own, spans, expressions, allowed, score


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans, expressions, permissive.

    n_base counts all places of base phrases, first_word and last_word are the smallest and largest of their
    start words (null without any). labels add those of the other phrases and `spdx:` with each identifier of
    a parsed expression. permissive tells whether all expressions leave a permissive choice (null without one).
    Null and empty texts have no words, no labels and score 0. Repeated rows are scanned like any other, and rows without an id keep
    their null. Phrases that overlap all count. The work grows with the text, however many tags it has; other columns do not matter.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    span = pa.struct([("word", pa.int64()), ("phrase", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            data, at = data.tobytes(), offsets.tolist()
            got = [scan(data[a:b]) for a, b in zip(at, at[1:], strict=False)]
            cols = {
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array([x[0] for x in got], pa.int64()),
                "n_base": pa.array([len(x[1]) for x in got], pa.int64()),
                "first_word": pa.array([x[1][0][0] if x[1] else None for x in got], pa.int64()),
                "last_word": pa.array([x[1][-1][0] if x[1] else None for x in got], pa.int64()),
                "base_labels": pa.array([",".join(sorted({b[1] for b in x[1]})) for x in got]),
                "labels": pa.array([",".join(sorted({b[1] for b in x[1]} | x[2])) for x in got]),
                "score": pa.array([x[6] for x in got], pa.float64()),
                "spans": pa.array([[{"word": w, "phrase": p} for w, p in x[3]] for x in got], pa.list_(span)),
                "expressions": pa.array([x[4] for x in got], pa.list_(pa.string())),
                "permissive": pa.array([x[5] for x in got], pa.bool_()),
            }
            yield pa.RecordBatch.from_pydict(cols)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        lean(run),
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<word: long, phrase: string>>, expressions array<string>, permissive boolean",
    )
