"""License scan: an Aho-Corasick automaton finds identifier tags and notice phrases in one pass over each text; a
shunting-yard parser evaluates the expressions that follow identifier tags.

Words are maximal runs of digits, a-z (A-Z lower-cased) and non-ASCII characters. The automaton runs over the words
joined by one blank, so a phrase matches wherever its words stand consecutively, whatever separates them.

Nulls and edge cases: a null or empty text has no words and no labels; doc_id may be null; equal rows give equal
results; other columns are ignored. Texts are read whole, each on its own (no shuffle).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

#: Phrases and the labels they stand for.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices, each with a label of its own and how surely it names a licence.
NOTICES = {
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "bsd license": ("bsd", 0.9),
    "isc license": ("isc", 0.9),
    "boost software license": ("bsl", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "public domain": ("public-domain", 0.4),
    "cc0 1 0": ("cc0", 0.8),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "all rights reserved": ("all-rights-reserved", 0.6),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
}
BASE_WEIGHT = 0.9
TAG = "spdx license identifier"
#: What follows a tag on its line; parsing stops at the first token that cannot continue an expression.
EXPRESSION = re.compile(r"SPDX-License-Identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE)
TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+\-]*)")
#: Binding strength of the operators.
STRENGTH = {"or": 1, "and": 2, "with": 3}
#: Identifiers that start so place conditions on derived works.
COPYLEFT = ("gpl", "agpl", "lgpl", "mpl", "epl", "cc-by-sa", "cc-by-nc", "cc-by-nd")

#: Separators become blanks and A-Z become a-z; bytes from 128 on belong to words.
CANON = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, permissive boolean"


def tokens(text: str) -> list[str]:
    found, at = [], 0
    while m := TOKEN.match(text, at):
        found.append(m[1])
        at = m.end()
    return found


def postfix(infix: list[str]) -> list[str] | None:
    """Shunting yard: identifiers and operators in postfix order for the longest prefix that is an expression, or None."""
    best, depth_zero = None, 0
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in infix:
        low = token.lower()
        if operand_next:
            if low in STRENGTH or token == ")":
                break
            if token == "(":
                stack.append(token)
                depth_zero += 1
                continue
            out.append(low)
            operand_next = False
        elif low in STRENGTH:
            while stack and stack[-1] != "(" and STRENGTH[stack[-1]] >= STRENGTH[low]:
                out.append(stack.pop())
            stack.append(low)
            operand_next = True
            continue
        elif token == ")" and depth_zero:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth_zero -= 1
        else:
            break
        if not depth_zero:
            best = out + stack[::-1]
    return best


def evaluate(rpn: list[str]) -> tuple[str, set[str], bool]:
    """The expression with full parentheses, the licences in it, and whether it can be met by permissive terms alone."""
    stack: list[tuple[str, set[str], bool]] = []
    for token in rpn:
        if token not in STRENGTH:
            stack.append((token, {token}, not token.startswith(COPYLEFT)))
            continue
        right, left = stack.pop(), stack.pop()
        said = f"({left[0]} {token} {right[0]})"
        if token == "with":  # an exception narrows the licence on its left and is none itself
            stack.append((said, left[1], left[2]))
        else:
            stack.append((said, left[1] | right[1], left[2] or right[2] if token == "or" else left[2] and right[2]))
    return stack[0]


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts and places of base phrases, labels, score, expressions and whether they are permissive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for phrase in {*BASE, *NOTICES, TAG}:
            machine.add_word(f" {phrase} ", phrase)
        machine.make_automaton()
        for batch in batches:
            rows = []
            for doc_id, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = cell.as_py() or ""
                words = text.encode("utf-8", "surrogatepass").translate(CANON).split()
                joined = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
                begins: list[int] = []  # places of the blanks before each word, made at the first hit
                starts, base, labels, clear, said, permissive, tagged = [], set(), set(), 1.0, [], None, False
                for end, phrase in machine.iter(joined):
                    if phrase in BASE:
                        begins = begins or [0, *accumulate(len(w) + 1 for w in joined[1:-1].split(" "))]
                        starts.append(bisect_left(begins, end - len(phrase) - 1))
                        base.add(BASE[phrase])
                        clear *= 1 - BASE_WEIGHT
                    if phrase in NOTICES:
                        labels.add(NOTICES[phrase][0])
                        clear *= 1 - NOTICES[phrase][1]
                    tagged |= phrase == TAG
                if tagged:
                    for m in EXPRESSION.finditer(text):
                        if rpn := postfix(tokens(m[1])):
                            one, names, free = evaluate(rpn)
                            said.append(one)
                            labels |= names
                            permissive = free if permissive is None else permissive and free
                            clear = 0.0
                labels |= base
                rows.append((doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1 - clear, " | ".join(said), permissive))
            columns = list(zip(*rows, strict=True)) or [()] * 10
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
