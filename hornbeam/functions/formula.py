"""Boolean formulas over API ids, compiled to one Column; text is parsed and never evaluated."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+)|([&|()]))")


def parse(text: str) -> tuple:
    """('id', n), ('and', a, b), ('or', a, b) or ('false',) for an empty group; & binds tighter than |."""
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not a formula at {at}: {text[at:at + 20]!r}")
        tokens.append(int(m[1]) if m[1] else m[2])
        at = m.end()
    place = 0

    def peek():
        return tokens[place] if place < len(tokens) else None

    def atom():
        nonlocal place
        t = peek()
        place += 1
        if isinstance(t, int):
            return ("id", t)
        if t != "(":
            raise ValueError("a formula needs an id or a group here")
        if peek() == ")":
            place += 1
            return ("false",)
        found = some("|")
        if peek() != ")":
            raise ValueError("a group is not closed")
        place += 1
        return found

    def some(op: str):
        nonlocal place
        found = some("&") if op == "|" else atom()
        while peek() == op:
            place += 1
            found = ("or" if op == "|" else "and", found, some("&") if op == "|" else atom())
        return found

    if not tokens:
        return ("false",)
    found = some("|")
    if place != len(tokens):
        raise ValueError("something follows the formula")
    return found


def satisfied(formula: str, ids: Column) -> Column:
    """Whether a set of ids (an array) satisfies the formula. Alternatives of plain ids become one overlap test."""

    def make(t: tuple) -> Column:
        if t[0] == "false":
            return F.lit(False)
        if t[0] == "id":
            return F.array_contains(ids, t[1])
        if t[0] == "and":
            return make(t[1]) & make(t[2])
        plain, rest, todo = [], [], [t]
        while todo:
            x = todo.pop()
            if x[0] == "or":
                todo += x[1:]
            else:
                (plain if x[0] == "id" else rest).append(x)
        out = F.arrays_overlap(ids, F.array(*[F.lit(x[1]) for x in plain])) if plain else F.lit(False)
        for x in rest:
            out = out | make(x)
        return out

    return F.coalesce(make(parse(formula)), F.lit(False))


def evaluate(formula: str, ids: set[int]) -> bool:
    """The same for a Python set, for tests."""

    def run(t: tuple) -> bool:
        return {"false": lambda: False, "id": lambda: t[1] in ids, "and": lambda: run(t[1]) and run(t[2]), "or": lambda: run(t[1]) or run(t[2])}[t[0]]()

    return run(parse(formula))
