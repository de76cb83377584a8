"""A small language of conditions on terms: `=x` is, `^x` begins with, `x$` ends
with, `x` holds, `!x`, `!^x`, `!x$` the contrary; a space is AND, `|` is OR.
Both sides are lower-cased."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_token(token: str) -> tuple[str, str, bool]:
    """(operator, text, whether it is denied) of one word."""
    if token.startswith("!^"):
        return "prefix", token[2:], True
    if token.startswith("!"):
        return ("suffix", token[1:-1], True) if token.endswith("$") and len(token) > 2 else ("contains", token[1:], True)
    if token[:1] == "=":
        return "exact", token[1:], False
    if token[:1] == "^":
        return "prefix", token[1:], False
    return ("suffix", token[:-1], False) if token.endswith("$") else ("contains", token, False)


def parse(query: str) -> list[list[tuple[str, str, bool]]]:
    """Alternatives, each a list of conditions that all have to hold."""
    return [[parse_token(t) for t in part.split()] for part in query.split("|")]


def condition(query: str, term: Column) -> Column:
    """The query as a condition on a column; an alternative without words holds."""
    t = F.lower(term)

    def one(op: str, text: str, denied: bool) -> Column:
        v = F.lit(text.lower())
        c = {"exact": t == v, "prefix": F.startswith(t, v), "suffix": F.endswith(t, v), "contains": F.contains(t, v)}[op]
        return ~c if denied else c

    alternatives = [reduce(lambda a, b: a & b, [one(*x) for x in part], F.lit(True)) for part in parse(query)]
    return reduce(lambda a, b: a | b, alternatives)
