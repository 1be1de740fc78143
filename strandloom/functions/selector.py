"""Selectors: conditions on the labels and attributes of a read.

``seq1.a`` holds where the read has the label; ``seq1.a.hit`` where the attribute counts as true (a number above 0, a text
that is not empty, whatever it says), and fails the run where it is missing. ``!`` binds tightest, then ``&``, then ``|``;
both stop at the first operand that decides, so ``seq1.a & seq1.a.hit`` never meets a missing attribute. An empty selector
selects all. Blanks may stand between tokens, not inside names; parentheses nest freely.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from ..errors import ExpressionError
from ..names import Attr, Label, parse_name


@dataclass(frozen=True)
class Every:
    """Selects all reads."""


@dataclass(frozen=True)
class Has:
    what: Label | Attr


@dataclass(frozen=True)
class Not:
    of: Node


@dataclass(frozen=True)
class Both:
    """All operands hold, asked from left to right."""

    of: tuple[Node, ...]


@dataclass(frozen=True)
class Either:
    """Some operand holds, asked from left to right."""

    of: tuple[Node, ...]


Node = Every | Has | Not | Both | Either
_TOKEN = re.compile(r"\s*([A-Za-z0-9_*.]+|[&|!()])")


def sel(text: str | Node = "") -> Node:
    return _parsed(text) if isinstance(text, str) else text


@lru_cache(4096)
def _parsed(text: str) -> Node:
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"selector {text!r}: nothing can start at {text[at:].strip()[:10]!r}")
        tokens.append(m[1])
        at = m.end()
    if not tokens:
        return Every()

    def either(i: int) -> tuple[Node, int]:
        return chain(i, "|", both, Either)

    def both(i: int) -> tuple[Node, int]:
        return chain(i, "&", single, Both)

    def chain(i, sign, part, make):
        x, i = part(i)
        got = [x]
        while i < len(tokens) and tokens[i] == sign:
            x, i = part(i + 1)
            got.append(x)
        return (got[0] if len(got) == 1 else make(tuple(got))), i

    def single(i: int) -> tuple[Node, int]:
        if i >= len(tokens):
            raise ExpressionError(f"selector {text!r} ends too soon")
        if tokens[i] == "!":
            x, i = single(i + 1)
            return Not(x), i
        if tokens[i] == "(":
            x, i = either(i + 1)
            if i >= len(tokens) or tokens[i] != ")":
                raise ExpressionError(f"selector {text!r} lacks a closing parenthesis")
            return x, i + 1
        if tokens[i] in "&|)":
            raise ExpressionError(f"selector {text!r}: {tokens[i]!r} where a name is asked for")
        return Has(parse_name(tokens[i])), i + 1

    out, end = either(0)
    if end != len(tokens):
        raise ExpressionError(f"selector {text!r}: {tokens[end]!r} is left over")
    return out
