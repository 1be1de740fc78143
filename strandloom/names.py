"""Names of string types, labels and attributes, and intervals' transforms between them.

``seq1.bc`` is a label of the string type ``seq1``; ``seq1.bc.hit`` an attribute of that label. Names are letters, digits,
``_`` and ``*``, at most 16 bytes; case counts. ``_`` as an output stands for a result that is not kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property, lru_cache

from .errors import ExpressionError

TYPES = ("name1", "seq1", "name2", "seq2", "index1", "index2")
_NAME = re.compile(r"[A-Za-z0-9_*]+")


def checked(name: str) -> str:
    name = name.strip()
    if not _NAME.fullmatch(name):
        raise ExpressionError(f"{name!r} is no name: letters, digits, _ and * only")
    if len(name) > 16:
        raise ExpressionError(f"{name!r} is longer than 16 bytes")
    return name


def checked_type(name: str) -> str:
    if checked(name) not in TYPES:
        raise ExpressionError(f"{name!r} is no string type; there are {', '.join(TYPES)}")
    return name.strip()


@dataclass(frozen=True)
class Label:
    type: str
    label: str

    def __str__(self) -> str:
        return f"{self.type}.{self.label}"

    @property
    def whole(self) -> bool:
        """Whether the label spans its string by definition."""
        return self.label == "*"


@dataclass(frozen=True)
class Attr:
    type: str
    label: str
    attr: str

    def __str__(self) -> str:
        return f"{self.type}.{self.label}.{self.attr}"

    @cached_property
    def of(self) -> Label:
        return Label(self.type, self.label)


def parse_name(text: str | Label | Attr) -> Label | Attr:
    return text if isinstance(text, (Label, Attr)) else _parsed(text)


@lru_cache(4096)
def _parsed(text: str) -> Label | Attr:
    """User functions give the same few names for every read."""
    parts = text.split(".")
    if len(parts) not in (2, 3):
        raise ExpressionError(f"{text!r} is neither type.label nor type.label.attribute")
    kind = checked_type(parts[0])
    return Label(kind, checked(parts[1])) if len(parts) == 2 else Attr(kind, checked(parts[1]), checked(parts[2]))


@lru_cache(4096)
def label(text: str | Label) -> Label:
    got = parse_name(text)
    if not isinstance(got, Label):
        raise ExpressionError(f"{text!r} is an attribute where a label is asked for")
    return got


@lru_cache(4096)
def attr(text: str | Attr) -> Attr:
    got = parse_name(text)
    if not isinstance(got, Attr):
        raise ExpressionError(f"{text!r} is a label where an attribute is asked for")
    return got


@dataclass(frozen=True)
class Transform:
    """Labels that are read and labels or attributes (None: not kept) that are made of them."""

    inputs: tuple[Label, ...]
    outputs: tuple[Label | Attr | None, ...]

    def expect(self, n_in: int, n_out: int, attrs: bool = False) -> Transform:
        if len(self.inputs) != n_in or len(self.outputs) != n_out:
            raise ExpressionError(f"this operation maps {n_in} to {n_out} names, not {len(self.inputs)} to {len(self.outputs)}")
        want = Attr if attrs else Label
        if any(o is not None and not isinstance(o, want) for o in self.outputs):
            raise ExpressionError(f"this operation makes {'attributes' if attrs else 'labels'}")
        kinds = {x.type for x in (*self.inputs, *self.outputs) if x is not None}
        if len(kinds) > 1:
            raise ExpressionError(f"all names must be of one string type, not of {', '.join(sorted(kinds))}")
        return self


def tr(text: str | Transform) -> Transform:
    """``in1, in2 -> out1, _, out3``"""
    if isinstance(text, Transform):
        return text
    before, arrow, after = text.partition("->")
    if not arrow:
        raise ExpressionError(f"{text!r} has no ->")
    outs = [o.strip() for o in after.split(",")]
    return Transform(tuple(label(x) for x in before.split(",")), tuple(None if o and not o.strip("_") else parse_name(o) for o in outs))
