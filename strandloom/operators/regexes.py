"""Regular expressions with the places of named groups, which no built-in function tells."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F

from ..errors import ExpressionError
from ..names import checked

RESULT = "struct<matched:boolean,spans:array<struct<start:int,len:int>>>"


def _compiled(pattern: str) -> re.Pattern:
    """Groups are written ``(?P<name>...)`` or ``(?<name>...)``; looking around and back-references are not offered, so
    that a search takes time in proportion to the text in engines that have none."""
    if re.search(r"(?<!\\)(?:\\\\)*(\(\?<?[=!]|\\[1-9]|\(\?P=)", pattern):
        raise ExpressionError(f"{pattern!r} looks around or back, which is not supported")
    try:
        return re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern))
    except re.error as e:
        raise ExpressionError(f"{pattern!r}: {e}") from e


def groups(pattern: str) -> list[str]:
    return [checked(g) for g in _compiled(pattern).groupindex]


def finder(pattern: str):
    """A function of a text column: whether it is found, and each named group's place (start -1: took no part)."""
    names = [*_compiled(pattern).groupindex]
    span = pa.struct([("start", pa.int32()), ("len", pa.int32())])
    kind = pa.struct([("matched", pa.bool_()), ("spans", pa.list_(span))])

    @F.arrow_udf(RESULT)
    def find(texts: pa.Array) -> pa.Array:
        search, out = _compiled(pattern).search, []
        for t in texts.to_pylist():
            m = None if t is None else search(t)
            out.append({"matched": m is not None, "spans": [{"start": m.start(g), "len": m.end(g) - m.start(g)} for g in names] if m else []})
        return pa.array(out, kind)

    return find.asNondeterministic()
