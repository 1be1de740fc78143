"""Runs of one byte at an end.

Walking in from the end, a byte equal to x counts 1, another -2; the run ends where the sum is first greatest, and is one if
that is above 0. Its identity is the number of x in the *whole* text over the run's length (so it may exceed 1).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ExpressionError

#: About so many characters are walked through at a time; one longer text by itself.
CHUNK = 1 << 20


def run_length(text: Column, x: str, left: bool, identity: float) -> Column:
    """Length of the run at the text's left or right end, or null."""
    if len(x) != 1:
        raise ExpressionError("a run is of one byte")

    @F.arrow_udf("int")
    def run(texts: pa.Array) -> pa.Array:
        return run_lengths(texts.to_pylist(), x, left, identity)

    # told to be non-deterministic, so that later filters do not evaluate it again
    return run.asNondeterministic()(text)


def run_lengths(texts: list[str | None], x: str, left: bool, identity: float) -> pa.Array:
    out, at = [pa.array([], pa.int32())], 0
    while at < len(texts):
        some, size = [], 0
        while at < len(texts) and size < CHUNK:
            some.append(texts[at] or "")
            size += len(some[-1])
            at += 1
        out.append(_walked(some, x, left, identity))
    return pa.concat_arrays(out)


def _walked(texts: list[str], x: str, left: bool, identity: float) -> pa.Array:
    """All texts in one walk, from the last text's end where runs are at the right."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    whole = "".join(texts)
    codes = np.frombuffer(whole.encode(), np.uint8) if whole.isascii() else np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    if not left:
        codes, sizes = codes[::-1], sizes[::-1]
    length, found = np.zeros(len(texts), np.int32), np.zeros(len(texts), bool)
    some = np.flatnonzero(sizes)  # an empty text has no run
    if len(some):
        size = sizes[some]
        first = np.cumsum(size) - size
        same = codes == ord(x)
        score = np.cumsum(np.where(same, 1, -2))
        best = np.maximum.reduceat(score, first)
        tops = np.flatnonzero(score == np.repeat(best, size))
        n = tops[np.searchsorted(tops, first)] - first + 1
        before = score[first] - np.where(same[first], 1, -2)
        length[some] = n
        found[some] = (best > before) & (np.add.reduceat(same, first, dtype=np.int64) / n >= identity)
    if not left:
        length, found = length[::-1], found[::-1]
    return pa.array(length, mask=~found)
