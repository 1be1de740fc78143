"""Interval arithmetic on (start, length) structs, as columns.

What becomes of an interval when another's bytes are cut out or replaced is told by where each of its ends moves.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "struct<start:int,len:int>"


def interval(start: Column, length: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), length.cast("int").alias("len"))


def cut(a: Column, n: int, from_left: bool) -> tuple[Column, Column]:
    """The n bytes of one end and the rest; in order of place."""
    size = F.least(F.lit(n), a.len)
    first = size if from_left else a.len - size
    return interval(a.start, first), interval(a.start + first, a.len - first)


def overlap(a: Column, b: Column) -> Column:
    """What both share, or null. An interval of no length inside the other, or at its start, is shared."""
    ae, be = a.start + a.len, b.start + b.len
    meets = ((b.start <= a.start) & (a.start < be)) | ((a.start <= b.start) & (b.start < ae))
    start = F.greatest(a.start, b.start)
    return F.when(meets, interval(start, F.least(ae, be) - start))


def hull(a: Column, b: Column) -> Column:
    """The least interval that has both, with any gap between them."""
    start = F.least(a.start, b.start)
    return interval(start, F.greatest(a.start + a.len, b.start + b.len) - start)


def after_set(a: str, b: str, n: str) -> Column:
    """Interval b once interval a's bytes are n others; all named in SQL, so that a step of many labels is built quickly.

    Each end of b moves by itself. Before a it stays and behind a it moves with what follows. A start within a keeps its
    distance from a's end if b reaches there, else from a's start, as far as the new bytes go; an end within a keeps its
    distance from a's start. Where b is a, it becomes all of the new bytes. No bytes (n = 0) are a trim.
    """
    s, ae, t, be = f"{a}.start", f"({a}.start + {a}.len)", f"{b}.start", f"({b}.start + {b}.len)"
    start = f"""CASE WHEN {t} < {s} THEN {t} WHEN {t} >= {ae} THEN {t} + {n} - {a}.len
        WHEN {be} >= {ae} THEN {s} + {n} - least({n}, {ae} - {t}) ELSE {s} + least({n}, {t} - {s}) END"""
    end = f"""CASE WHEN {be} > {ae} OR ({be} = {ae} AND {t} > {s}) THEN {be} + {n} - {a}.len
        WHEN {be} > {s} THEN {s} + least({n}, {be} - {s}) ELSE {be} END"""
    moved = f"named_struct('start', cast({start} AS int), 'len', cast(({end}) - ({start}) AS int))"
    return F.expr(f"CASE WHEN {b} IS NULL THEN NULL WHEN {a} = {b} THEN named_struct('start', {t}, 'len', cast({n} AS int)) ELSE {moved} END")
