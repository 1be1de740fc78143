"""Attribute values: a tagged struct, as a read's attribute may be a truth value on one row and a text on the next."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "struct<kind:tinyint,b:boolean,u:bigint,s:string>"
BOOL, UINT, BYTES = 0, 1, 2


def _make(kind: int, b=None, u=None, s=None) -> Column:
    null = lambda t: F.lit(None).cast(t)
    return F.struct(
        F.lit(kind).cast("tinyint").alias("kind"),
        (null("boolean") if b is None else b).alias("b"),
        (null("bigint") if u is None else u).alias("u"),
        (null("string") if s is None else s).alias("s"),
    )


def of_bool(c: Column) -> Column:
    return _make(BOOL, b=c)


def of_uint(c: Column) -> Column:
    return _make(UINT, u=c.cast("bigint"))


def of_bytes(c: Column) -> Column:
    return _make(BYTES, s=c)


def literal(value: bool | int | str) -> Column:
    if isinstance(value, bool):
        return of_bool(F.lit(value))
    if isinstance(value, int):
        if value < 0:
            raise ValueError("attribute numbers are not negative")
        return of_uint(F.lit(value))
    return of_bytes(F.lit(value))


def absent() -> Column:
    return F.lit(None).cast(TYPE)


def as_bool(a: Column) -> Column:
    """A number counts as true above 0, a text if it is not empty, be it "false"."""
    return F.when(a.kind == BOOL, a.b).when(a.kind == UINT, a.u > 0).otherwise(F.length(a.s) > 0)


def as_uint(a: Column) -> Column:
    """Null for a text."""
    return F.when(a.kind == BOOL, a.b.cast("bigint")).when(a.kind == UINT, a.u)


def as_text(a: Column) -> Column:
    return F.when(a.kind == BOOL, F.when(a.b, F.lit("true")).otherwise(F.lit("false"))).when(a.kind == UINT, a.u.cast("string")).otherwise(a.s)


def text_length(a: Column) -> Column:
    """Null unless a text."""
    return F.when(a.kind == BYTES, F.length(a.s))
