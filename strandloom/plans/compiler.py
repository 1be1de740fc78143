"""From expressions to columns.

Checks that a read may fail go into conditions of their own, since an error in a column that nothing reads would be
pruned with it; conditions are nested CASEs, as the engine may evaluate the operands of AND in any order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ReadNameError
from ..functions import selector as s
from ..functions import template as t
from ..functions import values
from ..names import Attr, Label
from ..operators.intervals import interval
from .schema import Schema


def fail(message: str) -> Column:
    return F.raise_error(F.lit(message))


class Compiler:
    def __init__(self, schema: Schema):
        self.schema = schema

    def strand(self, kind: str) -> Column:
        if kind not in self.schema.types:
            raise ReadNameError(f"{kind} is not in the reads")
        return F.col(self.schema.column(kind))

    def span(self, x: Label) -> Column:
        """The label's interval, null where it is absent."""
        string = self.strand(x.type)
        if x.whole:
            return interval(F.lit(0), F.length(string.str))
        if x not in self.schema.labels:
            raise ReadNameError(f"{x} is not in the reads")
        return F.col(self.schema.labels[x])

    def present(self, x: Label) -> Column | None:
        """Where the label is there; None: everywhere."""
        self.span(x)
        return None if x.whole or x in self.schema.sure else F.col(self.schema.labels[x]).isNotNull()

    def value(self, x: Attr) -> Column:
        self.strand(x.type)
        if x not in self.schema.attrs:
            raise ReadNameError(f"{x} is not in the reads")
        return F.col(self.schema.attrs[x])

    def text(self, x: Label, qual: bool = False) -> Column:
        a, string = self.span(x), self.strand(x.type)
        own = string.qual if qual else string.str
        return own if x.whole else own.substr(a.start + 1, a.len)

    # selectors

    def selected(self, node: s.Node) -> Column | None:
        """Where a selector holds; None: everywhere."""
        match node:
            case s.Every():
                return None
            case s.Has(Label() as x):
                self.strand(x.type)
                if not x.whole and x not in self.schema.labels:
                    return F.lit(False)
                got = self.present(x)
                return F.lit(True) if got is None else got
            case s.Has(x):
                self.strand(x.type)
                missing = fail(f"{x} is not in the read").cast("boolean")
                if x not in self.schema.attrs:
                    return F.when(F.lit(True), missing)
                a = self.value(x)
                return F.when(a.isNull(), missing).otherwise(values.as_bool(a))
            case s.Not(x):
                return ~self._sure(x)
            case s.Both(parts) | s.Either(parts):
                out = self._sure(parts[-1])
                for x in reversed(parts[:-1]):
                    first = self._sure(x)
                    out = F.when(first, out).otherwise(False) if isinstance(node, s.Both) else F.when(first, True).otherwise(out)
                return out
        raise TypeError(node)

    def _sure(self, node: s.Node) -> Column:
        got = self.selected(node)
        return F.lit(True) if got is None else got

    # templates

    def checks(self, parts: tuple) -> list[tuple[Column, str]]:
        """Conditions under which a template cannot be filled, with what to say."""
        out: list[tuple[Column, str]] = []

        def there(x: Label | Attr) -> None:
            got = self.present(x) if isinstance(x, Label) else self.value(x).isNotNull()
            if got is not None:
                out.append((~got, f"{x} is not in the read"))

        for part in parts:
            match part:
                case t.Fill(x):
                    there(x)
                case t.Repeat(inner, times):
                    match times:
                        case t.LengthOf(x):
                            there(x)
                            if isinstance(x, Attr):
                                out.append((self.value(x).kind != values.BYTES, f"{x} is no text"))
                        case t.CountOf(x):
                            there(x)
                            out.append((self.value(x).kind == values.BYTES, f"{x} is no number"))
                    if times != 0:
                        n = self._times(times)
                        out += [(bad & (n > 0), say) for bad, say in self.checks((inner,))]
        return out

    def _times(self, times) -> Column:
        match times:
            case t.LengthOf(Label() as x):
                return self.span(x).len
            case t.LengthOf(x):
                return values.text_length(self.value(x))
            case t.CountOf(x):
                return values.as_uint(self.value(x)).cast("int")
        return F.lit(times)

    def filled(self, parts: tuple, qual: bool = False) -> Column:
        """The template's text, or with ``qual`` the qualities that go with it: a label's own, I for a label of a string
        without, and of literals and attributes their text itself."""
        cols = []
        for part in parts:
            match part:
                case t.Text(x):
                    cols.append(F.lit(x))
                case t.Fill(Label() as x):
                    if qual and self.schema.types.get(x.type):
                        cols.append(F.coalesce(self.text(x, True), F.repeat(F.lit("I"), self.span(x).len)))
                    else:
                        cols.append(F.repeat(F.lit("I"), self.span(x).len) if qual else self.text(x))
                case t.Fill(x):
                    cols.append(values.as_text(self.value(x)))
                case t.Repeat(_, 0):
                    self._times(0)
                case t.Repeat(inner, times):
                    cols.append(F.when(self._times(times) > 0, F.repeat(self.filled((inner,), qual), self._times(times))).otherwise(F.lit("")))
        return F.concat(*cols) if len(cols) > 1 else cols[0] if cols else F.lit("")

    @staticmethod
    def plain(parts: tuple) -> str | None:
        """The text of a template without anything to fill in."""
        out = ""
        for part in parts:
            match part:
                case t.Text(x):
                    out += x
                case t.Repeat(t.Text(x), int(n)):
                    out += x * n
                case _:
                    return None
        return out
