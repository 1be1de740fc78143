"""Reads: a lazy chain of operations on labelled strings, each a step of a Spark plan.

Every operation takes a selector first; reads that it does not select pass unchanged. Nothing runs until a sink, a count or
a result is asked for by :meth:`Reads.run` or :meth:`Reads.collect`.
"""

from __future__ import annotations

import sys
import time as clock
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from .errors import ExpressionError, ReadNameError
from .functions import values
from .functions.selector import Every, Node, sel
from .functions.template import template
from .names import Attr, Label, Transform, attr, label, parse_name, tr
from .operators import intervals, matching, patterns, polyx, regexes
from .operators.patterns import MatchType, Patterns
from .plans.compiler import Compiler, fail
from .plans.schema import Schema
from .record import Read, Strand


@dataclass(frozen=True)
class End:
    """So many bytes of a label's left or right end."""

    n: int
    left: bool

    def __post_init__(self):
        if self.n < 0:
            raise ExpressionError("an end has no negative length")


def left_end(n: int) -> End:
    return End(n, True)


def right_end(n: int) -> End:
    return End(n, False)


def bounds(x: range | tuple[int | None, int | None]) -> tuple[int | None, int | None]:
    """First and last (None: open) of a range, or of an inclusive pair."""
    if isinstance(x, range):
        if x.step != 1:
            raise ExpressionError("a range of bounds goes by ones")
        return x.start, x.stop - 1
    return x


def within(c: Column, x: range | tuple[int | None, int | None]) -> Column:
    low, high = bounds(x)
    out = F.lit(True)
    if low is not None:
        out = c >= low
    if high is not None:
        out = (out & (c <= high)) if low is not None else c <= high
    return out


def pinned(c: Column) -> Column:
    """The same, but non-deterministic to the optimiser, in a way that it cannot fold: filters are not pushed below it and
    steps are not merged. Each step names its inputs several times, so an expression that is pushed through a chain of them
    would grow with the power of its length."""
    return F.when(F.spark_partition_id() >= 0, c)


@dataclass(frozen=True)
class Reads:
    df: DataFrame
    schema: Schema
    effects: tuple = ()  #: what run() does besides: sinks and observers, in order
    held: tuple = ()  #: frames that forks keep

    # making

    @classmethod
    def from_dataframe(cls, df: DataFrame, idx: str | Column | None = None, origin: str | Column = "table", **strings: str | Column) -> Reads:
        """Columns as strings: ``name1=...``, ``seq1=...``, ``qual1=...`` and so on; ``idx`` numbers the reads (null without)."""
        col = lambda c: F.col(c) if isinstance(c, str) else c
        made, types = [], {}
        number = F.lit(None).cast("bigint") if idx is None else col(idx).cast("bigint")
        number2 = strings.pop("idx2", None)
        start = F.lit(origin) if isinstance(origin, str) else origin
        quals = {k: strings.pop(k) for k in [*strings] if k.startswith("qual")}
        for kind, c in strings.items():
            label(f"{kind}.*")
            qual = quals.pop("qual" + kind[3:], None) if kind.startswith("seq") else None
            own = number if number2 is None or not kind.endswith("2") else col(number2).cast("bigint")
            types[kind] = qual is not None
            q = F.lit(None).cast("string") if qual is None else col(qual).cast("string")
            made.append(F.struct(col(c).cast("string").alias("str"), q.alias("qual"), start.alias("origin"), own.alias("idx")).alias(Schema.column(kind)))
        if quals or not types:
            raise ExpressionError(f"no string for {', '.join(quals)}" if quals else "reads need a string")
        return cls(df.select(*made), Schema(types))

    @classmethod
    def fastq1(cls, spark: SparkSession, path: str) -> Reads:
        """Single reads of a file, a folder or a glob."""
        from .sources.fastq import load

        return load(spark, path, "single")

    @classmethod
    def fastq_interleaved(cls, spark: SparkSession, path: str) -> Reads:
        from .sources.fastq import load

        return load(spark, path, "interleaved")

    @classmethod
    def fastq2(cls, spark: SparkSession, path1: str, path2: str) -> Reads:
        from .sources.fastq import load

        return load(spark, path1, "paired", path2)

    @classmethod
    def fastq1_bytes(cls, spark: SparkSession, data: bytes) -> Reads:
        from .sources.fastq import from_bytes

        return from_bytes(spark, data, "single")

    @classmethod
    def fastq_interleaved_bytes(cls, spark: SparkSession, data: bytes) -> Reads:
        from .sources.fastq import from_bytes

        return from_bytes(spark, data, "interleaved")

    # helpers

    @property
    def _c(self) -> Compiler:
        return Compiler(self.schema)

    def _guarded(self, chosen: Column | None, checks: list[tuple[Column, str]]) -> DataFrame:
        """The frame, failing where a check holds on a selected read."""
        if not checks:
            return self.df
        out = F.lit(True)
        for bad, say in reversed(checks):
            out = F.when(bad, fail(say).cast("boolean")).otherwise(out)
        return self.df.where(out if chosen is None else F.when(chosen, out).otherwise(True))

    def _missing(self, *names: Label) -> list[tuple[Column, str]]:
        got = [(self._c.present(x), x) for x in names]
        return [(~p, f"{x} is not in the read") for p, x in got if p is not None]

    def _label(self, schema: Schema, x: Label, value: Column, chosen: Column | None, fires: Column | None) -> tuple[Schema, Column, list]:
        """A label's column once ``value`` is put where selected and fired; with the check that it is new there."""
        if x.whole:
            raise ReadNameError(f"{x} is in every read already")
        both = [c for c in (chosen, fires) if c is not None]
        where = None if not both else both[0] if len(both) == 1 else F.when(both[0], both[1]).otherwise(False)
        old = F.col(self.schema.labels[x]) if x in self.schema.labels else None
        if old is None:
            got = value if where is None else F.when(where, value)
            return schema.with_label(x, where is None), got, []
        there = old.isNotNull() if where is None else old.isNotNull() & where
        got = value if where is None else F.when(where, value).otherwise(old)
        return schema.with_label(x, where is None or x in self.schema.sure), got, [(there, f"{x} is in the read already")]

    def _attr(self, schema: Schema, x: Attr, value: Column, where: Column | None) -> tuple[Schema, Column]:
        old = F.col(self.schema.attrs[x]) if x in self.schema.attrs else values.absent()
        return schema.with_attr(x), (value if where is None else F.when(where, value).otherwise(old))

    def _put(self, chosen: Column | None, checks: list, labels: list[tuple[Label | None, Column, Column | None]], attrs: list[tuple[Attr, Column, Column | None]] = (), df: DataFrame | None = None) -> Reads:
        """New labels (name, interval, where it fires) and attributes, all from the columns as they were."""
        schema, cols, seen = self.schema, {}, list(checks)
        for x, value, fires in labels:
            if x is not None:
                if any(x == y for y, _, _ in labels if y is not None and y is not x):
                    raise ReadNameError(f"{x} is made twice")
                schema, got, bad = self._label(schema, x, value, chosen, fires)
                cols[schema.labels[x]] = pinned(got)
                seen += bad
        for x, value, where in attrs:
            schema, got = self._attr(schema, x, value, where)
            cols[schema.attrs[x]] = got
        base = self if df is None else replace(self, df=df)
        return replace(self, df=base._guarded(chosen, seen).withColumns(cols) if cols else base._guarded(chosen, seen), schema=schema)

    # rows

    def retain(self, selector: str | Node = "") -> Reads:
        """The selected reads."""
        chosen = self._c.selected(sel(selector))
        return self if chosen is None else replace(self, df=self.df.where(chosen))

    def _first_idx(self) -> Column:
        idx = [F.col(Schema.column(k)).idx for k in self.schema.types]
        return F.least(*idx) if len(idx) > 1 else idx[0]

    def take(self, span: range | tuple[int | None, int | None]) -> Reads:
        """The reads whose (first) index in the source is in a range; not a limit."""
        return replace(self, df=self.df.where(within(self._first_idx(), span)))

    # labels

    def cut(self, selector: str | Node, names: str | Transform, end: End) -> Reads:
        """Two labels of one: an end of it and the rest."""
        x = tr(names).expect(1, 2)
        one, two = intervals.cut(self._c.span(x.inputs[0]), end.n, end.left)
        return self._put(self._c.selected(sel(selector)), self._missing(*x.inputs), [(x.outputs[0], one, None), (x.outputs[1], two, None)])

    def intersect(self, selector: str | Node, names: str | Transform) -> Reads:
        """A label of what two labels share, where they share anything."""
        x = tr(names).expect(2, 1)
        got = intervals.overlap(*map(self._c.span, x.inputs))
        return self._put(self._c.selected(sel(selector)), self._missing(*x.inputs), [(x.outputs[0], got, got.isNotNull())])

    def union(self, selector: str | Node, names: str | Transform) -> Reads:
        """A label from the start of the first of two labels to the end of the last."""
        x = tr(names).expect(2, 1)
        return self._put(self._c.selected(sel(selector)), self._missing(*x.inputs), [(x.outputs[0], intervals.hull(*map(self._c.span, x.inputs)), None)])

    def trim(self, selector: str | Node, *names: str | Label) -> Reads:
        """Labels' bytes and qualities cut out, one label after the other; the labels stay, empty."""
        out = self
        node = sel(selector)
        if not isinstance(node, Every) and len(names) > 1:  # the selector is asked once, before anything moves
            mark = F.col("_chosen")
            out = replace(self, df=self.df.withColumn("_chosen", self._c.selected(node)))
            for x in names:
                out = out._replaced(mark, label(x), F.lit(""), F.lit(""), False)
            return replace(out, df=out.df.drop("_chosen"))
        for x in names:
            out = out._replaced(out._c.selected(node), label(x), F.lit(""), F.lit(""), False)
        return out

    def set(self, selector: str | Node, name: str | Label | Attr, text: str) -> Reads:
        """A label's bytes (and qualities) replaced by a filled template, or an attribute set to it."""
        x, parts = parse_name(name), template(text)
        chosen, checks = self._c.selected(sel(selector)), self._c.checks(parts)
        if isinstance(x, Attr):
            return self._put(chosen, self._missing(x.of) + checks, [], [(x, values.of_bytes(self._c.filled(parts)), chosen)])
        df = self._guarded(chosen, checks)
        qual = self._c.filled(parts, True) if self.schema.types[x.type] else F.lit("")
        return replace(self, df=df)._replaced(chosen, x, self._c.filled(parts), qual, True)

    def _replaced(self, chosen: Column | None, x: Label, text: Column, qual: Column, whole_grows: bool) -> Reads:
        """What the step names many times is bound first: the label's interval, the new bytes and where the step applies."""
        c = self._c
        string = c.strand(x.type)
        qualified = self.schema.types[x.type]
        bound = {"_a": c.span(x), "_new": text, "_qual": qual if qualified else F.lit(""), "_on": F.lit(True) if chosen is None else chosen}
        df = self._guarded(chosen, self._missing(x)).withColumns({k: pinned(v) for k, v in bound.items()})
        a, on = F.col("_a"), F.col("_on")
        put = lambda s, new: F.overlay(s, F.col(new), a.start + 1, a.len)
        new = F.struct(put(string.str, "_new").alias("str"), (put(string.qual, "_qual") if qualified else string.qual).alias("qual"), string.origin.alias("origin"), string.idx.alias("idx"))
        cols = {Schema.column(x.type): pinned(F.when(on, new).otherwise(string))}
        for name, col in self.schema.of_type(x.type).items():
            b = F.col(f"`{col}`")
            if whole_grows and not name.label.strip("*"):
                got = F.when(b.isNotNull(), intervals.interval(b.start, b.len + F.length("_new") - a.len))
            else:
                got = intervals.after_set("_a", f"`{col}`", "length(_new)")
            cols[col] = pinned(F.when(on, got).otherwise(b))
        return replace(self, df=df.withColumns(cols).drop(*bound))

    # attributes

    def length_in_bounds(self, selector: str | Node, names: str | Transform, span: range | tuple[int | None, int | None]) -> Reads:
        """An attribute: whether a label's length is in a range."""
        x = tr(names).expect(1, 1, attrs=True)
        chosen, out = self._c.selected(sel(selector)), x.outputs[0]
        checks = self._missing(*x.inputs, *([out.of] if out else []))
        value = values.of_bool(within(self._c.span(x.inputs[0]).len, span))
        return self._put(chosen, checks if out else [], [], [(out, value, chosen)] if out else [])

    def bernoulli(self, selector: str | Node, name: str | Attr, prob: float, seed: int) -> Reads:
        """An attribute that is true with a probability, by a hash of the read's index and the seed: the same however the
        reads are dealt out."""
        if not 0 <= prob <= 1:
            raise ExpressionError("a probability is from 0 to 1")
        x, chosen = attr(name), self._c.selected(sel(selector))
        digits = F.substring(F.md5(F.concat_ws(":", self._first_idx().cast("string"), F.lit(str(seed))).cast("binary")), 1, 8)
        drawn = F.conv(digits, 16, 10).cast("bigint") < F.lit(prob * 4294967296)
        return self._put(chosen, self._missing(x.of), [], [(x, values.of_bool(drawn), chosen)])

    # patterns

    def match_one(self, selector: str | Node, names: str | Transform, pattern: str, kind: MatchType) -> Reads:
        return self.match_any(selector, names, Patterns.of(None, [pattern]), kind)

    def match_any(self, selector: str | Node, names: str | Transform, pattern_list: Patterns | str, kind: MatchType) -> Reads:
        """The best of several patterns in a label: labels around and on it, and attributes that tell which it is."""
        pats = Patterns.from_yaml(pattern_list) if isinstance(pattern_list, str) else pattern_list
        x = tr(names).expect(1, kind.n_labels)
        src, c = x.inputs[0], self._c
        chosen = c.selected(sel(selector))
        checks = self._missing(src) + [y for p in pats.patterns for y in c.checks(p.template)]
        df = self._guarded(chosen, checks)
        text = c.text(src) if chosen is None else F.when(chosen, c.text(src))
        df = df.withColumn("_hit", self._found(text, pats, kind))
        hit, a = F.col("_hit"), c.span(src)
        fires = hit.isNotNull()
        end = a.start + a.len
        s, e = a.start + hit.start, a.start + hit.end
        before, on, after = intervals.interval(a.start, s - a.start), intervals.interval(s, e - s), intervals.interval(e, end - e)
        spans = {"whole": [on], "prefix": [on, after], "suffix": [before, on], "search": [before, on, after]}[kind.place]
        attrs = []
        if pats.name:
            own = values.of_bytes(hit.pattern)
            attrs.append((Attr(src.type, src.label, pats.name), F.when(fires, own).otherwise(values.of_bool(F.lit(False))), chosen))
            where = fires if chosen is None else F.when(chosen, fires).otherwise(False)
            for k in pats.attr_names:
                each = [values.literal(p.attrs[k]) for p in pats.patterns]
                attrs.append((Attr(src.type, src.label, k), F.get(F.array(*each), hit.choice), where))
        out = self._put(chosen, [], [(o, v, fires) for o, v in zip(x.outputs, spans, strict=True)], attrs, df=df)
        return replace(out, df=out.df.drop("_hit"))

    def _found(self, text: Column, pats: Patterns, kind: MatchType) -> Column:
        """struct(choice, start, end, pattern) of the match in ``text``, or null."""
        plain = [Compiler.plain(p.template) for p in pats.patterns]
        cols = [F.lit(p) if p is not None else self._c.filled(q.template) for p, q in zip(plain, pats.patterns, strict=True)]
        if kind.family == "exact":
            n, out = F.length(text), F.lit(None).cast(matching.RESULT)
            for k, p in reversed([*enumerate(cols)]):
                size = F.length(p)
                test, at = {
                    "whole": (text == p, F.lit(0)),
                    "prefix": (F.startswith(text, p), F.lit(0)),
                    "suffix": (F.endswith(text, p), n - size),
                    "search": (F.contains(text, p), F.instr(text, p) - 1),
                }[kind.place]
                got = F.struct(F.lit(k).alias("choice"), at.cast("int").alias("start"), (at + size).cast("int").alias("end"), p.alias("pattern"))
                out = F.when((size > 0) & test, got).otherwise(out)
            return out
        rows = [i for i, p in enumerate(plain) if p is None]

        @F.arrow_udf(matching.RESULT)
        def find(texts: pa.Array, *own: pa.Array) -> pa.Array:
            lists = {i: x.to_pylist() for i, x in zip(rows, own, strict=True)}
            return matching.choose(texts.to_pylist(), [lists[i] if i in lists else p for i, p in enumerate(plain)], kind)

        # told to be non-deterministic, so that later filters do not evaluate it again
        return find.asNondeterministic()(text, *[cols[i] for i in rows])

    def match_regex(self, selector: str | Node, names: str | Transform, pattern: str) -> Reads:
        """An attribute: whether a regular expression is found in a label (leftmost); named groups become labels."""
        x = tr(names).expect(1, 1, attrs=True)
        src, out, c = x.inputs[0], x.outputs[0], self._c
        groups = regexes.groups(pattern)
        chosen = c.selected(sel(selector))
        checks = self._missing(src, *([out.of] if out else []))
        text = c.text(src) if chosen is None else F.when(chosen, c.text(src))
        df = self._guarded(chosen, checks).withColumn("_hit", regexes.finder(pattern)(text))
        hit, a = F.col("_hit"), c.span(src)
        labels = []
        for i, g in enumerate(groups):
            span = F.get(hit.spans, i)
            labels.append((Label(src.type, g), intervals.interval(a.start + span.start, span.len), F.coalesce(hit.matched & (span.start >= 0), F.lit(False))))
        attrs = [(out, values.of_bool(hit.matched), chosen)] if out else []
        got = self._put(chosen, [], labels, attrs, df=df)
        return replace(got, df=got.df.drop("_hit"))

    def match_polyx(self, selector: str | Node, names: str | Transform, x: str, left: bool, identity: float) -> Reads:
        """A run of one byte at a label's end: labels of it and the rest, in order of place."""
        t = tr(names).expect(1, 2)
        src, chosen = t.inputs[0], self._c.selected(sel(selector))
        df = self.df.withColumn("_run", polyx.run_length(self._c.text(src), x, left, identity))
        a, n = self._c.span(src), F.col("_run")
        first = n if left else a.len - n
        one, two = intervals.interval(a.start, first), intervals.interval(a.start + first, a.len - first)
        got = self._put(chosen, self._missing(src), [(t.outputs[0], one, n.isNotNull()), (t.outputs[1], two, n.isNotNull())], df=df)
        return replace(got, df=got.df.drop("_run"))

    # user functions, observers

    def for_each(self, selector: str | Node, function: Callable[[Read], None], labels: list[str] = (), attrs: list[str] = ()) -> Reads:
        """A function that changes selected reads in place; labels and attributes that it makes are named here."""
        schema = self.schema
        for x in map(label, labels):
            schema = schema.with_label(x, False)
        for x in map(attr, attrs):
            schema = schema.with_attr(x)
        schema = replace(schema, sure=frozenset())  # the function may add or drop any
        chosen = self._c.selected(sel(selector))
        df = self.df.withColumn("_chosen", F.lit(True) if chosen is None else chosen)
        for c in schema.labels.values():
            df = df if c in self.df.columns else df.withColumn(c, F.lit(None).cast(intervals.TYPE))
        for c in schema.attrs.values():
            df = df if c in self.df.columns else df.withColumn(c, values.absent())
        kept = df.drop("_chosen").schema

        names = schema.columns()

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, changed = [as_tuples(batch[c]) for c in names], set()
                for i, on in enumerate(batch["_chosen"].to_pylist()):
                    if on:
                        read = to_read({c: x[i] for c, x in zip(names, rows, strict=True)}, schema)
                        function(read)
                        made = from_read(read, schema)
                        for c, x in zip(names, rows, strict=True):
                            if c in made and made[c] != x[i]:
                                x[i] = made[c]
                                changed.add(c)
                got = {c: pa.array(x, batch[c].type) for c, x in zip(names, rows, strict=True) if c in changed}
                fields = [f for f in batch.schema if f.name != "_chosen"]
                yield pa.record_batch([got[f.name] if f.name in got else batch[f.name] for f in fields], schema=pa.schema(fields))

        return replace(self, df=df.mapInArrow(apply, kept), schema=schema)

    def dbg(self, selector: str | Node = "", to=None) -> Reads:
        """Selected reads' pictures on the executors' standard error, as they pass."""

        def show(read: Read) -> None:
            print(f"{read}\n", file=to or sys.stderr)

        return self.for_each(selector, show)

    def count(self, selectors: list[str | Node], callback: Callable[[list[int]], None]) -> Reads:
        """How many of the reads that pass here each selector holds for; the callback gets the counts when the run ends."""
        watch = Observation()
        conds = [self._c.selected(sel(x)) for x in selectors]
        cols = [F.count_if(F.lit(True) if c is None else c).alias(f"n{i}") for i, c in enumerate(conds)]
        return replace(self, df=self.df.observe(watch, *cols), effects=(*self.effects, ("count", watch, len(cols), callback)))

    def time(self, callback: Callable[[float], None]) -> Reads:
        """Seconds that the steps up to here take when run by themselves; Spark fuses steps, so they cannot be timed in place."""
        return replace(self, effects=(*self.effects, ("time", self, callback)))

    def collect_fastq1(self, selector: str | Node, path: str) -> Reads:
        """Write selected reads (first mates) to the file that a template names; all reads pass on."""
        return self._sink(selector, (path,))

    def collect_fastq2(self, selector: str | Node, path1: str, path2: str) -> Reads:
        """Write both mates; interleaved where both templates give one path."""
        return self._sink(selector, (path1, path2))

    def _sink(self, selector: str | Node, paths: tuple[str, ...]) -> Reads:
        from .sources.sink import is_remote, records

        remote = {is_remote(p) for p in paths}
        if len(remote) > 1:
            raise ExpressionError("both mates go to paths of one kind, with a scheme or without")
        return replace(self, effects=(*self.effects, ("sink", records(self, selector, paths), self.df, remote.pop())))

    # running

    def transform(self, function: Callable[..., Reads], *args, **kw) -> Reads:
        """Any operation that makes reads of reads."""
        return function(self, *args, **kw)

    def boxed(self) -> Reads:
        """The same; chains are dynamic anyway."""
        return self

    def fork(self) -> tuple[Reads, Reads]:
        """Two branches of the same reads; what leads here is evaluated once. :func:`run` of both releases it; who runs
        the branches one by one calls :meth:`release` at the end."""
        shared = replace(self, df=self.df.persist(), held=(*self.held, self.df))
        return shared, replace(shared, effects=())

    def release(self) -> None:
        """Drop what forks keep for these reads' branches."""
        for df in self.held:
            df.unpersist()

    def run(self, tasks: int | None = None) -> None:
        """Do all effects; without a sink, evaluate the reads. With several things to do, the steps up to the first sink
        are evaluated once and kept meanwhile. ``tasks``: the least number of tasks that write (as far as there are paths)."""
        from .sources.sink import write

        sinks = [e for e in self.effects if e[0] == "sink"]
        counts = [e for e in self.effects if e[0] == "count"]
        kept = sinks[0][2].persist() if sinks and len(sinks) + bool(counts) > 1 else None
        try:
            for _, rows, _, remote in sinks:
                write(rows, tasks, remote)
            if not sinks or counts:
                df = self.df if tasks is None or sinks else self.df.repartition(tasks)
                df.write.format("noop").mode("overwrite").save()
        finally:
            if kept is not None:
                kept.unpersist()
        for e in self.effects:
            if e[0] == "count":
                got = e[1].get
                e[3]([int(got[f"n{i}"]) for i in range(e[2])])
            elif e[0] == "time":
                began = clock.monotonic()
                e[1].df.write.format("noop").mode("overwrite").save()
                e[2](clock.monotonic() - began)

    def run_with_threads(self, n: int) -> None:
        """Run in at least n tasks at a time, as far as the cluster has room: sinks write, and reads without a sink are
        dealt out, in n tasks."""
        if n < 1:
            raise ValueError("at least one thread")
        self.run(n)

    def collect(self) -> list[Read]:
        """All reads, in order of index, to the driver; effects are done too."""
        if self.effects:
            self.run()
        rows = [to_read(r, self.schema) for r in self.df.select(*self.schema.columns()).collect()]
        return sorted(rows, key=lambda r: min((s.idx for s in r.strands.values() if s.idx is not None), default=0))

    run_collect_reads = collect

    def flat(self, **columns: str) -> DataFrame:
        """A table: each column a template, or ``type.label:start``, ``:len`` or ``:qual``, or ``type.label.attr?`` for whether
        an attribute counts as true; null where a label or attribute is absent."""
        out = []
        for name, text in columns.items():
            head, _, tail = text.rpartition(":")
            if tail in ("start", "len") and head:
                c = self._c.span(label(head)).getField(tail).cast("bigint")
            elif tail == "qual" and head:
                c = self._c.text(label(head), True)
            elif text.endswith("?"):
                c = values.as_bool(self._c.value(attr(text[:-1])))
            elif text == "idx":
                c = self._first_idx()
            else:
                c = self._c.filled(template(text))
            out.append(c.alias(name))
        return self.df.select(*out)


def run(*branches: Reads) -> None:
    """Run several branches, one after the other, and release what their forks kept."""
    try:
        for b in branches:
            b.run()
    finally:
        for b in branches:
            b.release()


def run_with_threads(n: int, *branches: Reads) -> None:
    """Run several branches side by side, each in at least n tasks at a time."""
    try:
        with ThreadPoolExecutor(max(1, len(branches)), initializer=_in_session, initargs=branches[:1]) as pool:
            for done in [pool.submit(b.run_with_threads, n) for b in branches]:
                done.result()
    finally:
        for b in branches:
            b.release()


def _in_session(reads: Reads) -> None:
    """Make this thread's session that of the reads, by which Spark looks up the FASTQ writer."""
    spark = reads.df.sparkSession
    type(spark)._get_j_spark_session_class(spark._jvm).setActiveSession(spark._jsparkSession)


def as_tuples(column: pa.StructArray) -> list[tuple | None]:
    """The rows of a string, label or attribute column."""
    if column.null_count == len(column):
        return [None] * len(column)
    rows = list(zip(*map(_listed, column.flatten()), strict=True))
    return [r if there else None for r, there in zip(rows, column.is_valid().to_pylist(), strict=True)] if column.null_count else rows


def _listed(x: pa.Array) -> list:
    """``to_pylist`` by way of numpy, many times as fast, where that has the same values."""
    if x.null_count == len(x):
        return [None] * len(x)
    return x.to_pylist() if x.null_count and x.type != pa.string() else x.to_numpy(zero_copy_only=False).tolist()


def to_read(row: Mapping[str, tuple | None] | Row, schema: Schema) -> Read:
    strands = {kind: Strand(*row[Schema.column(kind)]) for kind in schema.types}
    for x, c in schema.labels.items():
        if (span := row[c]) is not None:
            strands[x.type].labels[x.label] = list(span)
    for x, c in schema.attrs.items():
        if (v := row[c]) is not None:
            strands[x.type].attrs[x.label, x.attr] = v[1 + v[0]]
    return Read(strands)


def from_read(read: Read, schema: Schema) -> dict[str, tuple | None]:
    out, left = {}, 0  # left: names that the schema's have not met
    for kind, s in read.strands.items():
        out[Schema.column(kind)] = s.text, s.qual, s.origin, s.idx
        left += len(s.labels) + len(s.attrs)
    for x, c in schema.labels.items():
        span = read.strands[x.type].labels.get(x.label)
        left -= span is not None
        out[c] = None if span is None else tuple(span)
    for x, c in schema.attrs.items():
        v = read.strands[x.type].attrs.get((x.label, x.attr))
        left -= v is not None
        kind = 0 if isinstance(v, bool) else 1 if isinstance(v, int) else 2
        out[c] = None if v is None else (kind, v if kind == 0 else None, v if kind == 1 else None, v if kind == 2 else None)
    if left:
        _all_named(read, schema)
    return out


def _all_named(read: Read, schema: Schema) -> None:
    for kind, s in read.strands.items():
        for name in s.labels:
            if Label(kind, name) not in schema.labels:
                raise ReadNameError(f"{kind}.{name} was not named as a label that the function makes")
        for lb, a in s.attrs:
            if Attr(kind, lb, a) not in schema.attrs:
                raise ReadNameError(f"{kind}.{lb}.{a} was not named as an attribute that the function makes")
