"""Removal of long repeated byte strings by distributed prefix doubling over sampled positions.

Every byte that lies in a string of ``length`` bytes which also starts anywhere else goes. Plain prefix doubling ranks
every byte position several times, each round shuffling a row a byte. Here the strings are compared from sampled
positions: a string's anchor is the first of the least of its ``GRAM``-byte hashes, so equal strings have their anchors at
equal offsets and one position in about 170 is an anchor. The strings of one anchor are those that start from ``lo`` to
``hi`` bytes before it. Round by round, (anchor rank, rank of what surrounds it) pairs are grouped by Spark at growing
lengths; ranks are 64-bit polynomial fingerprints, so a pair is reranked by one number:

* what all of a range's strings have in common is unique: none of them repeats, the range is done;
* what they span together occurs again: all of them repeat, the range is done;
* else the range is cut into shorter ones, whose strings have more in common: 64, 337, 393 and at last 400 bytes.

So only the ends of repeated passages come down to single strings. All joins start from written tables and from counts
that were added up before the shuffle; a repeated passage of any number of copies costs a row a copy.

Defined results: a null text counts as empty and a text shorter than ``length`` loses nothing; rows equal in id and text
are documents of their own and repeat each other; a null id is an id.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, discard, documents, save

LENGTH, GRAM, CHUNK, STEPS = 400, 64, 1 << 21, (64, 8, 1)
#: Documents that a worker is given at a time.
ROWS = 1000
_MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def _random() -> tuple[np.ndarray, int]:
    r = np.random.default_rng(20)
    return r.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1), int(r.integers(1, 1 << 62)) * 4 + 3


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = _random()[1]
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Fingerprints:
    """Fingerprints of any substring of some bytes, from their prefix sums."""

    def __init__(self, data: bytes):
        size = max(CHUNK, 1 << len(data).bit_length())
        self.power, self.inverse = _powers(size)
        s = np.frombuffer(data, np.uint8)
        self.sums = np.empty(len(s) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(_random()[0][s] * self.power[: len(s)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.inverse[start]
        x ^= x >> np.uint64(29)
        return x * _MIX

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        x = (self.sums[k:] - self.sums[:n]) * self.inverse[:n] if n > 0 else np.empty(0, np.uint64)
        x ^= x >> np.uint64(29)
        return x * _MIX


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n = len(v) - w + 1
    pad = -len(v) % w
    x = np.concatenate([v, np.full(pad, v.max(initial=0), v.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(texts: list[bytes], length: int, gram: int) -> dict[str, np.ndarray]:
    """Of each anchor: its text, place in it, the least and greatest offset of its strings from it, the fingerprint of its
    gram, and that of all its strings' span."""
    w = length - gram + 1
    data = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])
    f = Fingerprints(data)
    g = f.grams(gram)
    if len(data) < length:
        e = np.empty(0, np.int64)
        return {"text": e, "at": e, "lo": e, "hi": e, "gram": e.view(np.uint64), "span": e.view(np.uint64)}
    low = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    at = (_window_min(low, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    keep = np.zeros(len(at), bool)  # strings inside one text
    for s, n in zip(base, sizes, strict=False):
        if n >= length:
            keep[s : s + n - length + 1] = True
    p = np.flatnonzero(keep)
    a = at[p]
    if not len(p):
        return anchors([], length, gram)
    text = np.searchsorted(base, p, side="right") - 1
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    a, text = a[first], text[first]
    return {"text": text, "at": a - base[text], "lo": a - p[last], "hi": a - p[first], "gram": g[a], "span": f.of(p[first], p[last] + length)}


def _chunked(batches, names: tuple[str, ...]):
    held, size = [], 0
    for batch in batches:
        texts = batch["text"].cast(pa.binary()).to_pylist()
        for i, text in enumerate(texts):
            held.append((batch, i, text))
            size += len(text)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _keys(rows: list, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    ids = pa.array([b["id"][i].as_py() for b, i, _ in rows], kind)
    return ids.take(pa.array(at))


def _decide(ranges: DataFrame, rank: list[str]) -> DataFrame:
    """The rows whose rank more than one has, with ``all``: their span occurs again, and ``open``: to be compared further.
    Open are rows whose span is alone, and one row of each other span for them to be compared to."""
    span = [*rank, "lo", "hi", "span"]
    spans = save(ranges.groupBy(*span).agg(F.count("*").alias("n"), F.min(F.struct("id", "t", "at")).alias("one")))
    ranks = save(spans.groupBy(*rank).agg(F.sum("n").alias("m"), F.min("n").alias("least")).where("m > 1"))
    alive = save(spans.join(ranks, rank).select(*span, "one", (F.col("n") > 1).alias("all"), (F.col("least") == 1).alias("more")))
    # copies of a rank may be most of the rows; both sides are written tables, so Spark can split them
    row = F.struct("id", "t", "at")
    met = save(ranges.join(alive, span).withColumn("open", F.col("more") & (~F.col("all") | row.eqNullSafe(F.col("one")))).drop("one", "more"))
    for x in (spans, ranks, alive):
        discard(x)
    return met


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs``: id, t (together naming a text) and text. Returns id, t and ``runs``: the (start, end) of repeated strings'
    ranges, all of their bytes to go, in no order; texts without any are left out."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, id_type = to_arrow_type(docs.schema["id"].dataType), docs.schema["id"].dataType.simpleString()

    def find(batches):
        for rows in _chunked(batches, ("id", "t")):
            x = anchors([t for _, _, t in rows], length, gram)
            t = np.array([b["t"][i].as_py() for b, i, _ in rows], np.int64)
            yield pa.record_batch({
                "id": _keys(rows, x["text"], kind), "t": t[x["text"]], "at": x["at"].astype(np.int32), "lo": x["lo"].astype(np.int16), "hi": x["hi"].astype(np.int16),
                "gram": x["gram"].view(np.int64), "span": x["span"].view(np.int64),
            })

    found = save(docs.mapInArrow(find, f"id {id_type}, t bigint, at int, lo short, hi short, gram bigint, span bigint"))
    met = _decide(found, ["gram"])
    discard(found)
    done = [met.where("all").select("id", "t", "at", "lo", "hi")]

    # what surrounds the anchors that are not decided, so that the texts need not be read again
    open_ = met.where("open").groupBy("id", "t").agg(F.collect_set(F.struct("at", "lo", "hi", "gram")).alias("anchors"))
    named = open_.select(F.col("id").alias("_i"), F.col("t").alias("_t"), "anchors")
    read = docs.join(named, docs.id.eqNullSafe(F.col("_i")) & (docs.t == F.col("_t"))).select("id", "t", "text", "anchors")

    def cut(batches):
        for batch in batches:
            for i, text in enumerate(batch["text"].cast(pa.binary()).to_pylist()):
                own = batch["anchors"][i].as_py()
                yield pa.record_batch({
                    "id": pa.array([batch["id"][i].as_py()] * len(own), kind), "t": pa.array([batch["t"][i].as_py()] * len(own), pa.int64()),
                    **{c: pa.array([x[c] for x in own], k) for c, k in (("at", pa.int32()), ("lo", pa.int16()), ("hi", pa.int16()), ("gram", pa.int64()))},
                    "around": pa.array([text[x["at"] - x["hi"] : x["at"] + length - x["lo"]] for x in own], pa.binary()),
                })

    head = f"id {id_type}, t bigint, at int, lo short, hi short, gram bigint"
    now = save(read.mapInArrow(cut, f"{head}, around binary"))
    for step in STEPS:

        def narrow(batches, step=step):
            for batch in batches:
                around = batch["around"].to_pylist()
                if not around:
                    continue
                base = np.concatenate([[0], np.cumsum([len(x) for x in around])]).astype(np.int64)
                f = Fingerprints(b"".join(around))
                lo, hi = batch["lo"].to_numpy().astype(np.int64), batch["hi"].to_numpy().astype(np.int64)
                n = hi // step - lo // step + 1
                row = np.repeat(np.arange(len(lo)), n)
                part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo // step, n)
                a, b = np.maximum(lo[row], part * step), np.minimum(hi[row], part * step + step - 1)
                zero = base[:-1][row] + hi[row]  # the anchor's place
                core = f.of(zero - part * step, zero + length - part * step - step + 1)
                yield pa.record_batch({
                    **{c: batch[c].take(pa.array(row)) for c in ("id", "t", "at")}, "lo": a.astype(np.int16), "hi": b.astype(np.int16), "gram": batch["gram"].take(pa.array(row)),
                    "part": part.astype(np.int16), "core": core.view(np.int64), "span": f.of(zero - b, zero + length - a).view(np.int64),
                    "around": pa.array([around[r][hi[r] - y : len(around[r]) - x + lo[r]] if step > 1 else None for r, x, y in zip(row.tolist(), a.tolist(), b.tolist())], pa.binary()),
                })

        ranges = save(now.mapInArrow(narrow, f"{head}, part short, core bigint, span bigint, around binary"))
        discard(now)
        met = _decide(ranges, ["gram", "part", "core"])
        discard(ranges)
        done.append(met.where("all").select("id", "t", "at", "lo", "hi"))
        now = met.where("open").select("id", "t", "at", "lo", "hi", "gram", "around")

    every = done[0]
    for x in done[1:]:
        every = every.union(x)
    run = F.struct((F.col("at") - F.col("hi")).alias("a"), (F.col("at") - F.col("lo") + length).alias("b"))
    return every.groupBy("id", "t").agg(F.collect_set(run).alias("runs"))


def merge_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same bytes as maximal runs, ascending."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Of every row: id, n_bytes, ``removed`` (array of start, end: maximal runs of bytes) and ``kept`` (the other bytes)."""
    if not 8 <= gram < length:
        raise ValueError("length must exceed gram, and gram be 8 or more")
    docs = documents(df, id_col, text_col).select("id", F.xxhash64("text").alias("t"), "text")
    with batches_of(df.sparkSession, ROWS):
        runs = save(repeats(docs, length, gram))
    runs = runs.select(F.col("id").alias("_i"), F.col("t").alias("_t"), "runs")
    both = docs.join(runs, docs.id.eqNullSafe(F.col("_i")) & (docs.t == F.col("_t")), "left").select("id", "text", "runs")

    @F.arrow_udf("struct<n_bytes:bigint,removed:array<struct<start:bigint,end:bigint>>,kept:binary>")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.cast(pa.binary()).to_pylist(), found.to_pylist(), strict=True):
            own = merge_runs([(x["a"], x["b"]) for x in own or ()])
            kept = [text[a:b] for a, b in zip([0, *(b for _, b in own)], [*(a for a, _ in own), len(text)], strict=True)]
            out.append({"n_bytes": len(text), "removed": [{"start": a, "end": b} for a, b in own], "kept": b"".join(kept)})
        run = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return pa.array(out, pa.struct([("n_bytes", pa.int64()), ("removed", pa.list_(run)), ("kept", pa.binary())]))

    return both.withColumn("x", cut("text", "runs")).select("id", "x.n_bytes", "x.removed", "x.kept")


def brute_force(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """The runs to remove, by a dictionary of all strings; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            key = hashlib.md5(t[p : p + length]).digest()
            seen[key] = seen.get(key, 0) + 1
    return [merge_runs([(p, p + length) for p in range(len(t) - length + 1) if seen[hashlib.md5(t[p : p + length]).digest()] > 1]) for t in texts]
