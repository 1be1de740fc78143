"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints within ``radius`` differing bits are linked, all of them. Each of the 64 bits has a non-zero vector of
radius + 1 binary digits; each non-zero vector v gives a mask of the bits whose vector has an odd product with v. The
vectors of at most ``radius`` differing bits cannot span all, so some v is orthogonal to each of them and its mask leaves
all of them out: the pair agrees under that mask for certain. 31 masks serve radius 4.

Equal fingerprints are merged first. Each distinct one goes to a bucket for each mask; a bucket's fingerprints are
compared as a block of numbers and linked to the least of their local group, so a bucket emits fewer links than it has
members. A bucket beyond ``WHOLE`` members is not compared: its members emit all points within radius/2 bits among those
that the mask leaves free; two are within the radius just when they share such a point, and a point has few members.

Defined results: a null text counts as empty; a text without words has fingerprint 0 and is linked like any other; repeated
rows and ids share a component; a null id is passed over when the smallest id is chosen.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, free_name, give_back, save
from .components import components

WIDTH, SEED, RADIUS, WHOLE = 4, 42, 4, 16384


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """64 bits: each is 1 where over half the hashes of the text's shingles have it set."""
    tokens = text.lower().split()  # of bytes: A-Z and ASCII white space alone
    if not tokens:
        return 0
    joined, h = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= width:
        return h(joined, seed)
    ends = [*accumulate([len(t) + 1 for t in tokens])]
    hashes = np.array([h(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[width - 1 :], strict=False)], np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def masks(radius: int = RADIUS) -> list[int]:
    top = 1 << (radius + 1)
    vector = [1 + (i * 11) % (top - 1) for i in range(64)]
    return [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() % 2) for v in range(1, top)]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED, hashed: bool = False) -> DataFrame:
    """id and fp (the 64 bits as a signed number) of every row, and h (a hash of the text) if asked."""

    @F.arrow_udf("bigint")
    def make(texts: pa.Array) -> pa.Array:
        got = np.array([fingerprint(t, width, seed) for t in texts.cast(pa.binary()).to_pylist()], np.uint64)
        give_back()
        return pa.array(got.view(np.int64))

    return documents(df, id_col, text_col).select("id", make("text").alias("fp"), *[F.xxhash64("text").alias("h")] * hashed)


def local_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ascending fingerprints: each but the least of its group, and that least, the groups by links among them."""
    bits = fps.view(np.uint64)
    left, a, b = np.arange(len(fps)), [], []
    while len(left):
        group, edge, left = [left[0]], [left[0]], left[1:]
        while edge and len(left):
            near = np.bitwise_count(bits[left] ^ bits[edge.pop()]) <= radius
            group += (found := left[near].tolist())
            edge += found
            left = left[~near]
        if len(group) > 1:
            a += group[1:]
            b += [group[0]] * (len(group) - 1)
    return fps[np.array(a, np.int64)], fps[np.array(b, np.int64)]


def _groups(batches, key: tuple[str, ...], most: int):
    """(key, values, whole) of each run of equal keys in sorted rows; a run beyond ``most`` comes in parts, not whole."""
    now, parts, size, split = None, [], 0, False
    for batch in batches:
        cols = [batch[k].to_numpy(zero_copy_only=False) for k in key]
        fps = batch["fp"].to_numpy(zero_copy_only=False)
        if not len(fps):
            continue
        new = np.zeros(len(fps), bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), len(fps)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            k = tuple(int(c[s]) for c in cols)
            if k != now:
                if parts:
                    yield now, np.concatenate(parts), not split
                now, parts, size, split = k, [], 0, False
            parts.append(fps[s:e])
            size += e - s
            if size > most:
                yield now, np.concatenate(parts), False
                parts, size, split = [], 0, True
    if parts:
        yield now, np.concatenate(parts), not split


def _links(a: np.ndarray, b: np.ndarray, mask=None) -> pa.RecordBatch:
    mask = np.full(len(a), -1, np.int32) if mask is None else mask
    return pa.record_batch({"a": a, "b": b, "mask": mask})


def links(fps: DataFrame, radius: int = RADIUS, whole: int = WHOLE) -> DataFrame:
    """``fps``: distinct fp. Links (a, b) that join exactly what the links within ``radius`` join."""
    table = masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in table]
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(signed)]))
    spread = fps.select("fp", rows.alias("k")).select("k.mask", "k.value", "fp")

    def compare(batches):
        out_a, out_b, n = [], [], 0
        for (mask, _), group, complete in _groups(batches, ("mask", "value"), whole):
            if not complete:
                yield _links(group, group, np.full(len(group), mask, np.int32))
                continue
            if len(group) > 1:
                a, b = local_links(np.sort(group), radius)
                out_a.append(a), out_b.append(b)
                n += len(a)
                if n > 50_000:
                    yield _links(np.concatenate(out_a), np.concatenate(out_b))
                    out_a, out_b, n = [], [], 0
        if n:
            yield _links(np.concatenate(out_a), np.concatenate(out_b))

    dealt = spread.repartition("mask", "value").sortWithinPartitions("mask", "value")
    found = save(dealt.mapInArrow(compare, "a bigint, b bigint, mask int"))
    plain = found.where("mask < 0").select("a", "b")
    large = found.where("mask >= 0").select("mask", F.col("a").alias("fp"))
    if large.isEmpty():
        return plain

    def points(batches):
        for batch in batches:
            for mask, fp in zip(batch["mask"].to_pylist(), batch["fp"].to_pylist(), strict=True):
                free = [1 << i for i in range(64) if not table[mask] >> i & 1]
                flips = [sum(c) for k in range(radius // 2 + 1) for c in combinations(free, k)]
                at = (np.array(flips, np.uint64) ^ np.uint64(fp % (1 << 64))).view(np.int64)
                yield pa.record_batch({"mask": np.full(len(at), mask, np.int32), "value": at, "fp": np.full(len(at), fp, np.int64)})

    def stars(batches):
        for _, group, _ in _groups(batches, ("mask", "value"), whole):
            if len(group) > 1:
                yield _links(group[1:], np.full(len(group) - 1, group[0], np.int64))

    if radius % 2:
        raise ValueError("an odd radius has no middle point; use an even one")
    near = large.mapInArrow(points, "mask int, value bigint, fp bigint").repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
    return plain.union(near.mapInArrow(stars, "a bigint, b bigint, mask int").select("a", "b"))


def _rooted(least: DataFrame, radius: int) -> DataFrame:
    """Distinct fp and what is least among its rows, with the fp that names its component."""
    roots = components(links(least.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    return least.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """id, fp and component_id (the smallest id that links reach) of every row."""
    docs = save(fingerprints(df, id_col, text_col, width, seed))
    named = save(_rooted(docs.groupBy("fp").agg(F.min("id").alias("least")), radius))
    ids = save(named.groupBy("root").agg(F.min("least").alias("component_id")))  # written: a root of many can then be split
    of = save(named.select("fp", "root").join(ids, "root").select("fp", "component_id"))
    return docs.join(of, "fp").select("id", "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """One row of ``df`` for each component: that of the smallest id (null ids last), of rows that repeat it that of the
    smallest hash of its text, of rows equal in both any one."""
    key, text = F.col(f"`{id_col}`"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    docs = save(fingerprints(df, id_col, text_col, width, seed, hashed=True))
    rows = docs.groupBy("fp", "id", "h").agg(F.count("*").alias("n"))
    least = save(rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("lost"), "id", "h", "n")).alias("least")))
    first = save(_rooted(least, radius).groupBy("root").agg(F.min("least").alias("l")).select(F.col("l.id").alias("_keep"), F.col("l.h").alias("_h"), "l.n"))
    keep, h = free_name(df, "_keep"), free_name(df, "_h")
    first = first.withColumnsRenamed({"_keep": keep, "_h": h})
    match = key.eqNullSafe(F.col(keep)) & (text == F.col(h))
    once = df.join(first.where("n = 1").drop("n"), match, "left_semi")
    if first.where("n > 1").isEmpty():
        return once
    more = df.join(first.where("n > 1").drop("n"), match, "left_semi")
    hashed = more.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), key.alias("_id"), text.alias("_t"))
    one = hashed.dropDuplicates(["_id", "_t"])
    return once.unionByName(one.select(*[F.col("row").getField(c).alias(c) for c in df.columns]))
