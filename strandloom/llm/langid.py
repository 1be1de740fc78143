"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent character n-grams (1 to 3, words padded by a blank), by rank. A
document's own list is compared to each profile: the out-of-place distance adds up how far each of its n-grams is from its
rank in the profile, ``depth`` for one that is not there. The least distance wins; ties go to the first name.

Profiles are counted over every training document; counts are summed for each task, then by Spark. The driver and the
tasks hold ``depth`` n-grams a language.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every text where there was
nothing to learn from. Columns of ``df`` named as the results are replaced, all others stay. Training passes over null texts and languages. The score is 1 minus the winner's distance over the
largest possible one.
"""

from __future__ import annotations

from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, give_back

DEPTH, SALTS, UNKNOWN = 300, 16, "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text, 21 bits a character, ascending, and their counts."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[a]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a = np.where(letter, a, 32).astype(np.int64)
    seen = np.concatenate([letter[:1], letter[1:] | letter[:-1]])
    a = np.concatenate([[32], a[seen], [32]])
    word = a != 32
    two = a[:-1] | (a[1:] << 21)
    three = (two[:-1] | (a[2:] << 42))[word[1:-1]]
    return np.unique(np.concatenate([a[word], two[word[1:] | word[:-1]], three]), return_counts=True)


def ranked(text: str, depth: int = DEPTH) -> np.ndarray:
    """The most frequent n-grams of a text, most frequent first, ties by code."""
    codes, counts = grams(text)
    return codes[np.argsort(-counts, kind="stable")[:depth]]


class Profiles:
    """Languages and the rank of each n-gram in each of their profiles."""

    def __init__(self, lists: dict[str, list[int]], depth: int = DEPTH):
        self.names, self.depth = sorted(lists), depth
        self.codes = np.unique(np.array([g for x in lists.values() for g in x], np.int64))
        self.ranks = np.full((len(self.names), len(self.codes) + 1), -1, np.int32)
        for row, name in zip(self.ranks, self.names, strict=True):
            row[np.searchsorted(self.codes, lists[name])] = np.arange(len(lists[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(text, self.depth) if text else ()
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, own)
        at[(at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        there = self.ranks[:, at]
        away = np.where(there < 0, self.depth, np.abs(there - np.arange(len(own)))).sum(1)
        best = int(away.argmin())
        return self.names[best], float(1 - away[best] / (self.depth * len(own)))


def _count(batches):
    held: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    size = 0

    def flush():
        for lang, counts in held.items():
            yield pa.record_batch({"lang": [lang] * len(counts), "gram": pa.array(counts.keys(), pa.int64()), "n": pa.array(counts.values(), pa.int64())})

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            counts = held[lang]
            size -= len(counts)
            for g, n in zip(*(x.tolist() for x in grams(text)), strict=True):
                counts[g] += n
            size += len(counts)
        if size > 500_000:
            yield from flush()
            held.clear()
            size = 0
    yield from flush()
    held.clear()
    give_back()


def fit(training: DataFrame, text_col: str = "text", lang_col: str = "lang", depth: int = DEPTH) -> Profiles:
    """Profiles of all languages of the training documents."""
    rows = training.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the best of each language in each of SALTS shares, so that no language is ranked in one task; the rest is merged here
    place = Window.partitionBy("lang", "salt").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS))).withColumn("r", F.row_number().over(place)).where(F.col("r") <= depth)
    lists: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for r in top.select("lang", "gram", "n").collect():  # depth * SALTS a language
        lists[r.lang].append((-r.n, r.gram))
    return Profiles({k: [g for _, g in sorted(v)[:depth]] for k, v in lists.items()}, depth)


def predict(df: DataFrame, profiles: Profiles, text_col: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``df`` with the language found and its score."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def find(texts: pa.Array) -> pa.Array:
        found = [profiles.predict(x) for x in texts.to_pylist()]
        give_back()
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], ["lang", "score"])

    name = free_name(df, "_found")
    # else a filter on the result goes below it and finds the language a second time, in workers of its own
    found = df.withColumn(name, find.asNondeterministic()(F.col(f"`{text_col}`")))
    return found.select(*[F.col(f"`{c}`") for c in df.columns if c not in into], F.col(f"`{name}`.lang").alias(into[0]), F.col(f"`{name}`.score").alias(into[1]))


def held_out(id_col: Column, mod: int = 4, rest: int = 2) -> Column:
    """Whether the CRC-32 of the id as text leaves ``rest``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod == rest
