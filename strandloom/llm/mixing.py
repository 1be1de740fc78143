"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixture; dividing by its share of the corpus gives the mean number of times that its
documents are repeated. A document's count is drawn from the Poisson distribution of that mean by inverting it at a number
that a keyed hash of (seed, id) fixes, so the draw needs no state and a lost task redraws the same. Documents are exploded
by their counts and the copies are put in a global order by another keyed hash.

A source's cumulative probabilities are listed once, from where the lower tail ends, so the list grows with the root of the
rate; beyond a rate of ``PART`` a count is the sum of counts of equal smaller rates, each with a draw of its own. Counts are
found by halving.

Defined results: a null source is a source of its own; a null or empty text has size 0 but is drawn like any other document
of its source; documents that repeat an id share a draw; a source without a target weight, or of no size, has rate 0. Rates
beyond ``MOST`` fail (a document's copies are numbered in one array of 4 bytes each).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_upto, save

PART, MOST = 10_000, 10_000_000
#: Where all sources' lists together have so many numbers at most (8 bytes each), they are sent to every task; beyond, they
#: are joined with the documents salted, so that a source of any share is dealt over many tasks.
BROADCAST_STEPS, SALTS = 1_000_000, 64


def keyed_uniform(seed: str, *parts: Column) -> Column:
    """A number in (0, 1) from the first 48 bits of an MD5."""
    word = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]).cast("binary")), 1, 12), 16, 10)
    return (word.cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def _log_factorial(k: Column) -> Column:
    """ln k!: of the first numbers as they are, then by Stirling's series, exact to the last digits."""
    first = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    x = k.cast("double")
    series = 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    return F.when(k < 16, F.get(first, k)).otherwise((x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + series)


def poisson_steps(rated: DataFrame) -> DataFrame:
    """``rated``: source and rate. With ``parts`` (draws that a count is the sum of), ``low``, and ``steps``: of the rate of
    a part, the cumulative probabilities of low, low + 1, ... up to where the tail is below any number drawn."""
    rate = F.col("rate")
    sure = F.when(rate <= MOST, rate).otherwise(F.raise_error(F.lit(f"a rate is beyond {MOST}")).cast("double"))
    part = rated.withColumn("rate", sure).withColumn("parts", F.greatest(F.lit(1), F.ceil(rate / PART)).cast("int")).withColumn("part", rate / F.col("parts"))
    part = part.withColumn("low", F.greatest(F.lit(0), F.floor(F.col("part") - 12 * F.sqrt("part") - 24)).cast("int"))
    terms = F.when(F.col("part") > 0, F.sequence("low", (F.col("part") + 12 * F.sqrt("part") + 24).cast("int"))).otherwise(F.array(F.lit(0)))
    each = part.withColumn("k", F.explode(terms))
    chance = F.when(F.col("part") > 0, F.exp(F.col("k") * F.ln("part") - F.col("part") - _log_factorial(F.col("k")))).otherwise(1.0)
    so_far = Window.partitionBy("source").orderBy("k")  # a few thousand rows a source
    each = each.withColumn("p", chance).withColumn("c", F.sum("p").over(so_far))
    listed = F.array_sort(F.collect_list(F.struct("k", "c")))
    return each.groupBy("source").agg(F.first("parts").alias("parts"), F.min("k").alias("low"), listed.alias("l")).select("source", "parts", "low", F.transform("l", lambda x: x.c).alias("steps"))


def rates(df: DataFrame, source_col: str, size: Column, weights: DataFrame | None = None, total: float = 1.0) -> DataFrame:
    """``source``, ``size``, ``weight`` and ``rate`` of every source. ``weights``: columns source and weight (any scale;
    null source: the null source); None gives every source the same weight. ``total``: size of the mixture over that of the corpus."""
    sizes = df.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.sum(size).cast("double").alias("size"))
    if weights is None:
        both = sizes.withColumn("weight", F.lit(1.0))
    else:
        w = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("weight"))
        both = sizes.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source").fillna(0.0, ["weight"])
    both = save(both.withColumn("weight", F.when(F.col("size") > 0, F.col("weight")).otherwise(0.0)))
    all_size, all_weight = both.agg(F.coalesce(F.sum("size"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    rate = F.col("weight") / F.lit(all_weight) * F.lit(all_size) * F.lit(total) / F.col("size")
    return both.select("source", "size", "weight", F.when(F.col("weight") > 0, rate).otherwise(0.0).alias("rate"))


def mix(
    df: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", weights: DataFrame | None = None,
    total: float = 1.0, seed: str = "mix", ordered: bool = True,
) -> DataFrame:
    """All columns of ``df`` for each copy, with ``copy`` (0, 1, ...) and ``place`` (the key of the global order); where
    ``df`` has columns of these names, its own stay and these are left out."""
    size = F.char_length(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    table = save(poisson_steps(rates(df, source_col, size, weights, total).select("source", "rate")))
    few = (table.agg(F.sum(F.size("steps"))).first()[0] or 0) <= BROADCAST_STEPS
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{source_col}`").alias("_source"), F.col(f"`{id_col}`").alias("_id"))
    match = F.col("_source").eqNullSafe(F.col("source"))
    if few:
        drawn = row.join(F.broadcast(table), match)
    else:
        salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        drawn = row.withColumn("_mine", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")).join(salted, match & (F.col("_mine") == F.col("_salt")))
    named = F.coalesce(F.col("_id").cast("string"), F.lit("-"))
    first = F.col("low") + count_upto(F.col("steps"), F.col("_u"))
    others = F.aggregate(
        F.sequence(F.lit(2), F.greatest(F.lit(2), F.col("parts"))),
        first.cast("bigint"),
        lambda n, i: n + F.col("low") + count_upto(F.col("steps"), keyed_uniform(f"{seed}:n", named, i)),
    )
    n = F.when(F.col("parts") == 1, first.cast("bigint")).otherwise(others)
    drawn = drawn.withColumn("_u", keyed_uniform(f"{seed}:n", named)).select("row", "_id", n.alias("_n")).where("_n > 0")
    copies = drawn.select("row", "_id", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)).alias("copy"))
    place = keyed_uniform(f"{seed}:place", F.coalesce(F.col("_id").cast("string"), F.lit("-")), F.col("copy"))
    out = copies.select("row", "copy", place.alias("place"))
    out = out.orderBy("place") if ordered else out
    return out.select(*[F.col("row").getField(c).alias(c) for c in df.columns], *[c for c in ("copy", "place") if c not in df.columns])
