"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch holds every shingle hash below one fixed fraction of the hash range, whatever the text's size. Unlike a sketch of
fixed size it grows with its text, so the sketches of a paragraph and of a book stay comparable, and two sketches merge
into the sketch of both texts' shingles. Where no hash lies below the threshold the sketch holds the least hash alone, so
only a text without shingles has an empty sketch; this merges too, as the least of both.

Defined results: a null text counts as empty; an empty text, or one of white space alone, has an empty sketch; a text of
fewer words than a shingle has one shingle of all its words; repeated shingles count once. Where neither sketch has a hash
below the threshold, likeness and containment are 1 for equal sketches and 0 for others; where only the first lacks them,
0. Ids may be of any type that has an order; null ids come first, and rows of equal ids follow by a hash of what they carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_upto, documents, let, shingle_hashes, words

WIDTH, DIVISOR = 5, 4
#: Rows in key order are dealt into ranges of about so many characters, at most so many ranges; cuts are the quantiles of
#: about so many sampled keys a range. The driver holds the sample.
RANGE_CHARS, MOST_RANGES, SAMPLED = 16 << 20, 16384, 8


def below(hashes: Column, divisor: int = DIVISOR) -> Column:
    """Those hashes that, taken as unsigned, lie in the first 1/divisor of the range (divisor 2 or more)."""
    top = (1 << 64) // divisor
    return F.filter(hashes, lambda h: (h >= 0) & (h < F.lit(top)) if divisor > 2 else h >= 0)


def retained(hashes: Column, divisor: int = DIVISOR) -> Column:
    """The sketch of some hashes: ascending, those below the threshold, or else the least."""
    least = lambda h: F.coalesce(F.array_min(F.filter(h, lambda x: x >= 0)), F.array_min(h))  # noqa: E731  as unsigned
    return let(
        F.array_distinct(hashes),
        lambda h: let(below(h, divisor), lambda b: F.when((F.size(b) > 0) | (F.size(h) == 0), F.sort_array(b)).otherwise(F.array(least(h)))),
    )


def sketch(text: Column, width: int = WIDTH, divisor: int = DIVISOR) -> Column:
    """array<bigint>: the distinct retained hashes of the text's shingles, ascending."""
    return retained(shingle_hashes(words(text), width), divisor)


def merge(a: Column, b: Column, divisor: int = DIVISOR) -> Column:
    """The sketch of two texts' shingles together."""
    return retained(F.concat(a, b), divisor)


def likeness(a: Column, b: Column, divisor: int = DIVISOR) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two sketches, 0 to 1."""
    x, y = below(a, divisor), below(b, divisor)
    return _ratio(F.size(F.array_intersect(x, y)), lambda both: F.size(x) + F.size(y) - both, a == b)


def containment(a: Column, b: Column, divisor: int = DIVISOR) -> Column:
    """Estimated share of a's shingles that b has too, 0 to 1; fit for texts of very unequal length."""
    x, y = below(a, divisor), below(b, divisor)
    return _ratio(F.size(F.array_intersect(x, y)), lambda _: F.size(x), a == b)


def _ratio(both: Column, of, same: Column) -> Column:
    return let(both, lambda n: F.when(of(n) == 0, F.when(same, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(n / of(n)))


def encoded(s: Column) -> Column:
    """A sketch as text, 16 hex digits a hash; :func:`decoded` gives it back, to compare or merge it."""
    return F.lower(F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def decoded(text: Column) -> Column:
    spots = F.sequence(F.lit(0), (F.char_length(text) / 16).cast("int") - 1)
    own = lambda i: F.conv(F.substring(text, 16 * i + 1, F.lit(16)), 16, -10).cast("bigint")
    return F.when(F.char_length(text) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(spots, own))


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """id, text and ``sketch`` of every document."""
    return documents(df, id_col, text_col).select("id", "text", sketch(F.col("text"), **kw).alias("sketch"))


def with_next(df: DataFrame, key: str, carried: list[str], ranges: int | None = None) -> DataFrame:
    """Each row with the ``carried`` columns of the row that follows in key order, as ``next_<column>``; after the last
    comes the first. The first of ``carried`` is text and tells how much there is.

    One shuffle: quantiles of the keys cut the rows into ranges of about equal size, and the first row of each range is
    also sent to the range before it, so no window spans all rows. The driver holds a few keys a range.
    """
    order = F.struct(F.col(key).alias("k"), F.xxhash64(carried[0]).alias("h"))
    keys = df.select(order.alias("o"), F.char_length(carried[0]).alias("n"))
    if ranges is None:
        rows, chars = keys.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        ranges = max(1, min(MOST_RANGES, -(-chars // RANGE_CHARS), rows))
    else:
        rows = df.count()
    kind = f"array<{df.select(order.alias('o')).schema['o'].dataType.simpleString()}>"
    listed = lambda xs: F.from_json(F.lit(f"[{','.join(xs)}]"), kind)  # noqa: E731  one constant, not a column a key
    share = max(1, rows // (SAMPLED * ranges))
    some = keys.where(F.pmod(F.xxhash64("o"), F.lit(share)) == 0) if share > 1 else keys
    drawn = [r[0] for r in some.select("o").distinct().orderBy("o").select(F.to_json("o", {"ignoreNullFields": "true"})).collect()] if ranges > 1 else []
    cuts = list(dict.fromkeys(drawn[len(drawn) * i // ranges] for i in range(1, ranges))) if drawn else []
    keyed = df.withColumn("_order", order)
    keyed = keyed.withColumn("_spot", count_upto(listed(cuts), F.col("_order")) if cuts else F.lit(0))
    found = keyed.groupBy("_spot").agg(F.min("_order").alias("o")).orderBy("_spot").select("_spot", F.to_json("o")).collect() if cuts else []
    home = F.struct(F.col("_spot").alias("spot"), F.lit(0).alias("guest"))
    if cuts:
        firsts, before = ["null"] * (len(cuts) + 1), [0] * (len(cuts) + 1)
        for i, (spot, first) in enumerate(found):  # the first range's row goes to the last range
            firsts[spot], before[spot] = first, found[i - 1][0]
        to = F.get(F.from_json(F.lit(str(before)), "array<int>"), F.col("_spot"))
        leads = F.get(listed(firsts), F.col("_spot")).eqNullSafe(F.col("_order"))
        both = F.array(home, F.struct(to.alias("spot"), F.lit(1).alias("guest")))
    else:
        only = df.select(order.alias("o")).agg(F.min("o").alias("o")).select(F.to_json("o")).first()[0]
        leads = F.get(listed([only or "null"]), F.lit(0)).eqNullSafe(F.col("_order"))
        both = F.array(home, F.struct(F.lit(0).alias("spot"), F.lit(1).alias("guest")))
    keyed = keyed.withColumn("_at", F.explode(F.when(leads, both).otherwise(F.array(home))))
    by = Window.partitionBy("_at.spot").orderBy(F.col("_at.guest"), F.col("_order"))
    ahead = [F.lead(c).over(by).alias(f"next_{c}") for c in carried]
    return keyed.select("*", *ahead).where("_at.guest = 0").drop("_order", "_spot", "_at")
