"""Line dedup: a deletion-neighbourhood join over all lines of all documents.

Two lines are near when at most one character (code point) is put in, taken out or changed. Taking out the character at
the place of the edit makes them equal, so each line emits its variants, one for each character left out, and itself, as
hashed keys; lines of equal keys meet and the earliest, by document id and line number, is held against the others:

* variants that left out the same place: the lines differ there alone;
* a variant and a whole line: one has a character more.

Every meeting is thus within the bound, so the least place in a group decides for all its lines and no pairs are listed;
the chosen witness is then verified by edit distance. Only lines that share a half (first or last, by length) with another
line can be near, so only those emit variants; equal lines are merged before.

Defined results: a line goes if an equal or near line stands earlier, whether that one stays or not. Lines without a word
always stay. Lines under ``min_chars`` only go for equal ones (one edit of a short line makes another line). A null text
counts as empty and stays so; a document may lose all its lines. Of rows equal in id and text one (the least by a hash of
the whole row) is the earliest, and the others lose all their lines; unequal texts under one id come in the order of their
hashes; null ids come first. A column of ``df`` named as the counts (``into``) is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, let, save

MIN_CHARS = 16
#: Lines from so many characters on emit the variants of those pieces only in which they may be near another.
LONG = 256
#: Up to so many lines that may be near others (8 bytes each) are sent to every task; beyond, lines are shuffled to them.
BROADCAST_LINES = 2_000_000


def _blank(line: Column) -> Column:
    """Looks no further than the first character of a word."""
    return F.ltrim(line, F.lit(" \t\x0b\x0c\r")) == ""


def _split(docs: DataFrame) -> DataFrame:
    key = F.struct("id", F.xxhash64("text").alias("t")).alias("doc")
    lines = docs.select(key, F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(~_blank(F.col("line")))
    return lines.select(F.struct("doc", "pos").alias("at"), "line", F.xxhash64("line").alias("h"), F.char_length("line").alias("n"))


def _halves() -> Column:
    """Hashes of what a near line of m or m + 1 characters may share: its first m/2 characters or its last m - m/2."""
    keys = []
    for m in (F.col("n"), F.col("n") - 1):
        half = F.floor(m / 2).cast("int")
        keys.append(F.xxhash64(F.lit(0), m, F.col("line").substr(F.lit(1), half)))
        keys.append(F.xxhash64(F.lit(1), m, F.col("line").substr(F.col("n") - (m - half) + 1, m - half)))
    return F.array(*keys)


def _variants(picked: DataFrame) -> DataFrame:
    """``picked``: h, n, at, line. The line (place 0) and all its variants as keys v, each with the place left out."""
    places = F.concat(F.array(F.lit(0)), F.sequence(F.lit(1), F.col("n")))
    spots = picked.select("h", "at", "n", "line", F.explode(places).alias("i"))
    left_out = F.concat(F.col("line").substr(F.lit(1), F.col("i") - 1), F.expr("substr(line, i + 1)"))
    key = F.when(F.col("i") == 0, F.xxhash64("line")).otherwise(F.xxhash64(left_out))
    return spots.select(key.alias("v"), "i", "h", "at", "n")


def _long_variants(picked: DataFrame) -> DataFrame:
    """The same for long lines, without a row for each character. A line of m or m + 1 characters is cut after each w of m,
    w about the root of m. Lines with one edit between them are equal ahead of the piece it is in, and behind that (from the
    end), so only pieces that another line shares in this way are open, and only their characters are left out one by one.
    Keys are not those of :func:`_variants`; lines of LONG characters take both ways, so each near pair shares one."""
    m, w, more = F.col("m"), F.col("w"), F.col("n") - F.col("m")
    pieces = F.sequence(F.lit(0), F.ceil(m / w).cast("int") - 1)
    size = lambda j: F.least(w, m - j * w)

    def keyed(c: Column) -> Column:
        cut = lambda d: F.transform(pieces, lambda j: F.xxhash64(F.slice(c, j * w + d + 1, size(j))))
        around = lambda x, j: (F.xxhash64(F.slice(x.a, 1, j)), F.xxhash64(F.slice(x.b, j + 2, F.size(x.b))))
        mid = lambda j: F.array_join(F.slice(c, j * w + 1, size(j) + more), "")
        one = lambda x, j: F.struct(F.xxhash64(m, j, *around(x, j)).alias("k"), (j * w).alias("base"), mid(j).alias("mid"))
        return let(F.struct(cut(F.lit(0)).alias("a"), cut(more).alias("b")), lambda x: F.transform(pieces, lambda j: one(x, j)))

    each = picked.select("h", "at", "n", "line", F.explode(F.array("n", F.col("n") - 1)).alias("m")).where("m > 0")
    each = each.withColumn("w", F.ceil(F.sqrt("m")).cast("int"))
    cut = save(each.select("h", "at", "n", "m", F.explode(let(F.split("line", ""), keyed)).alias("x")).select("h", "at", "n", "m", "x.*"))
    shared = cut.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("k")
    places = F.sequence(F.when(F.col("n") == m, 0).otherwise(1), F.char_length("mid"))
    spots = cut.join(shared, "k").select("k", "base", "mid", "h", "at", "n", F.explode(places).alias("p"))
    left_out = F.when(F.col("p") == 0, F.col("mid")).otherwise(F.expr("concat(substr(mid, 1, p - 1), substr(mid, p + 1))"))
    return spots.select(F.xxhash64("k", left_out).alias("v"), F.when(F.col("p") == 0, 0).otherwise(F.col("base") + F.col("p")).alias("i"), "h", "at", "n")


def near_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """All distinct lines (h, at: first place) and, of those, the ones (h, witness) with a near line before them."""
    keys = F.when(F.col("n") >= min_chars - 1, _halves())
    d = save(_split(docs).select("h", "at", keys.alias("k")).groupBy("h").agg(F.min("at").alias("at"), F.min("k").alias("k")))
    by_half = d.select("h", F.explode("k").alias("k"))
    shared = save(by_half.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("k"))
    some = save(by_half.join(shared, "k").select("h").distinct())
    few = some.count() <= BROADCAST_LINES
    lines = _split(docs).select("at", "line", "h", "n")
    picked = lines.join(F.broadcast(some) if few else some, "h").groupBy("h", "n").agg(F.min("at").alias("at"), F.min("line").alias("line"))
    picked = save(picked)  # several branches read it, and the documents should not be split for each
    variants = _variants(picked.where(F.col("n") <= LONG)).union(_long_variants(picked.where(F.col("n") >= LONG)))
    group, same = Window.partitionBy("v"), Window.partitionBy("v", "i")
    here = F.struct("at", "h", "i")
    met = variants.select(
        "h", "at", "n", "i",
        F.when(F.col("i") > 0, F.min(F.when(F.col("n") >= min_chars, here)).over(same)).alias("changed"),
        F.when(F.col("i") > 0, F.min(F.when(F.col("i") == 0, here)).over(group)).alias("shorter"),
        F.when(F.col("i") == 0, F.min(F.when(F.col("i") > 0, here)).over(group)).alias("longer"),
    )
    each = met.select("h", "at", "i", F.explode(F.array("changed", "shorter", "longer")).alias("by")).where("by.at < at and by.h <> h")
    found = each.groupBy("h").agg(F.min(F.struct("by", "i")).alias("x")).select("h", F.col("x.by.h").alias("w"), F.col("x.i").alias("i"), F.col("x.by.i").alias("j"))
    texts = picked.select("h", "line", "n")
    pairs = found.join(texts, "h").join(texts.select(F.col("h").alias("w"), F.col("line").alias("other"), F.col("n").alias("m")), "w")
    # the edit distance: of long lines by the places left out, after which they are equal
    without = lambda c, i: F.when(F.col(i) == 0, F.col(c)).otherwise(F.expr(f"concat(substr({c}, 1, {i} - 1), substr({c}, {i} + 1))"))
    one_edit = F.when(F.greatest("n", "m") <= LONG, F.levenshtein("line", "other", 1) == 1).otherwise(without("line", "i") == without("other", "j"))
    near = pairs.where((F.least("n", "m") >= min_chars - 1) & (F.greatest("n", "m") >= min_chars) & one_edit)
    return d.select("h", "at"), near.select("h", F.col("w").alias("witness"))


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows with ``later``: whether an equal id and text stand in a row before. Only repeated rows are dealt out."""
    same = rows.select("_i", "_h").groupBy("_i", "_h").count().where("count > 1")
    same = save(same.select(F.col("_i").alias("_ri"), F.col("_h").alias("_rh")))
    if same.isEmpty():
        return rows.withColumn("later", F.lit(False))
    match = F.col("_i").eqNullSafe(F.col("_ri")) & (F.col("_h") == F.col("_rh"))
    # written, so that the numbers are the same whenever they are read
    order = F.struct(F.xxhash64("row"), F.monotonically_increasing_id()).alias("_o")
    repeated = save(rows.join(same, match, "left_semi").select("row", "_i", "_h", order))
    first = repeated.groupBy("_i", "_h").agg(F.min("_o").alias("_f")).select("_f")
    late = repeated.join(first, F.col("_o") == F.col("_f"), "left").select("row", "_i", "_h", F.col("_f").isNull().alias("later"))
    return rows.join(same, match, "left_anti").withColumn("later", F.lit(False)).unionByName(late)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, into: str = "lines") -> DataFrame:
    """All columns of ``df``, the text without the lines that go, and a struct (n: lines with a word, removed)."""
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c != into])
    docs = documents(df, id_col, text_col)
    d, near = near_lines(docs, min_chars)
    stay = d.join(near, "h", "left_anti").select("at.doc", "at.pos").groupBy("doc").agg(F.collect_list("pos").alias("_stay"))
    stay = stay.select(F.col("doc.id").alias("_id"), F.col("doc.t").alias("_t"), "_stay")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").alias("_i"), F.xxhash64(text).alias("_h"))
    rows = _numbered(rows)
    stay = stay.withColumn("_later", F.lit(False))
    both = rows.join(stay, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_t")) & (F.col("later") == F.col("_later")), "left")
    split = both.withColumn("_l", F.split(F.coalesce(F.col("row").getField(text_col), F.lit("")), "\n"))
    blank = F.array_compact(F.transform("_l", lambda x, i: F.when(_blank(x), i)))
    split = split.withColumn("_b", blank).withColumn("_s", F.coalesce("_stay", F.array().cast("array<int>")))
    kept = F.array_join(F.transform(F.sort_array(F.array_union("_s", "_b")), lambda p: F.get("_l", p)), "\n")
    n = F.size("_l") - F.size("_b")
    info = F.struct(n.cast("bigint").alias("n"), (n - F.size("_s")).cast("bigint").alias("removed"))
    col = F.col("row")
    cut = F.when(col.getField(text_col).isNotNull(), kept)
    return split.select(*[cut.alias(c) if c == text_col else col.getField(c).alias(c) for c in df.columns], info.alias(into))
