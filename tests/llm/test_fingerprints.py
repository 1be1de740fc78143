import random

import xxhash
from pyspark.sql import functions as F

from strandloom.llm import fingerprints as fp


def xx(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.to_bytes(8, "little"), seed)
    return seed


def plain(text, width=5):
    """Distinct shingle hashes, unsigned."""
    import re

    w = [xx([x.encode()]) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    runs = [w[i : i + width] for i in range(len(w) - width + 1)] if len(w) >= width else [w] if w else []
    return {xx(r) for r in runs}


def low(hashes):
    return {x for x in hashes if x < (1 << 64) // fp.DIVISOR}


def retained(hashes):
    return low(hashes) or ({min(hashes)} if hashes else set())


def sketch(text):
    return retained(plain(text))


def likeness(a, b):
    x, y = low(a), low(b)
    return len(x & y) / len(x | y) if x | y else float(a == b)


def test_sketches_hold_what_lies_below_the_threshold(table, odd):
    r = random.Random(1)
    texts = odd + [" ".join(r.choice("abcdefghij") * 3 for _ in range(400)) for _ in range(3)]
    rows = {x.id: x for x in fp.fingerprint(table(texts)).collect()}
    for i, t in enumerate(texts):
        assert {h % (1 << 64) for h in rows[i].sketch} == sketch(t) and rows[i].sketch == sorted(rows[i].sketch)
        assert (len(rows[i].sketch) == 0) == (not (t or "").split())


def test_next_rows_and_likeness(table, odd):
    texts = odd + ["one two three four five six"] * 2
    ids = [7 * i - 20 for i in range(len(texts))]
    for buckets in (1, 4, 64):
        got = fp.with_next(fp.fingerprint(table(texts, ids)), "id", ["text", "sketch"], buckets)
        rows = {r.id: r for r in got.select("id", "next_text", fp.likeness(F.col("sketch"), F.col("next_sketch")).alias("x")).collect()}
        assert len(rows) == len(texts)
        for k, i in enumerate(ids):
            after = texts[(k + 1) % len(texts)]
            assert rows[i].next_text == (after or "")
            assert abs(rows[i].x - likeness(sketch(texts[k]), sketch(after))) < 1e-12


def test_one_row_none_and_null_ids(table):
    assert fp.with_next(fp.fingerprint(table(["x"])), "id", ["text"]).first().next_text == "x"
    assert fp.with_next(fp.fingerprint(table([])), "id", ["text"]).count() == 0
    got = fp.with_next(fp.fingerprint(table(["a", "b", "c"], [None, 5, 5])), "id", ["text"]).collect()
    assert sorted((r.id is None, r.next_text) for r in got)[-1][1] in "bc" and len(got) == 3


def test_ids_of_any_type_and_repeated_ids(table):
    docs = table([f"text {i}" for i in range(60)]).withColumn("key", F.concat(F.lit("k"), F.col("doc_id").cast("string")))
    order = sorted(range(60), key=lambda i: f"k{i}")
    for ranges in (1, 7):
        got = fp.with_next(fp.fingerprint(docs, "key"), "id", ["text"], ranges)
        assert {r.id: r.next_text for r in got.collect()} == {f"k{i}": f"text {order[(k + 1) % 60]}" for k, i in enumerate(order)}
        same = fp.with_next(fp.fingerprint(table([f"t{i}" for i in range(50)], [5] * 50)), "id", ["text"], ranges).collect()
        after = {r.text: r.next_text for r in same}
        at, seen = "t0", set()
        while at not in seen:  # one circle through all rows
            seen.add(at)
            at = after[at]
        assert len(seen) == 50


def test_merged_sketches_are_those_of_the_union(spark):
    r = random.Random(4)
    sets = [[r.getrandbits(64) for _ in range(n)] for n in (0, 1, 1, 2, 3, 5, 9, 60, 300, 4000)]
    signed = lambda xs: [x - (1 << 64) if x >> 63 else x for x in xs]
    rows = [(i, j, signed(a), signed(b)) for i, a in enumerate(sets) for j, b in enumerate(sets)]
    df = spark.createDataFrame(rows, "i int, j int, a array<bigint>, b array<bigint>")
    x, y = fp.retained(F.col("a")), fp.retained(F.col("b"))
    text = fp.encoded(x)
    for row in df.select("i", "j", fp.merge(x, y).alias("m"), fp.likeness(x, y).alias("l"), x.alias("x"), fp.decoded(text).alias("d"), text.alias("t")).collect():
        a, b = set(sets[row.i]), set(sets[row.j])
        assert {h % (1 << 64) for h in row.m} == retained(a | b)
        assert abs(row.l - likeness(retained(a), retained(b))) < 1e-12
        assert row.d == row.x and len(row.t) == 16 * len(row.x)


def test_containment(table):
    a, b = " ".join(f"w{i}" for i in range(500)), " ".join(f"w{i}" for i in range(400, 3000))
    df = fp.fingerprint(table([a, b]))
    x, y = (df.where(f"id = {i}").select(F.col("sketch").alias(f"s{i}")) for i in range(2))
    assert 0.1 < x.join(y).select(fp.containment(F.col("s0"), F.col("s1")).alias("c")).first().c < 0.3
