"""Column arithmetic against the record's, and both against the tables of cases."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom import Reads, left_end, right_end
from strandloom.operators import intervals as iv
from strandloom.record import Read, after_set


def spans(size=7):
    return [(s, n) for s in range(size) for n in range(size - s)]


def by_cases(a, b, n):
    """The table of cases, asked in this order: how b lies to a, and what becomes of it."""
    (s, p), (t, q) = a, b
    ae, be = s + p, t + q
    if s == t and ae == be:
        return [t, n]
    if s < t and be < ae:
        start = min(t, s + n)
        return [start, min(q, s + n - start)]
    if t < s and ae < be:
        return [t, q + n - p]
    covered = "none"
    if s == t or ae == be:
        covered = "end" if (ae > be if s == t else s > t) else "start"
    elif s <= t < ae:
        covered = "start"
    elif s < be <= ae:
        covered = "end"
    if covered == "start":
        k = ae - t
        return [s, q - (k - n)] if k > n else [t + n - p, q]
    if covered == "end":
        k = be - s
        return [t, q - (k - n)] if k > n else [t, q]
    return [t + n - p, q] if ae <= t else [t, q]


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(a, b) for a in spans() for b in spans()]
    kind = "a struct<start:int,len:int>, b struct<start:int,len:int>"
    return rows, spark.createDataFrame(rows, kind)


def test_trim_and_set_agree_with_the_record(pairs):
    rows, df = pairs
    a, b = F.col("a"), F.col("b")
    cols = [iv.overlap(a, b).alias("o"), iv.hull(a, b).alias("h")]
    got = df.select("a", "b", *cols, *[iv.after_set("a", "b", str(n)).alias(f"s{n}") for n in (0, 1, 3, 9)]).collect()
    assert len(got) == len(rows)
    for r in got:
        x, y = list(r.a), list(r.b)
        for n in (0, 1, 3, 9):
            assert list(r[f"s{n}"]) == after_set(x, y, n) == by_cases(x, y, n)
        read = Read.from_fastq1("n", "ACGTACG", "0123456")
        read.add_mapping("seq1.a", *x), read.add_mapping("seq1.b", *y)
        read.union("seq1.a", "seq1.b", "seq1.u"), read.intersect("seq1.a", "seq1.b", "seq1.i")
        assert list(r.h) == read.mapping("seq1.u")
        assert (None if r.o is None else list(r.o)) == (read.mapping("seq1.i") if read.has("seq1.i") else None)


@pytest.mark.parametrize(
    "a,b,n,want",
    [((15, 5), (0, 20), 8, (0, 20)), ((0, 10), (0, 12), 12, (2, 12)), ((0, 10), (0, 12), 5, (0, 7)), ((2, 4), (3, 1), 1, (3, 0)), ((2, 4), (0, 9), 1, (0, 6)), ((2, 4), (6, 2), 9, (11, 2)), ((2, 4), (2, 4), 1, (2, 1))],
)
def test_set_by_hand(a, b, n, want):
    assert tuple(after_set(list(a), list(b), n)) == want


def test_trim_keeps_substrings_that_it_does_not_touch():
    r = random.Random(1)
    for _ in range(500):
        read = Read.from_fastq1("n", "".join(r.choice("ACGT") for _ in range(12)), "0123456789ab")
        s, n = r.randrange(12), 0
        n = r.randrange(12 - s)
        read.add_mapping("seq1.a", s, n)
        t = r.randrange(12)
        m = r.randrange(12 - t)
        read.add_mapping("seq1.b", t, m)
        whole, b = read.substring("seq1.*"), "".join(c for i, c in enumerate(read.substring("seq1.*")) if t <= i < t + m and not s <= i < s + n)
        read.trim("seq1.a")
        assert read.substring("seq1.*") == whole[:s] + whole[s + n :] and read.substring("seq1.b") == b
        assert len(read.strand("seq1").qual) == len(read.substring("seq1.*"))


def test_zero_and_disjoint():
    read = Read.from_fastq1("n", "A" * 10, "I" * 10)
    read.add_mapping("seq1.a", 3, 0), read.add_mapping("seq1.b", 0, 10)
    read.intersect("seq1.a", "seq1.b", "seq1.i")
    assert read.mapping("seq1.i") == [3, 0]
    read.add_mapping("seq1.c", 0, 2), read.add_mapping("seq1.d", 5, 3)
    read.union("seq1.c", "seq1.d", "seq1.u"), read.intersect("seq1.c", "seq1.d", "seq1.v")
    assert read.mapping("seq1.u") == [0, 8] and not read.has("seq1.v")


def test_chains_of_columns_do_as_the_record_does(spark):
    r = random.Random(2)
    seqs = ["".join(r.choice("ACGT") for _ in range(r.randrange(1, 30))) for _ in range(40)]
    data = "".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(seqs)).encode()
    got = Reads.fastq1_bytes(spark, data).cut("", "seq1.* -> seq1.a, seq1.b", left_end(7)).cut("", "seq1.b -> seq1.c, seq1.d", right_end(4))
    got = got.set("", "seq1.c", "{seq1.a}-{name1.*}").union("", "seq1.a, seq1.d -> seq1.u").trim("", "seq1.a").set("", "seq1.*", "{seq1.u}{seq1.*}")
    for s, read in zip(seqs, got.collect()):
        want = Read.from_fastq1(read.strands["name1"].text, s, "I" * len(s))
        want.cut("seq1.*", "seq1.a", "seq1.b", 7), want.cut("seq1.b", "seq1.c", "seq1.d", 4, from_left=False)
        want.set("seq1.c", f"{want.substring('seq1.a')}-{want.substring('name1.*')}", f"{want.substring_qual('seq1.a')}-{'I' * len(want.substring('name1.*'))}")
        want.union("seq1.a", "seq1.d", "seq1.u"), want.trim("seq1.a")
        want.set("seq1.*", want.substring("seq1.u") + want.substring("seq1.*"), want.substring_qual("seq1.u") + want.substring_qual("seq1.*"))
        assert read.strands["seq1"].text == want.strands["seq1"].text and read.strands["seq1"].qual == want.strands["seq1"].qual
        assert read.strands["seq1"].labels == want.strands["seq1"].labels


def test_long_chains_are_planned_by_labels_and_steps(spark):
    import time

    data = "".join(f"@r{i}\n{'ACGT' * 20}\n+\n{'I' * 80}\n" for i in range(5)).encode()

    def chain(n):
        got = Reads.fastq1_bytes(spark, data)
        for i in range(n):
            got = got.cut("", f"seq1.* -> seq1.a{i}, seq1.b{i}", left_end(3)).trim("", f"seq1.a{i}").set("", "name1.*", "{name1.*}_{seq1.b%d; 1}" % i)
            got = got.retain(f"seq1.b{i}")
        got = got.length_in_bounds("", f"seq1.b{n - 1} -> seq1.b{n - 1}.ok", (10, None))
        return got.retain(f"seq1.b{n - 1}.ok & seq1.b0")

    size = lambda reads: len(reads.df._jdf.queryExecution().optimizedPlan().toString())
    began = time.monotonic()
    ten = chain(10)
    assert size(ten) < 25 * size(chain(2))  # each step moves every label there is, once
    assert [r.strands["seq1"].text for r in ten.collect()] == [("ACGT" * 20)[30:]] * 5 and time.monotonic() - began < 60
