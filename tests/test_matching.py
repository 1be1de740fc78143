"""Matches against plain versions."""

import random
import re

import numpy as np
import pytest

from strandloom import Count, ExpressionError, Frac, GlobalAln, Hamming, HammingPrefix, HammingSearch, HammingSuffix, LocalAln, Patterns, PrefixAln, Reads, SuffixAln, left_end
from strandloom.operators import matching as m
from strandloom.operators import regexes

NONE = -(10**6)


def best_alignment(p, s, start, end):
    """(score, begin, stop) by a plain affine dynamic program; of equal scores the leftmost beginning."""
    n, w = len(p), len(s)
    d = [[(NONE, 0)] * (w + 1) for _ in range(n + 1)]
    u, lf = [x[:] for x in d], [x[:] for x in d]
    better = lambda *c: max(c, key=lambda x: (x[0], -x[1]))
    out = (NONE, 0, 0)
    for i in range(n + 1):
        for j in range(w + 1):
            if i == 0 and (j == 0 or start != "both") or start == "any" and (i == 0 or j == 0):
                d[i][j] = (0, j)
            if i and j:
                a = better(d[i - 1][j - 1], u[i - 1][j - 1], lf[i - 1][j - 1])
                if start == "any" and a[0] < 0:
                    a = (0, j - 1)
                d[i][j] = (a[0] + (1 if p[i - 1] == s[j - 1] else -1), a[1])
            if i:
                a, b = better(d[i - 1][j], lf[i - 1][j]), u[i - 1][j]
                u[i][j] = better((a[0] - 2, a[1]), (b[0] - 1, b[1]))
            if j and not (i == 0 and start != "both"):
                a, b = better(d[i][j - 1], u[i][j - 1]), lf[i][j - 1]
                lf[i][j] = better((a[0] - 2, a[1]), (b[0] - 1, b[1]))
            cell = better(d[i][j], u[i][j], lf[i][j])
            if (end == "any" or j == w and (end == "pattern" or i == n)) and cell[0] > out[0]:
                out = (*cell, j)
    return out


@pytest.mark.parametrize("start,end", [("both", "both"), ("read", "any"), ("both", "pattern"), ("any", "any")])
def test_scores_of_alignments(start, end):
    r = random.Random(3)
    for _ in range(150):
        w = r.randrange(1, 12)
        p = [r.randrange(3) for _ in range(r.randrange(1, 8))]
        rows = [[r.randrange(3) for _ in range(w)] for _ in range(4)]
        got = m.align(np.array(p), np.array(rows), start, end)
        for k, s in enumerate(rows):
            assert got["score"][k] == best_alignment(p, s, start, end)[0]
            assert 0 <= got["equal"][k] <= min(got["columns"][k], len(p))


def equal(a, b):
    return sum(x == y for x, y in zip(a, b))


def tried(s, p, kind):
    """(equal bytes, start) or None."""
    n, size, least = len(s), len(p), kind.threshold.least(len(p))
    spots = {"whole": [0] if n == size else [], "prefix": [0] if n >= size else [], "suffix": [n - size] if n >= size else [], "search": range(n - size + 1)}[kind.place]
    got = [(equal(s[o : o + size], p), -o) for o in spots]
    return (max(got)[0], -max(got)[1]) if got and max(got)[0] >= least else None


@pytest.mark.parametrize("kind", [Hamming(Count(2)), HammingPrefix(Frac(0.5)), HammingSuffix(Count(3)), HammingSearch(Frac(0.7)), HammingSearch(Count(0))])
def test_choice_among_patterns(kind):
    r = random.Random(4)
    for _ in range(60):
        strings = ["".join(r.choice("ACGT") for _ in range(r.randrange(9))) for _ in range(10)] + [None, ""]
        pats = ["".join(r.choice("ACGT") for _ in range(r.randrange(6))) for _ in range(4)]
        for s, got in zip(strings, m.choose(strings, pats, kind).to_pylist()):
            best, want = 0, None
            for k, p in enumerate(pats if s is not None else []):
                if best >= len(p):
                    continue
                hit = tried(s, p, kind)
                if hit and hit[0] > best:
                    best, want = hit[0], {"choice": k, "start": hit[1], "end": hit[1] + len(p), "pattern": p}
                    if best >= len(p):
                        break
            assert got == want


def reads_of(spark, *seqs):
    return Reads.fastq1_bytes(spark, "".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(seqs)).encode())


def test_alignment_kinds(spark):
    got = reads_of(spark, "ACGTTACG", "TTTT", "ACGT").match_one("", "seq1.* -> seq1.a", "acgtacg", GlobalAln(0.8)).collect()
    assert [r.has("seq1.a") for r in got] == [True, False, False]
    got = reads_of(spark, "TTTACGATTT").match_one("", "seq1.* -> seq1.l, seq1.m, seq1.r", "ACGA", LocalAln(1.0, 1.0)).collect()[0]
    assert [got.mapping(f"seq1.{x}") for x in "lmr"] == [[0, 3], [3, 4], [7, 3]]
    one = reads_of(spark, "AAAAGCC", "CGAAAA").match_any("", "seq1.* -> seq1.a, seq1.b", Patterns.of("p", ["AAAA"]), PrefixAln(0.75, 0.5)).collect()
    two = reads_of(spark, "CCGAAAA", "AAAAGC").match_any("", "seq1.* -> seq1.a, seq1.b", Patterns.of("p", ["AAAA"]), SuffixAln(0.75, 0.5)).collect()
    assert one[0].mapping("seq1.a") == [0, 4] and two[0].mapping("seq1.b") == [3, 4]


def test_patterns_of_the_read_itself(spark):
    got = reads_of(spark, "ACGACGTT", "ACGTTTTT").cut("", "seq1.* -> seq1.a, seq1.b", left_end(3))
    hit = got.match_one("", "seq1.b -> seq1.c, _", "{seq1.a}", HammingPrefix(Count(3))).collect()
    assert [r.has("seq1.c") for r in hit] == [True, False]


def test_yaml(spark):
    text = "name: p\npatterns:\n  - {pattern: AC, n: !UInt 4, b: !Bool false, s: !String x}\n  - {pattern: GG, n: !UInt 0, b: !Bool true, s: !String y}\n"
    pats = Patterns.from_yaml(text)
    assert pats.attr_names == ["b", "n", "s"] and pats.patterns[1].attrs == {"n": 0, "b": True, "s": "y"}
    got = reads_of(spark, "GGT", "T").match_any("", "seq1.* -> seq1.a, _", pats, HammingPrefix(Frac(1.0))).collect()
    assert got[0].data("seq1.*.n") == 0 and got[0].data("seq1.*.b") is True and got[1].data("seq1.*.p") is False
    for bad in ("patterns: []\nname: p", "name: p", "name: p\npatterns:\n  - {pattern: A, n: !UInt 1}\n  - {pattern: C}", "name: p\npatterns:\n  - {pattern: A, n: !UInt -1}"):
        with pytest.raises((ExpressionError, ValueError)):
            Patterns.from_yaml(bad)


def test_regex(spark):
    got = reads_of(spark, "CCGATTC", "CCC").match_regex("", "seq1.* -> seq1.*.hit", "G(?P<a>A)?(?<t>T+)(?P<z>Z)?").collect()
    assert got[0].data("seq1.*.hit") is True and got[0].mapping("seq1.t") == [4, 2] and not got[0].has("seq1.z")
    assert got[1].data("seq1.*.hit") is False and not got[1].has("seq1.a")
    for bad in ("(?=A)", "(?<!A)B", r"(A)\1", "("):
        with pytest.raises(ExpressionError):
            regexes.groups(bad)
    assert regexes.groups(r"(?P<x>\\(A))") == ["x"]


def polyx(s, x, left):
    total = best = at = 0
    for i, c in enumerate(s if left else s[::-1], 1):
        total += 1 if c == x else -2
        if total > best:
            best, at = total, i
    return (at, s.count(x) / at) if at else None


def test_polyx(spark):
    r = random.Random(6)
    seqs = ["CCTAAAAGAAA", "AACCCCCCAA", "CCCC", "A"] + ["".join(r.choice("AAC") for _ in range(r.randrange(1, 15))) for _ in range(60)]
    for left in (True, False):
        got = reads_of(spark, *seqs).match_polyx("", "seq1.* -> seq1.a, seq1.b", "A", left, 0.8).collect()
        for s, read in zip(seqs, got):
            want = polyx(s, "A", left)
            fires = want is not None and want[1] >= 0.8
            assert read.has("seq1.a") == fires
            if fires:
                n = want[0] if left else len(s) - want[0]
                assert read.mapping("seq1.a") == [0, n] and read.mapping("seq1.b") == [n, len(s) - n]
    assert polyx("CCTAAAAGAAA", "A", False) == (8, 7 / 8) and polyx("AACCCCCCAA", "A", False) == (2, 2.0)
    assert not re.search("A", "CCCC")


def test_local_alignment_of_strings_of_many_lengths():
    r = random.Random(9)
    strings = ["".join(r.choice("ACGT") for _ in range(r.randrange(25))) for _ in range(80)]
    kind = LocalAln(0.8, 0.6)
    together = m.choose(strings, ["ACGTAC", "GGTTA"], kind).to_pylist()
    assert together == [m.choose([s], ["ACGTAC", "GGTTA"], kind).to_pylist()[0] for s in strings]
    assert any(together) and not all(together)


def test_one_long_string_costs_no_more_than_itself():
    import random
    import tracemalloc

    from strandloom import HammingPrefix, LocalAln
    from strandloom.operators.matching import choose

    r = random.Random(9)
    short = ["".join(r.choice("ACGT") for _ in range(r.randrange(0, 120))) for _ in range(3000)]
    long = short[:1500] + ["ACGT" * 50_000] + [None] + short[1500:]
    for kind, n in ((HammingPrefix(Frac(0.5)), 3000), (LocalAln(0.8, 0.6), 60)):
        some = short[:n]
        want = choose(some, ["GATTACAGAT"], kind).to_pylist()
        mixed = long if n == 3000 else [*some, "ACGT" * 5000]
        tracemalloc.start()
        got = choose(mixed, ["GATTACAGAT"], kind).to_pylist()
        assert tracemalloc.get_traced_memory()[1] < 300e6
        tracemalloc.stop()
        assert (got[:1500] + got[1502:] if n == 3000 else got[:-1]) == want
