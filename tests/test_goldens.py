"""Worked examples, derived by hand."""

from strandloom import ExactPrefix, Frac, HammingSearch, Reads, SuffixAln, left_end, right_end, run
from strandloom import Patterns

SIMPLE = b"@read1\nATCGATCGATCGATCG\n+\n0123456789012345\n@read2\nAATTCCGGAATTCCGG\n+\n0123456789012345\n"


def simple(spark):
    return Reads.fastq1_bytes(spark, SIMPLE)


def test_cut_set_trim_and_write(spark, tmp_path):
    out = tmp_path / "a" / "out.fastq"
    reads = simple(spark).cut("", "seq1.* -> seq1.a, seq1.b", left_end(3)).cut("", "seq1.b -> _, seq1.c", right_end(4))
    reads = reads.set("", "name1.*", "{name1.*}_{seq1.a}").trim("", "seq1.a").collect_fastq1("", str(out))
    got = reads.collect()
    assert out.read_text() == "@read1_ATC\nGATCGATCGATCG\n+\n3456789012345\n@read2_AAT\nTCCGGAATTCCGG\n+\n3456789012345\n"
    assert {k: tuple(v) for k, v in got[0].strands["seq1"].labels.items()} == {"a": (0, 0), "b": (0, 13), "c": (9, 4)}


def test_suffix_alignment_finds_adapters(spark):
    ends = ["GAAAA", "GTTTT", "GAAAT", "GGGAA", "GGGGA", "AAAAG", "AAAGG", "AAGGG"]
    data = "".join(f"@read{i}\n{'C' * 15}{e}\n+\n{'I' * 20}\n" for i, e in enumerate(ends, 1)).encode()
    pats = Patterns.of("adapter", ["AAAA", "TTTT"])
    got = Reads.fastq1_bytes(spark, data).match_any("", "seq1.* -> seq1.template, seq1.adapter", pats, SuffixAln(0.75, 0.5))
    trimmed = got.trim("seq1.adapter", "seq1.adapter").collect()
    rows = [(tuple(r.strands["seq1"].labels.get("adapter", ())), r.data("seq1.*.adapter")) for r in got.collect()]
    assert rows == [((16, 4), "AAAA"), ((16, 4), "TTTT"), ((16, 4), "AAAA"), ((18, 2), "AAAA"), ((), False), ((15, 5), "AAAA"), ((), False), ((), False)]
    assert [len(r.strands["seq1"].text) for r in trimmed] == [16, 16, 16, 18, 20, 15, 20, 20]


def test_fork(spark):
    reads = simple(spark).cut("", "seq1.* -> seq1.a, seq1.b", left_end(3))
    a, b = reads.fork()
    a, b = a.set("", "name1.*", "{name1.*}_{seq1.a}"), b.trim("", "seq1.a")
    assert [r.strands["name1"].text for r in a.collect()] == ["read1_ATC", "read2_AAT"]
    assert [r.strands["seq1"].text for r in b.collect()] == ["GATCGATCGATCG", "TCCGGAATTCCGG"]
    run(a, b)


def test_single_cell_protocol(spark):
    r1 = ("AAAAAAAAAACAGAGCTTTTTTTTCCCCCCCCCC", "A" * 14 + "CAGAGC" + "TTTTTTTT" + "CCCCCCCCCC")
    r2 = ("AAAATTTTCCCCGGGGAAAACGCGACG", "AAAATTTTCCCCGGGG" + "ATATAT")
    data = ""
    for i, (a, b) in enumerate(zip(r1, r2), 1):
        q = "01234567890123456789012345678901234567890"
        data += f"@read{i}/1\n{a}\n+\n{q[:len(a)]}\n@read{i}/2\n{b}\n+\n{q[:len(b)]}\n"
    adapters = Patterns.of("adapter", ["CGCGCGCGCG", "ATATATATAT"])
    reads = Reads.fastq_interleaved_bytes(spark, data.encode()).match_any("", "seq2.* -> _, seq2.adapter", adapters, SuffixAln(0.7, 0.4)).trim("seq2.adapter", "seq2.adapter")
    assert [r.strands["seq2"].text for r in reads.collect()] == ["AAAATTTTCCCCGGGGAAAA", "AAAATTTTCCCCGGGG"]
    reads = reads.match_one("", "seq1.* -> seq1.bc1, _, seq1.after", "CAGAGC", HammingSearch(Frac(0.8))).length_in_bounds("seq1.bc1", "seq1.bc1 -> seq1.bc1.ok", range(9, 12))
    reads = reads.retain("seq1.bc1 & seq1.bc1.ok").cut("", "seq1.after -> seq1.umi, seq1.bc2", left_end(8))
    reads = reads.set("", "name1.*", "{name1.*}_{seq1.umi}_{seq1.bc1}{seq1.bc2}")
    (one,) = reads.set("", "seq1.*", "{seq2.*}").collect()
    assert one.to_fastq1() == ("read1/1_TTTTTTTT_AAAAAAAAAACCCCCCCCCC", "AAAATTTTCCCCGGGGAAAA", "01234567890123456789")
    # labels after 34 bytes became 20
    assert {k: tuple(v) for k, v in one.strands["seq1"].labels.items()} == {"bc1": (0, 10), "after": (2, 18), "umi": (16, 4), "bc2": (10, 10)}


def test_an_early_perfect_pattern_stands(spark):
    reads = Reads.fastq1_bytes(spark, b"@x\nAAAA\n+\nIIII\n").match_any("", "seq1.* -> seq1.a, seq1.b", Patterns.of("p", ["", "AA", "AAAA"]), ExactPrefix)
    (r,) = reads.collect()
    assert r.data("seq1.*.p") == "AA" and r.mapping("seq1.a") == [0, 2] and r.mapping("seq1.b") == [2, 2]
