"""Sources, sinks, forks, observers, user functions, streams."""

import gzip
import os

import pytest

from strandloom import ExactPrefix, FastqError, ReadNameError, Reads, left_end, run, run_with_threads
from strandloom.streaming.stream import start, stream_fastq


def fastq(*seqs, name="r"):
    return "".join(f"@{name}{i} x\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(seqs)).encode()


def seqs(reads, kind="seq1"):
    return [r.strands[kind].text for r in reads.collect()]


def test_single_files_plain_and_gzip(spark, tmp_path):
    (tmp_path / "a.fastq").write_bytes(fastq("ACGT", "GG").replace(b"\n", b"\r\n"))
    (tmp_path / "b.fastq.gz").write_bytes(gzip.compress(fastq("TTT")))
    (tmp_path / "c.fastq").write_bytes(b"")
    reads = Reads.fastq1(spark, str(tmp_path))
    rows = sorted((os.path.basename(r.strands["seq1"].origin), r.strands["seq1"].idx, r.strands["name1"].text, r.strands["seq1"].text) for r in reads.collect())
    assert [x[1:] for x in rows] == [(0, "r0 x", "ACGT"), (1, "r1 x", "GG"), (0, "r0 x", "TTT")]
    by_spark = Reads.fastq1(spark, f"file://{tmp_path}")
    assert sorted(seqs(by_spark)) == sorted(seqs(reads))


def test_mates(spark, tmp_path):
    one, two = tmp_path / "1.fastq", tmp_path / "2.fastq"
    one.write_bytes(fastq("AA", "CC")), two.write_bytes(fastq("GG", "TT", "AC"))
    pairs = Reads.fastq2(spark, str(one), str(two))
    assert seqs(pairs, "seq2") == ["GG", "TT"]
    with pytest.raises(Exception, match="record 2 in .* has no mate"):
        Reads.fastq2(spark, str(two), str(one)).collect()
    got = Reads.fastq_interleaved_bytes(spark, fastq("A", "C", "G", "T"))
    assert [(r.strands["seq1"].idx, r.strands["seq2"].idx) for r in got.collect()] == [(0, 1), (2, 3)]
    assert seqs(got.take(range(0, 4))) == ["A", "G"] and seqs(got.take((None, 1))) == ["A"] and seqs(got.take((None, None))) == ["A", "G"]
    with pytest.raises(FastqError):
        Reads.fastq_interleaved_bytes(spark, fastq("A", "C", "G"))


@pytest.mark.parametrize("bad", [b"@x\nAC\n+\nI\n", b"x\nAC\n+\nII\n", b"@x\nAC\n", b"@x\nAC\nII\n+\n", b"@x\nA\n+\nI\n\n\n\n\n@y\nA\n+\nI\n"])
def test_records_that_are_none(spark, bad):
    with pytest.raises(FastqError, match="record|blank"):
        Reads.fastq1_bytes(spark, bad)


def test_a_quality_may_begin_with_at(spark):
    assert seqs(Reads.fastq1_bytes(spark, b"@x\nAC\n+\n@@\n@y\nGT\n+\n@I\n")) == ["AC", "GT"]


def test_bytes_beyond_ascii(spark, tmp_path):
    (tmp_path / "x.fastq").write_bytes(b"@n\xe9\xff\nA\xc3\xa9C\n+\nIIII\n")
    reads = Reads.fastq1(spark, str(tmp_path / "x.fastq")).cut("", "seq1.* -> seq1.a, seq1.b", left_end(2)).trim("", "seq1.a")
    out = tmp_path / "y.fastq"
    reads.collect_fastq1("", str(out)).run()
    assert out.read_bytes() == b"@n\xe9\xff\n\xa9C\n+\nII\n"


def test_reads_go_to_the_files_they_name(spark, tmp_path):
    data = fastq("AAC", "CAC", "AAG", "CCC", "AAT", "GTT")
    reads = Reads.fastq_interleaved_bytes(spark, data).cut("", "seq1.* -> seq1.bc, _", left_end(1))
    both = str(tmp_path / "d" / "{seq1.bc}.fastq.gz")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "A.fastq.gz").write_bytes(b"old")
    reads.collect_fastq2("", both, both).collect_fastq1("", str(tmp_path / "all.fastq")).run()
    got = gzip.decompress((tmp_path / "d" / "A.fastq.gz").read_bytes()).decode().split("\n")[1::4]
    assert got == ["AAC", "CAC", "AAG", "CCC", "AAT", "GTT"]
    assert (tmp_path / "all.fastq").read_text().split("\n")[1::4] == ["AAC", "AAG", "AAT"]
    assert sorted(p.name for p in tmp_path.iterdir() if p.is_file()) == ["all.fastq"]
    with pytest.raises(ReadNameError):
        Reads.fastq1_bytes(spark, data).collect_fastq2("", "a", "b")


def test_counts_and_times(spark):
    seen, took = [], []
    reads = Reads.fastq1_bytes(spark, fastq("AC", "GT", "AA")).match_one("", "seq1.* -> seq1.a, _", "A", ExactPrefix)
    reads.count(["seq1.a", "", "!seq1.a"], seen.append).retain("!seq1.a").time(took.append).run()
    assert seen == [[2, 3, 1]] and len(took) == 1 and took[0] > 0


def test_user_functions(spark):
    def mark(read):
        read.add_mapping("seq1.x", 1, 1)
        read.set_data("seq1.x.n", 7)
        read.set("name1.*", read.substring("name1.*").upper())

    reads = Reads.fastq1_bytes(spark, fastq("ACG", "GT")).match_one("", "seq1.* -> seq1.a, _", "A", ExactPrefix)
    got = reads.for_each("seq1.a", mark, labels=["seq1.x"], attrs=["seq1.x.n"])
    assert [(r.strands["name1"].text, r.has("seq1.x")) for r in got.collect()] == [("R0 X", True), ("r1 x", False)]
    assert [r.substring("seq1.*") for r in got.trim("seq1.x & seq1.x.n", "seq1.x").collect()] == ["AG", "GT"]
    with pytest.raises(Exception, match="was not named"):
        reads.for_each("", mark).collect()


def test_pictures(spark):
    (r,) = Reads.fastq1_bytes(spark, fastq("ACGTAC")).cut("", "seq1.* -> seq1.left, seq1.r", left_end(1)).set("", "seq1.r.k", "v").collect()
    assert str(r).split("\n")[-6:] == ["*     |----|", "left  |", "r      |---| k=v", "str:  ACGTAC", "qual: IIIIII", "from: record 0 in bytes"]
    assert len(Reads.fastq1_bytes(spark, fastq("A")).dbg().collect()) == 1


def test_draws_do_not_depend_on_partitions(spark):
    reads = Reads.fastq1_bytes(spark, fastq(*["A"] * 300)).bernoulli("", "seq1.*.in", 0.25, 3)
    a = [r.data("seq1.*.in") for r in reads.collect()]
    from dataclasses import replace

    b = [r.data("seq1.*.in") for r in replace(reads, df=reads.df.repartition(7)).collect()]
    assert a == b and 45 < sum(a) < 105
    with pytest.raises(ValueError):
        reads.bernoulli("", "seq1.*.x", 1.5, 0)


def test_branches_run_together(spark, tmp_path):
    a, b = Reads.fastq1_bytes(spark, fastq("ACG", "GT")).fork()
    a, b = a.collect_fastq1("", str(tmp_path / "a")), b.trim("", "seq1.*").collect_fastq1("", str(tmp_path / "b"))
    run(a, b)
    assert (tmp_path / "b").read_text() == "@r0 x\n\n+\n\n@r1 x\n\n+\n\n"
    run_with_threads(2, a, b)
    assert (tmp_path / "a").read_bytes() == fastq("ACG", "GT")
    assert seqs(Reads.fastq1_bytes(spark, fastq("ACG")).transform(lambda r: r.cut("", "seq1.* -> seq1.a, _", left_end(1))).boxed()) == ["ACG"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fastq").write_bytes(fastq("AACC", "GG"))
    reads = stream_fastq(spark, str(tmp_path / "in")).cut("", "seq1.* -> seq1.a, _", left_end(1)).trim("", "seq1.a")
    got = []
    start(reads, lambda r, n: got.extend(seqs(r)), str(tmp_path / "cp")).awaitTermination(60)
    assert got == ["ACC", "G"]


def test_sinks_by_paths_with_a_scheme(spark, tmp_path):
    one, two = tmp_path / "1.fastq", tmp_path / "2.fastq"
    one.write_bytes(fastq("AA", "CC", "AG")), two.write_bytes(fastq("GG", "TT", "AC"))
    pairs = Reads.fastq2(spark, f"file://{one}", f"file://{two}")
    assert seqs(pairs, "seq2") == ["GG", "TT", "AC"]
    to = f"file://{tmp_path}/out"
    got = pairs.cut("", "seq1.* -> seq1.bc, _", left_end(1))
    got.collect_fastq2("", to + "/{seq1.bc}=1.fastq", to + "/{seq1.bc} 2.fastq.gz").run()
    assert sorted(x for x in os.listdir(tmp_path / "out") if x[0] != ".") == ["A 2.fastq.gz", "A=1.fastq", "C 2.fastq.gz", "C=1.fastq"]
    assert (tmp_path / "out" / "A=1.fastq").read_bytes() == b"@r0 x\nAA\n+\nII\n@r2 x\nAG\n+\nII\n"
    assert gzip.decompress((tmp_path / "out" / "C 2.fastq.gz").read_bytes()) == b"@r1 x\nTT\n+\nII\n"
    got.collect_fastq2("", to + "/all.fastq", to + "/all.fastq").run()  # written over, mates side by side
    got.collect_fastq2("", to + "/all.fastq", to + "/all.fastq").run()
    assert seqs(Reads.fastq_interleaved(spark, f"{tmp_path}/out/all.fastq"), "seq2") == ["GG", "TT", "AC"]
    with pytest.raises(Exception, match="one kind"):
        got.collect_fastq2("", to + "/x", "/tmp/y")


def test_threads_reach_the_sinks_and_branches_run_side_by_side(spark, tmp_path):
    base = Reads.fastq1_bytes(spark, fastq("AC", "CC", "AG", "TT"))
    a, b = base.cut("", "seq1.* -> seq1.bc, _", left_end(1)).fork()
    a, b = a.collect_fastq1("", f"{tmp_path}/a/{{seq1.bc}}.fastq"), b.collect_fastq1("", f"{tmp_path}/b/{{seq1.bc}}.fastq")
    run_with_threads(3, a, b)
    assert sorted(os.listdir(tmp_path / "a")) == sorted(os.listdir(tmp_path / "b")) == ["A.fastq", "C.fastq", "T.fastq"]
    assert not a.held[0].storageLevel.useMemory


def test_several_sinks_evaluate_the_chain_once(spark, tmp_path):
    passed = spark.sparkContext.accumulator(0)

    def count(read):
        passed.add(1)

    base = Reads.fastq1_bytes(spark, fastq("AC", "CC", "AG", "TT")).for_each("", count)
    base.collect_fastq1("", f"{tmp_path}/a.fastq").trim("", "name1.*").collect_fastq1("", f"{tmp_path}/b.fastq").run()
    assert passed.value == 4
    assert (tmp_path / "a.fastq").read_bytes().count(b"@r") == 4 and (tmp_path / "b.fastq").read_bytes().count(b"@\n") == 4
