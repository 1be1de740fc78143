"""Selectors and templates on a read as an object."""

import pytest

from strandloom import Read, ReadNameError


@pytest.fixture
def read():
    r = Read.from_fastq2(("n1", "ACGTAC", "012345"), ("n2", "GG", "89"), 4, 5)
    r.cut("seq1.*", "seq1.a", "seq1.b", 2)
    r.set_data("seq1.a.n", 3), r.set_data("seq1.a.s", "xy"), r.set_data("seq1.a.f", False)
    return r


def test_selectors(read):
    for text, want in [("", True), ("seq1.a & !seq1.c", True), ("seq1.c | seq1.a.n", True), ("seq1.a.f | seq1.c", False), ("seq1.c & seq1.c.x", False), ("!(seq1.a.s & seq1.a.f)", True)]:
        assert read.matches(text) is want
    for text in ("seq1.a.x", "index1.a"):
        with pytest.raises(ReadNameError):
            read.matches(text)


def test_templates(read):
    text = "{name1.*}:{seq1.a; 2}{'N'; |seq1.b|}{seq2.*; seq1.a.n}{'-'; |seq1.a.s|}{seq1.a.f}{seq1.nope; 0}"
    assert read.format(text) == "n1:ACACNNNNGGGGGG--false"
    assert read.format(text, qual=True) == "II:0101NNNN898989--false"
    with pytest.raises(ReadNameError):
        read.format("{'x'; seq1.a.s}")
    with pytest.raises(ReadNameError):
        read.format("{'x'; |seq1.a.n|}")


def test_rows(read):
    assert read.to_fastq2() == (("n1", "ACGTAC", "012345"), ("n2", "GG", "89")) and read.first_idx() == 4
    with pytest.raises(ReadNameError):
        Read.from_fastq1("a", "C", "I").to_fastq2()
    with pytest.raises(ReadNameError):
        read.add_mapping("seq1.a", 0, 1)
    assert "from: record 5 in bytes" in str(read)
