"""Selectors, templates, transforms and names."""

import pytest

from strandloom import ExpressionError, ReadNameError, Reads, attr, label, left_end, sel, template, tr
from strandloom.functions import selector as s
from strandloom.functions import template as t
from strandloom.names import Attr, Label

A, B, C = (s.Has(Label("seq1", x)) for x in "abc")


@pytest.mark.parametrize(
    "text,want",
    [
        ("", s.Every()),
        ("  ", s.Every()),
        ("seq1.a", A),
        ("!seq1.a & seq1.b | seq1.c", s.Either((s.Both((s.Not(A), B)), C))),
        ("seq1.a & (seq1.b | seq1.c)", s.Both((A, s.Either((B, C))))),
        ("((seq1.a)) & seq1.b & seq1.c", s.Both((A, B, C))),
        ("!(seq1.a|seq1.b)", s.Not(s.Either((A, B)))),
        ("seq1.a.x", s.Has(Attr("seq1", "a", "x"))),
    ],
)
def test_selectors(text, want):
    assert sel(text) == want


@pytest.mark.parametrize("text", ["seq1", "seq1.a &", "& seq1.a", "(seq1.a", "seq1.a)", "seq1.a seq1.b", "seq1.a ? seq1.b", "seq9.a", "seq1.a b", "seq1.a.b.c"])
def test_selectors_that_cannot_be_read(text):
    with pytest.raises(ExpressionError):
        sel(text)


def test_templates():
    a = Label("seq1", "a")
    assert template(r"x{seq1.a}\{y\}") == (t.Text("x"), t.Fill(a), t.Text("{y}"))
    assert template("{'A;'; 4}") == (t.Repeat(t.Text("A;"), 4),)
    assert template("{seq1.a; |seq1.b|}{seq1.a; seq1.b.n}") == (t.Repeat(t.Fill(a), t.LengthOf(Label("seq1", "b"))), t.Repeat(t.Fill(a), t.CountOf(Attr("seq1", "b", "n"))))
    for bad in ("{", "}", "{seq1.a", "{{seq1.a}}", "x\\", "{seq1.a; seq1.b}"):
        with pytest.raises(ExpressionError):
            template(bad)


def test_transforms_and_names():
    x = tr("seq1.* -> seq1.a, _, seq1.b.ok")
    assert x.inputs == (Label("seq1", "*"),) and x.outputs == (Label("seq1", "a"), None, Attr("seq1", "b", "ok"))
    assert label(" seq2.x ") == Label("seq2", "x") and attr("name1.*.y") == Attr("name1", "*", "y")
    with pytest.raises(ExpressionError):
        tr("seq1.a, seq1.b")
    with pytest.raises(ExpressionError):
        tr("seq1.* -> seq2.a, _").expect(1, 2)
    with pytest.raises(ExpressionError):
        tr("seq1.* -> seq1.a").expect(1, 2)
    with pytest.raises(ExpressionError):
        label("seq1." + "x" * 17)
    with pytest.raises(ExpressionError):
        label("seq1.a.b")


@pytest.fixture(scope="module")
def reads(spark):
    data = b"@one\nACGTACGT\n+\n01234567\n@two\nGG\n+\n89\n"
    return Reads.fastq1_bytes(spark, data).cut("", "seq1.* -> seq1.a, seq1.b", left_end(3))


def flat(reads, **kw):
    return [tuple(r) for r in reads.flat(idx="idx", **kw).orderBy("idx").collect()]


def test_templates_are_filled(reads):
    got = flat(reads, x=r"<{name1.*}:{seq1.a}>{'N'; 2}{seq1.a; 2}{'-'; |seq1.b|}{seq1.nope; 0}")
    assert got == [(0, "<one:ACG>NNACGACG-----"), (1, "<two:GG>NNGGGG")]


def test_attributes_count_and_print(reads):
    got = reads.set("", "seq1.a.s", "false").length_in_bounds("", "seq1.a -> seq1.a.ok", range(3, 4)).set("seq1.a.s", "seq1.a.t", "")
    assert flat(got, s="{seq1.a.s}", ok="{seq1.a.ok}", truth="seq1.a.s?", empty="seq1.a.t?") == [(0, "false", "true", True, False), (1, "false", "false", True, False)]
    assert flat(got, x="{'x'; seq1.a.ok}", y="{'y'; |seq1.a.s|}") == [(0, "x", "yyyyy"), (1, "", "yyyyy")]


def test_what_is_missing(spark, reads):
    assert reads.retain("seq1.nope").df.count() == 0
    assert reads.retain("seq1.nope & seq1.nope.x").df.count() == 0
    with pytest.raises(Exception, match="seq1.a.nope is not in the read"):
        reads.retain("seq1.a.nope").df.collect()
    with pytest.raises(ReadNameError):
        reads.retain("seq2.a")
    with pytest.raises(ReadNameError):
        reads.trim("", "seq1.nope")
    with pytest.raises(ReadNameError):
        reads.cut("", "seq1.a -> seq1.*, _", left_end(1))
    with pytest.raises(Exception, match="seq1.a is in the read already"):
        reads.cut("", "seq1.b -> seq1.a, _", left_end(1)).df.collect()


def test_a_text_is_no_number(reads):
    got = reads.set("", "seq1.a.n", "3").set("", "name1.*", "{'A'; seq1.a.n}")
    with pytest.raises(Exception, match="seq1.a.n is no number"):
        got.df.collect()


def test_checks_fail_even_if_nothing_reads_the_column(reads):
    some = reads.length_in_bounds("", "seq1.a -> seq1.a.long", range(3, 4)).intersect("seq1.a.long", "seq1.a, seq1.* -> seq1.c")
    assert some.trim("seq1.c", "seq1.c").df.count() == 2
    with pytest.raises(Exception, match="seq1.c is not in the read"):
        some.trim("", "seq1.c").df.count()
    again = some.intersect("!seq1.a.long", "seq1.a, seq1.* -> seq1.c")  # for other reads, so not twice
    assert again.retain("seq1.c").df.count() == 2
