"""User functions: what they leave alone comes back as it was, and names are not parsed for every read."""

from strandloom import ExactPrefix, Read, Reads, names


def test_names_selectors_and_templates_are_parsed_once(monkeypatch):
    seen = []
    monkeypatch.setattr(names, "checked", lambda x, f=names.checked: seen.append(x) or f(x))
    for i in range(50):
        r = Read.from_fastq1(f"n{i}", "ACGT", "IIII", i)
        r.add_mapping("seq1.once", 1, 2)
        r.set_data("seq1.once.note", r.format("{seq1.once; 2}:{name1.*}"))
        assert r.matches("seq1.once & !seq1.twice") and r.data("seq1.once.note") == f"CGCG:n{i}" and r.relation("seq1.*", "seq1.once") == ("b inside a", 2)
        assert "note=CGCG" in str(r)
    assert len(seen) < 40


def test_values_of_every_kind_pass_through(spark):
    def odd(read) -> None:
        n = read.first_idx()
        if n == 2:
            read.set("seq1.*", "", "")
        elif n == 4:
            read.set_data("seq1.*.v", True)
        elif n == 5:
            read.set_data("seq1.*.v", 7)
        elif n == 6:
            read.set_data("seq1.*.v", "é\U0001f600")
            read.add_mapping("seq1.x", 1, 0)

    rows = [(0, "n", "ACG", "III"), (1, None, None, None), (2, "é", "A", "5"), (3, "", "", ""), (4, "m", "ACA", None), (5, "m", "ACA", "abc"), (6, "m", "TACA", "abcd")]
    df = spark.createDataFrame(rows, "i bigint, n string, s string, q string").coalesce(1)
    got = Reads.from_dataframe(df, "i", name1="n", seq1="s", qual1="q").match_one("", "seq1.* -> seq1.p, seq1.r", "AC", ExactPrefix)
    got = got.for_each("!seq1.p | seq1.r", odd, labels=["seq1.x"], attrs=["seq1.*.v"])
    for out in (got, got.for_each("seq1.p", lambda r: None), got.for_each("", lambda r: None)):
        reads = out.collect()
        said = [(r.strand("name1").text, r.strand("seq1").text, r.strand("seq1").qual, r.strand("seq1").labels, r.strand("seq1").attrs) for r in reads]
        p = {"p": [0, 2], "r": [2, 1]}
        assert said == [
            ("n", "ACG", "III", p, {}), (None, None, None, {}, {}), ("é", "", "", {}, {}), ("", "", "", {}, {}),
            ("m", "ACA", None, p, {("*", "v"): True}), ("m", "ACA", "abc", p, {("*", "v"): 7}), ("m", "TACA", "abcd", {"x": [1, 0]}, {("*", "v"): "é\U0001f600"}),
        ]
