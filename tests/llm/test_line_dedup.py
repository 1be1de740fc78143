import random

from pyspark.sql import functions as F

from strandloom.llm import line_dedup as ld


def near(a, b):
    """Edit distance at most 1."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :]


def plain(texts, least=ld.MIN_CHARS):
    """Texts without the lines that go, by comparing all."""
    seen, out = [], []
    for t in texts:
        keep = []
        for line in (t or "").split("\n"):
            if not line.strip(" \t\x0b\x0c\r"):
                keep.append(line)
                continue
            gone = any(line == s or (max(len(line), len(s)) >= least and min(len(line), len(s)) >= least - 1 and near(line, s)) for s in seen)
            if not gone:
                keep.append(line)
            seen.append(line)
        out.append(None if t is None else "\n".join(keep))
    return out


def texts():
    r = random.Random(3)
    lines = ["".join(r.choice("abcdef é") for _ in range(r.randrange(1, 40))) for _ in range(60)]
    out = []
    for _ in range(40):
        doc = []
        for _ in range(r.randrange(8)):
            x = r.choice(lines)
            k = r.randrange(len(x) + 1)
            doc.append(r.choice([x, x, x[:k] + "q" + x[k:], x[:k] + x[k + 1 :], x[:k] + "z" + x[k + 1 :], x[:k] + "zz" + x[k:], ""]))
        out.append("\n".join(doc))
    return out


def test_against_all_pairs_of_lines(table, odd):
    docs = [*texts(), *odd, "x" * 16 + "\n" + "x" * 15 + "\n" + "x" * 17 + "\n" + "x" * 14]
    got = {r.doc_id: r for r in ld.dedup(table(docs)).collect()}
    want = plain(docs)
    for i, (t, w) in enumerate(zip(docs, want)):
        assert got[i].text == w, (t, w)
        n = lambda x: sum(bool(y.strip(" \t\x0b\x0c\r")) for y in (x or "").split("\n"))
        assert tuple(got[i].lines) == (n(t), n(t) - n(w))


def test_without_broadcast(table, monkeypatch):
    docs = texts()
    monkeypatch.setattr(ld, "BROADCAST_LINES", 0)
    assert {r.doc_id: r.text for r in ld.dedup(table(docs)).collect()} == dict(enumerate(plain(docs)))


def test_repeated_rows_null_ids_and_none(table):
    rows = ld.dedup(table(["a line of some length", "a line of some length", "b", "a line of some lengthy"], [3, 3, 9, None])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in rows) == [(0, "a line of some lengthy"), (3, ""), (3, ""), (9, "b")]
    assert ld.dedup(table([])).count() == 0


def test_of_equal_rows_the_first_keeps_its_lines(table):
    a, b = "a line of some length\n\nand one more line here", "quite another text of a line"
    rows = ld.dedup(table([a, a, b, b, b, "short", None, None], [3, 3, None, None, None, 4, 5, 5]).select("doc_id", "text")).collect()
    got = sorted((r.doc_id or 0, r.text is None, r.text or "", r.lines.n, r.lines.removed) for r in rows)
    gone = [(0, False, "", 1, 1)] * 2 + [(0, False, b, 1, 0), (3, False, "", 2, 2), (3, False, a, 2, 0), (4, False, "short", 1, 0)]
    assert got == sorted([*gone, (5, True, "", 0, 0), (5, True, "", 0, 0)])


def test_long_lines_by_running_sums(table, monkeypatch):
    for long in (0, 12, 20, 30):  # lines on either side of the bound, and on it
        monkeypatch.setattr(ld, "LONG", long)
        docs = [*texts(), "x" * 30 + "\n" + "x" * 31 + "\n" + "é" * 29 + "😀\n" + "é" * 30, "a" * 19 + "\n" + "a" * 20 + "\n" + "a" * 21]
        got = {r.doc_id: r.text for r in ld.dedup(table(docs)).collect()}
        assert [got[i] for i in range(len(docs))] == plain(docs)


def test_a_megabyte_line_and_a_near_one(table):
    import time

    r = random.Random(8)
    a = "".join(r.choice("abcdefgh ") for _ in range(1_000_000))
    b = a[:700_000] + "Q" + a[700_001:]
    began = time.monotonic()
    got = {r.doc_id: r.text for r in ld.dedup(table([a, b + "\nshort line of its own", "z" + a[:300] + a[301:]])).collect()}
    assert got[0] == a and got[1] == "short line of its own" and got[2] == "z" + a[:300] + a[301:]
    assert time.monotonic() - began < 120


def test_an_own_column_named_as_the_counts(table):
    df = table(["a line\na line", None]).withColumn("lines", F.lit(5))
    assert [(r.lines.n, r.lines.removed) for r in ld.dedup(df).orderBy("doc_id").collect()] == [(2, 1), (0, 0)]
    assert [(r.lines, r.seen.n) for r in ld.dedup(df, into="seen").orderBy("doc_id").collect()] == [(5, 2), (5, 0)]


def test_documents_are_not_split_again_for_each_use_of_the_near_lines(spark, table, tmp_path):
    table(texts()).select("doc_id", "text").write.parquet(str(tmp_path / "d"))
    _, near = ld.near_lines(ld.documents(spark.read.parquet(str(tmp_path / "d"))))
    assert near.count() and not any(str(tmp_path) in f for f in near.inputFiles())


def test_blank_lines(spark):
    lines = ["", " ", "\t \x0b\x0c\r", "\u00a0", " a", "a ", "\r\u3000", "\x00", "\u00e9 "]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", ld._blank(F.col("line")).alias("b")).collect()
    assert {r.line: r.b for r in got} == {x: not x.strip(" \t\x0b\x0c\r") for x in lines}


def test_long_lines_emit_the_variants_of_shared_pieces_only(table, monkeypatch):
    r = random.Random(5)
    body = "".join(r.choice("abcdefgh ") for _ in range(2500))
    lines = [f"{i * 7919:06d} {body}" for i in range(20)]  # share their last half, differ in some of six characters
    picked = table(lines).selectExpr("xxhash64(text) as h", "doc_id as at", "char_length(text) as n", "text as line")
    assert 0 < ld._long_variants(picked).count() < 20 * 150
    near = [lines[0], lines[1], lines[1][:40] + "Q" + lines[1][41:], lines[2], lines[2] + "Q", lines[3], "Q" + lines[3], lines[4], lines[4][:2000] + lines[4][2001:]]
    assert [x.text for x in ld.dedup(table(near)).orderBy("doc_id").collect()] == plain(near) == [lines[0], lines[1], "", lines[2], "", lines[3], "", lines[4], ""]
