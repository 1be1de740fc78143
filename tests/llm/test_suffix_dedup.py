import hashlib
import random

from strandloom.llm import suffix_dedup as s


def check(table, texts, length, gram, ids=None):
    rows = {r.id: r for r in s.dedup(table(texts, ids), length=length, gram=gram).collect()}
    data = [(t or "").encode() for t in texts]
    want = s.brute_force(data, length)
    for i, (t, runs) in enumerate(zip(data, want, strict=True)):
        r = rows[i if ids is None else ids[i]]
        assert [(x.start, x.end) for x in r.removed] == runs, i
        keep = bytes(b for k, b in enumerate(t) if not any(x <= k < y for x, y in runs))
        assert r.n_bytes == len(t) and hashlib.sha256(r.kept).digest() == hashlib.sha256(keep).digest()


def test_against_brute_force(table, odd):
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz é") for _ in range(n))
    passage = [word(n) for n in (95, 100, 101, 130, 300)]
    texts = [word(r.randrange(0, 400)) + "".join(word(r.randrange(60)) + r.choice(passage) for _ in range(r.randrange(4))) for _ in range(40)]
    texts += [texts[3], texts[3] + "x", "y" + texts[3], texts[5][:200] + "#" + texts[5][200:], "ab" * 400, "z" * 350, "z" * 100, *odd]
    check(table, texts, 100, 16)


def test_copies_of_a_copy_within_a_text(table):
    r = random.Random(9)
    p = "".join(r.choice("abcdef") for _ in range(120))
    check(table, [p + "-" + p, "q" + p[:110], p[5:119] + "w", "none"], 100, 24)


def test_empty_table_and_repeated_rows(table):
    assert s.dedup(table([])).count() == 0
    t = "".join(random.Random(1).choice("abc def") for _ in range(500))
    rows = s.dedup(table([t, t, "x"], [4, 4, None])).collect()
    assert sorted((r.n_bytes, sum(x.end - x.start for x in r.removed)) for r in rows) == [(1, 0), (500, 500), (500, 500)]
