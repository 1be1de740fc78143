import random

from strandloom.llm import license_scan as ls


def found(text, **kw):
    return [(m["license"], round(m["coverage"], 3), text[m["start"] : m["end"]]) for m in ls.Index(ls.TEMPLATES).scan(text, **kw)]


def test_notices_are_found_with_their_spans():
    t = "Some text.\nReleased under the MIT License.\nMore text, all rights  RESERVED and on."
    assert found(t) == [("mit-notice", 1.0, "Released under the MIT License"), ("all-rights-reserved", 1.0, "all rights  RESERVED")]


def test_edited_text_is_found_and_the_longer_template_wins():
    words = ls.TEMPLATES["mit-grant"].split()
    r = random.Random(4)
    for k in range(0, len(words), 9):
        words[k] = r.choice(["foo", "", "bar baz"])
    (m,) = found("x y z " + " ".join(words) + " the end")
    assert m[0] == "mit-grant" and 0.85 < m[1] < 1.0
    (m,) = found(ls.TEMPLATES["apache-2.0-header"])
    assert m[:2] == ("apache-2.0-header", 1.0)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_alignment_finds_most_words_in_order():
    import numpy as np

    r = random.Random(5)
    for _ in range(200):
        own = [r.randrange(1, 6) for _ in range(r.randrange(3, 12))]
        text = [w for w in own if r.random() > 0.2 for w in ([w] if r.random() > 0.15 else [w, 0])]
        got = ls.align(own, np.array(text), 0, 30)
        assert len(got) == lcs(own, text) and got == sorted(set(got))
        it = iter(own)
        assert all(any(text[p] == w for w in it) for p in got)


def test_operator_against_every_template_aligned_everywhere(table, odd):
    texts = [*odd, *ls.TEMPLATES.values(), "Licensed under CC BY-NC 4.0.\n" * 3, "no licence here at all, none"]
    rows = {r.doc_id: r.licenses for r in ls.scan(table(texts)).select("doc_id", "licenses").collect()}
    for i, t in enumerate(texts):
        words = ls._word.findall((t or "").lower())
        whole = {k for k, v in ls.TEMPLATES.items() if f" {' '.join(ls._word.findall(v.lower()))} " in f" {' '.join(words)} "}
        names = {m.license for m in rows[i]}
        assert names <= whole and all(any(set(ls._word.findall(ls.TEMPLATES[k].lower())) <= set(ls._word.findall(ls.TEMPLATES[n].lower())) for n in names) for k in whole)
    assert len(rows[len(texts) - 2]) == 3 and rows[len(texts) - 1] == []
    assert ls.scan(table([])).count() == 0
