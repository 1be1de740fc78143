import random
from collections import Counter

from pyspark.sql import functions as F

from strandloom.llm import langid as li


def plain(text, depth=li.DEPTH):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    grams = Counter()
    for w in words:
        p = f" {w} "
        grams.update(w)
        grams.update(p[i : i + 2] for i in range(len(p) - 1))
        grams.update(p[i : i + 3] for i in range(len(p) - 2))
    code = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(g))
    return [code(g) for g, _ in sorted(grams.items(), key=lambda x: (-x[1], code(x[0])))[:depth]]


def test_ranked_grams():
    for t in ("Hello, hello World!", "a", "ÉTÉ été 漢字 漢", "x1y2 z", "...", ""):
        assert li.ranked(t).tolist() == plain(t), t


def test_distance_and_held_out_accuracy(table, odd):
    r = random.Random(5)
    stock = {"en": "the of and to in is that".split(), "de": "der die und das nicht ein".split(), "fr": "le la les des est une".split()}
    texts, langs = [], []
    for i in range(150):
        lang = r.choice([*stock])
        texts.append(" ".join(r.choice(stock[lang]) for _ in range(30)))
        langs.append(lang)
    docs = table(texts + odd, langs=langs + [None] * len(odd))
    held = li.held_out(F.col("doc_id"))
    profiles = li.fit(docs.where(~held))
    got = {x.doc_id: x for x in li.predict(docs, profiles).select("doc_id", "lang_pred", "score", held.alias("held")).collect()}
    assert all(got[i].lang_pred == lang for i, lang in enumerate(langs)) and sum(x.held for x in got.values()) > 20
    assert all(0 <= x.score <= 1 for x in got.values())
    for i, t in enumerate(odd, len(texts)):
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    # the distance, by hand
    own, best = plain(texts[0]), {}
    for k, name in enumerate(profiles.names):
        rank = {g: x for g, x in zip(profiles.codes.tolist(), profiles.ranks[k].tolist()) if x >= 0}
        best[name] = sum(abs(rank[g] - i) if g in rank else li.DEPTH for i, g in enumerate(own))
    name = min(best, key=lambda n: (best[n], n))
    assert got[0].lang_pred == name and abs(got[0].score - (1 - best[name] / (li.DEPTH * len(own)))) < 1e-12


def test_nothing_to_learn_from(table):
    docs = table(["some text", None])
    profiles = li.fit(docs.limit(0))
    assert [r.lang_pred for r in li.predict(docs, profiles).collect()] == ["und", "und"]
    assert li.predict(table([]), profiles).count() == 0


def test_profiles_are_those_of_all_counts(table):
    texts = ["aa ab", "aa ba", "zz"]
    profiles = li.fit(table(texts))
    assert [profiles.codes[profiles.ranks[0][:-1] == k][0] for k in range(5)] == plain(" ".join(texts))[:5]
