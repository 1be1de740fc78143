import random
import re

from pyspark.sql import functions as F

from strandloom.llm import quality_rules as q


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = set()
    for i, r in enumerate(runs):
        if runs.count(r) > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_counts(table, odd):
    base = "a b c d e f g h "
    texts = odd[:6] + odd[8:] + [base * 2, base + "x " + base + "y " + base, "#a $b\n#a $b\n\n#a $b", "o " * 30, "a b c d e f g h i a b c d e f g h i"]
    rows = {r.id: r for r in q.statistics(table(texts)).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(t), t


def rows_of(r, n):
    out = []
    for _ in range(n):
        x = {f: r.random() for f in q.FEATURES}
        out.append((x, x["symbols_per_word"] > 0.8 or (x["upper_share"] > 0.7 and x["marks_per_word"] > 0.5)))
    return out


def test_rules_are_learned_and_hold_out():
    r = random.Random(3)
    rules = q.learn(rows_of(r, 1500))
    assert 2 <= len(rules) <= 12
    held = rows_of(r, 1000)
    right = sum(bad == any(all(c.holds(x) for c in rule) for rule in rules) for x, bad in held)
    assert right > 960


def test_rules_need_both_kinds():
    assert q.learn([]) == [] and q.learn([({f: 0.0 for f in q.FEATURES}, False)] * 50) == []


def test_expression_says_what_the_rules_say(spark):
    rules = q.learn(rows_of(random.Random(4), 800))
    held = rows_of(random.Random(5), 300)
    got = spark.createDataFrame([(i, *x.values()) for i, (x, _) in enumerate(held)], ["i", *q.FEATURES]).select("i", q.verdict(rules).alias("v")).collect()
    for r in got:
        want = next((k for k, rule in enumerate(rules, 1) if all(c.holds(held[r.i][0]) for c in rule)), None)
        assert r.v == want


def test_fit_and_apply(spark, table):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    good = [" ".join(word() for _ in range(60)) for _ in range(40)]
    bad = [" ".join("#$" + word() for _ in range(60)) for _ in range(40)]
    docs = table(good + bad + [None, ""])
    labels = spark.createDataFrame([(i, int(i < 40), None) for i in range(80)] + [(999, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    rules = q.fit(docs, labels)
    kept = {x.id: x.kept for x in q.apply_rules(docs, rules).collect()}
    assert all(kept[i] for i in range(40)) and not any(kept[i] for i in range(40, 82))
    none = q.apply_rules(docs, q.fit(docs, labels.limit(0)))
    assert none.where("kept").count() == 80 and q.apply_rules(table([]), rules).count() == 0
    assert none.where(F.col("kept") & F.col("base_failed")).count() == 0
