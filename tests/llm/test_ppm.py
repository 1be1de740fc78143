import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import ppm


def counted(texts, order):
    """Followers of each context: of the longest by how often, of shorter ones by in how many one longer."""
    longest: dict = {}
    for t in texts:
        past = [ppm.BEFORE] * order
        for s in [*t, ppm.END]:
            longest.setdefault(tuple(past[len(past) - order :]), Counter())[s] += 1
            past.append(s)
    seen, now = dict(longest), longest
    for _ in range(order):
        shorter: dict = {}
        for c, own in now.items():
            for s in own:
                shorter.setdefault(c[1:], Counter())[s] += 1
        seen.update(shorter)
        now = shorter
    return seen


def log_of(seen, past, s, order):
    """By the definition, context by context."""
    log, ruled = 0.0, set()
    for k in range(order, -1, -1):
        own = {x: n for x, n in seen.get(tuple(past[len(past) - k :]), {}).items() if x not in ruled}
        if not own:
            continue
        whole = 2 * sum(own.values())
        if s in own:
            return log + math.log10((2 * own[s] - 1) / whole)
        log += math.log10(len(own) / whole)
        ruled |= own.keys()
    return log - math.log10(ppm.SYMBOLS - len(ruled))


def plain(seen, text, order):
    past, log = [ppm.BEFORE] * order, 0.0
    for s in [*text, ppm.END]:
        log += log_of(seen, past, s, order)
        past.append(s)
    return log


def words(r, n, letters="abcd e\n"):
    return "".join(r.choice(letters) for _ in range(n)).encode()


def test_probabilities_add_up_to_one(spark):
    r = random.Random(7)
    train = [words(r, 50) for _ in range(10)]
    seen = counted(train, 3)
    keys, n = ppm.merged(*(lambda k: (k, np.ones(len(k), np.int64)))(ppm.contexts(train, 3)[0]))
    pasts = ([ppm.BEFORE] * 3, [97, 98, 99], [120, 120, 97], [97, 120, 121])
    every = [p[0] << 27 | p[1] << 18 | p[2] << 9 | s for p in pasts for s in range(257)]
    asked = [(k,) for k in every if k not in set(keys.tolist())]
    counts = spark.createDataFrame(list(zip(keys.tolist(), n.tolist())), "key bigint, n bigint")
    got = {x.key: x.log for x in ppm.probabilities(counts, spark.createDataFrame(asked, "key bigint"), 3).collect()}
    for i, past in enumerate(pasts):
        own = every[257 * i : 257 * i + 257]
        assert abs(sum(10 ** log_of(seen, past, s, 3) for s in range(257)) - 1) < 1e-9
        assert np.allclose([got[k] for k in own], [log_of(seen, past, s, 3) for s in range(257)], atol=1e-9)


def test_adaptive():
    one, two = ppm.adaptive([b"abababababababab", b"q8z!kd0w(mx#p[ 1"])
    assert one > two and abs(ppm.adaptive([b""])[0] + math.log10(257)) < 1e-12
    text = b"the theatre then"  # the trie learns as the trained one counts
    want = sum(log_of(counted_so_far(text[:i], 3), [*text[:i]], s, 3) for i, s in enumerate([*text, ppm.END]))
    assert abs(ppm.adaptive([text], 3)[0] - want) < 1e-9


def counted_so_far(text, order):
    """An adaptive trie: a symbol counts in contexts down to the longest that had it."""
    seen: dict = {}
    for i, s in enumerate(text):
        for k in range(min(order, i), -1, -1):
            own = seen.setdefault(tuple(text[i - k : i]), Counter())
            own[s] += 1
            if own[s] > 1:
                break
    return seen


def base(texts, train):
    split = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", t.lower()), b""]
    c = Counter(w for t in train for w in split(t))
    n, v = sum(c.values()), len(c)
    return [(len(split(t)), sum(c[w] > 0 for w in split(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in split(t))) for t in texts]


@pytest.mark.parametrize("order,chunk,frequent", [(3, 1 << 23, 10**6), (5, 300, 20), (1, 100, 0), (2, 1 << 23, 0)])
def test_operator(table, odd, order, chunk, frequent, monkeypatch):
    monkeypatch.setattr(ppm, "CHUNK_BYTES", chunk)
    r = random.Random(11)
    texts = [words(r, r.randrange(200), "abcdeAB   \n").decode() for _ in range(60)] + odd[:6] + odd[8:]
    docs = table(texts)
    held = ppm.held_out(F.col("doc_id"))
    got = {x.id: x for x in ppm.evaluate(docs, docs.where(~held), order=order, frequent=frequent).collect()}
    data = [(t or "").encode() for t in texts]
    train = [t for i, t in enumerate(data) if zlib.crc32(str(i).encode()) % 7 != 2]
    seen = counted(train, order)
    assert len(got) == len(texts) and len(train) < len(texts)
    for i, (t, want) in enumerate(zip(data, base(data, train))):
        g = got[i]
        assert (g.n_tokens, g.n_known, g.train_tokens) == want[:3]
        assert abs(g.base_score - want[3]) < 1e-6 and abs(g.score - plain(seen, t, order)) < 1e-6


def test_none_to_score_or_to_learn_from(table):
    docs = table(["a b", None])
    rows = ppm.evaluate(docs, docs.limit(0)).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in rows] == [(0, 0, 0.0)] * 2
    assert np.allclose(sorted(r.score for r in rows), [-4 * math.log10(257), -math.log10(257)])
    assert ppm.evaluate(docs.limit(0), docs).count() == 0


def test_adaptive_scores_of_a_table(table):
    texts = ["abababababab", "é 漢字", "", None]
    got = {r.id: r.score for r in ppm.score_adaptive(table(texts)).collect()}
    want = ppm.adaptive([(t or "").encode() for t in texts])
    assert got == dict(enumerate(want)) and ppm.score_adaptive(table([])).count() == 0
