import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from strandloom.llm import simhash as sh
from strandloom.llm.components import components


def plain(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def groups(fps, ids):
    """Smallest id reachable, by all pairs."""
    n, root = len(fps), list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[top(i)] = top(j)
    least = {}
    for i in range(n):
        least[top(i)] = min(ids[i], least.get(top(i), ids[i]))
    return [least[top(i)] for i in range(n)]


def test_every_pair_in_the_radius_shares_a_mask():
    r, masks = random.Random(1), sh.masks(4)
    assert len(masks) == 31
    for _ in range(3000):
        d = sum(1 << b for b in r.sample(range(64), r.randrange(1, 5)))
        assert any(d & m == 0 for m in masks)


def test_fingerprints_and_components(table, odd):
    r = random.Random(2)
    base = " ".join(f"w{r.randrange(300)}" for _ in range(300))
    near = []
    for k in range(30):
        w = base.split()
        for _ in range(k % 4):
            w[r.randrange(300)] = f"e{k}"
        near.append(" ".join(w).upper() if k % 3 else " ".join(w))
    texts = [*odd, *near, " ".join(f"z{i}" for i in range(50))]
    rows = {x.id: x for x in sh.near_duplicates(table(texts)).collect()}
    fps = [plain(t) for t in texts]
    assert [rows[i].fp % (1 << 64) for i in range(len(texts))] == fps
    assert [rows[i].component_id for i in range(len(texts))] == groups(fps, range(len(texts)))


def test_links_of_large_buckets_join_the_same(spark):
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(20)}
    for f in [*fps]:
        for _ in range(12):
            f ^= sum(1 << b for b in r.sample(range(64), r.randrange(1, 6)))
            fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    want = groups(fps, range(len(fps)))
    for whole in (2, 5, 1000):
        got = {x.node % (1 << 64): x.root % (1 << 64) for x in components(sh.links(df, whole=whole)).collect()}
        same: dict = {}
        for f, w in zip(fps, want):
            same.setdefault(got.get(f, f), set()).add(w)
        assert all(len(v) == 1 for v in same.values()) and len(same) == len(set(want))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_one_of_each_group_stays(table, odd):
    docs = table([*odd, odd[6]], [*range(len(odd)), 6])
    got = sh.keep_one(docs)
    ids = sorted(r.doc_id for r in got.select("doc_id").collect())
    comp = sh.near_duplicates(docs).select("component_id").distinct()
    assert ids == sorted(r.component_id for r in comp.collect()) and got.columns == docs.columns
    assert sh.keep_one(table([])).count() == 0
    assert np.bitwise_count(np.uint64(7)) == 3 and got.where(F.col("doc_id") == 6).count() == 1


def test_one_row_of_each_component_with_repeated_and_null_ids(table):
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    kept = lambda texts, ids: sorted((r.doc_id, r.text) for r in sh.keep_one(table(texts, ids).select("doc_id", "text")).collect())
    assert kept([a, b], [1, 1]) == [(1, a), (1, b)]  # unrelated texts under one id
    assert kept([a, a, b], [0, 1, 1]) == [(0, a), (1, b)]  # the copy under 1 goes
    assert len(kept([None, ""], [5, 5])) == 1
    lost = sh.keep_one(table([c, c, a, None, ""], [None, None, None, 5, None]).select("doc_id", "text")).collect()
    assert sorted((r.doc_id is None, r.text or "") for r in lost) == [(False, ""), (True, a), (True, c)]
