import hashlib
import math

from strandloom.llm import mixing


def draws(docs, weights, total=1.0, seed="mix"):
    """(id, copy) by plain arithmetic; docs: (id, text, source)."""
    size, out = {}, []
    for _, t, s in docs:
        size[s] = size.get(s, 0) + len(t or "")
    weight = {s: (1.0 if weights is None else weights.get(s, 0.0)) if size[s] else 0.0 for s in size}
    for i, _, s in docs:
        if not weight[s]:
            continue
        rate = weight[s] / sum(weight.values()) * sum(size.values()) * total / size[s]
        u = (int(hashlib.md5(f"{seed}:n:{'-' if i is None else i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        c, k = 0.0, 0
        while True:
            c += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            if c > u or k > rate + 12 * math.sqrt(rate) + 24:
                break
            k += 1
        out += [(i, j) for j in range(k)]
    return sorted(out, key=str)


def docs_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def got(df, **kw):
    return sorted(((r.doc_id, r.n) for r in mixing.mix(df.drop("copy").withColumnRenamed("n", "m"), **kw).selectExpr("doc_id", "copy n").collect()), key=str)


def test_counts_are_the_inverted_poisson(spark, table, odd):
    df = table([f"text {i} " * (i % 7) for i in range(300)] + odd)
    assert got(df) == draws(docs_of(df), None)
    w = spark.createDataFrame([("s0", 3.0), (None, 1.0)], "source string, weight double")
    assert got(df, weights=w, total=4.0) == draws(docs_of(df), {"s0": 3.0, None: 1.0}, 4.0)


def test_sources_reach_their_weights(spark, table):
    df = table(["x" * 50] * 6000)
    w = spark.createDataFrame([("s0", 1.0), ("s1", 2.0), (None, 1.0)], "source string, weight double")
    rows = mixing.mix(df.drop("copy"), weights=w).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in rows}
    assert abs(n["s1"] / sum(n.values()) - 0.5) < 0.03 and abs(n[None] / sum(n.values()) - 0.25) < 0.03


def test_large_rates_do_not_underflow(spark, table):
    df = table(["x"] * 50 + ["y" * 100000], ids=range(51)).drop("copy").selectExpr("doc_id", "text", "if(doc_id < 50, 'small', 'large') source", "n_chars")
    n = mixing.mix(df).where("source = 'small'").count()
    assert abs(n - 50_025) < 1500


def test_many_sources_go_by_the_salted_join(table, monkeypatch):
    df = table([f"text {i}" for i in range(200)] + [None, ""])
    want = got(df)
    monkeypatch.setattr(mixing, "BROADCAST_STEPS", 1)
    assert got(df) == want


def test_order_is_shuffled_and_clashing_names_stay(table):
    df = table([f"text {i}" for i in range(300)])
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "place"]
    ids = [r.doc_id for r in out.collect()]
    assert ids != sorted(ids) and mixing.mix(table([])).count() == 0


def test_a_rate_of_a_million(spark):
    import time

    rows = [(i, "x", "few") for i in range(3)] + [(i, "x" * 3_000, "much") for i in range(3, 1003)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    w = spark.createDataFrame([("few", 1.0)], "source string, weight double")
    began = time.monotonic()
    n = {r.doc_id: r["count"] for r in mixing.mix(df, weights=w, ordered=False).groupBy("doc_id").count().collect()}
    assert set(n) == {0, 1, 2} and all(abs(x - 1_000_001) < 6_000 for x in n.values()) and len(set(n.values())) == 3
    assert time.monotonic() - began < 60


def test_sums_of_draws_are_poisson(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART", 5)
    rows = [(i, "x" * 10, "a") for i in range(500)] + [(1000 + i, "x" * 10, "b") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    w = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    copies = mixing.mix(df, weights=w, total=16.0).collect()
    n = [0] * 500
    for r in copies:
        n[r.doc_id] += 1
    assert sorted((r.doc_id, r.copy) for r in copies) == [(i, c) for i in range(500) for c in range(n[i])]
    mean = sum(n) / 500
    assert abs(mean - 32) < 1 and 24 < sum((x - mean) ** 2 for x in n) / 499 < 41


def test_a_rate_beyond_the_most_fails(spark):
    import pytest

    df = spark.createDataFrame([(0, "x", "few"), (1, "x" * 1000, "much")], "doc_id bigint, text string, source string")
    with pytest.raises(Exception, match="beyond"):
        mixing.mix(df, weights=spark.createDataFrame([("few", 1.0)], "source string, weight double"), total=1e9).count()
