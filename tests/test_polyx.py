"""Runs of one byte, batch by batch: odd texts, and no time of a struct for each byte."""

import random
import time

import pytest

from strandloom.operators import polyx


def by_hand(s, x, left, identity):
    total = best = at = 0
    for i, c in enumerate((s or "") if left else (s or "")[::-1], 1):
        total += 1 if c == x else -2
        if total > best:
            best, at = total, i
    return at if at and s.count(x) / at >= identity else None


@pytest.mark.parametrize("left", [True, False])
@pytest.mark.parametrize("chunk", [1, 40, 1 << 20])
def test_runs_of_odd_texts(left, chunk, monkeypatch):
    monkeypatch.setattr(polyx, "CHUNK", chunk)
    r = random.Random(3)
    texts = ["", None, "A", "C", "", *("".join(r.choice("AAC") for _ in range(r.randrange(40))) for _ in range(300)), None, "AA\U0001f600éA", "é" * 9, "A\0A", ""]
    for some in (texts, texts[:300], [], [None], ["", None, ""]):
        for x in "Aé":
            for identity in (0, 0.7, 1.2):
                assert polyx.run_lengths(some, x, left, identity).to_pylist() == [by_hand(s, x, left, identity) for s in some]


def test_twenty_million_bytes_are_walked_in_seconds(spark):
    from pyspark.sql import functions as F

    text = F.concat(F.repeat(F.lit("CAAT"), 250), F.repeat(F.lit("A"), 30))
    df = spark.range(20_000).select(text.alias("s")).coalesce(1)
    run = polyx.run_length(F.col("s"), "A", False, 0.5)
    assert df.limit(5).select(run.alias("n")).distinct().collect()[0].n == 30
    began = time.monotonic()
    assert df.select(run.alias("n")).agg(F.sum("n")).first()[0] == 600_000
    assert time.monotonic() - began < 8  # 20 million bytes; a struct for each takes several times as long
