"""Making reads of documents: the same as the SQL says, in tasks whose share does not grow with the table."""

import pytest
from pyspark.sql import functions as F

from strandloom import queries

TEXTS = ["", None, "abc", " .-7", "İK ſ Äz" * 9, "Ab cd" * 60, "x" * 100, "y" * 201, "\U0001f600q\0" * 150]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("few"))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 40)], "doc_id bigint, text string")
    rows.coalesce(1).write.parquet(f"{to}/documents.parquet")
    return to


def by_hand(spark, folder):
    got = {}
    for doc, text in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.lower("text")).collect():
        letters = "".join("ACGT"[(ord(c) - 97) % 4] for c in text or "" if "a" <= c <= "z")
        for k in range(0, len(letters), 100):
            s = letters[k : k + 100]
            got[doc * 1000000 + k // 100] = (f"doc{doc}.{k // 100}", s, s.translate(str.maketrans("ACGT", "IH5+")))
    return got


def made(spark, folder):
    rows = queries.reads(spark, folder).flat(idx="idx", name="{name1.*}", seq="{seq1.*}", qual="seq1.*:qual").collect()
    assert len({r.idx for r in rows}) == len(rows)
    return {r.idx: (r.name, r.seq, r.qual) for r in rows}


def test_reads_of_odd_texts(spark, folder, monkeypatch):
    want = by_hand(spark, folder)
    assert made(spark, folder) == want and want


def test_a_larger_table_is_more_tasks_of_the_same_share(spark, folder, monkeypatch):
    size = sum(f.length for f in spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{folder}/documents.parquet").select("length").collect())
    cores = spark.sparkContext.defaultParallelism
    assert queries.reads(spark, folder).df.rdd.getNumPartitions() == cores
    monkeypatch.setattr(queries, "PART", size // (3 * cores))
    assert queries.reads(spark, folder).df.rdd.getNumPartitions() >= 3 * cores
    assert made(spark, folder) == by_hand(spark, folder)
    kept, _ = queries.reads(spark, folder).fork()
    kept.df.count()
    tasks = kept.df.select(F.spark_partition_id().alias("p")).groupBy("p").count().count()
    kept.release()
    assert tasks > 2 * cores


def test_a_long_text_costs_no_more_than_its_length(spark, tmp_path):
    import time

    text = "caddab" * 1_000_000  # GATTAC
    spark.createDataFrame([(0, text), (1, "aaacaddab"), (2, "c")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.monotonic()
    got = queries.fastq_two_sinks(spark, str(tmp_path)).groupBy("side").agg(F.count("*"), F.max("idx"), F.sum(F.length("seq1"))).orderBy("side").collect()
    took = time.monotonic() - began  # with each read counted off from the text's start, 180 billion characters are walked
    starts_a = sum(k * 100 % 6 in (1, 4) for k in range(60_000))
    assert [tuple(r) for r in got] == [("a", starts_a + 1, starts_a, 100 * starts_a + 9), ("b", 60_000 - starts_a, 59_999 - starts_a, 100 * (60_000 - starts_a))]
    assert took < 40
