"""The registered queries of the reads engine, with the SQL that says the same.

Documents become reads: the letters of a whole text are written in ACGT and cut into reads of 100 bases. Conversations
become mate pairs: a turn of even number and the one that answers it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    Count, Exact, ExactPrefix, ExactSearch, ExactSuffix, Frac, GlobalAln, Hamming, HammingPrefix, HammingSearch, HammingSuffix, LocalAln,
    Patterns, PrefixAln, Reads, SuffixAln, left_end, right_end,
)
from .errors import StrandError
from .record import Read
from .sources.shared import folder
from .sources.sink import records

SIZE = 100
_ABC, _DNA = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
#: A task for so many bytes of a table's files (a text has about twice as many, its reads ten times), and so many bytes of text cut at a time.
PART, CHUNK = 16 << 20, 4 << 20


def _dna(c):
    return F.translate(F.regexp_replace(F.lower(c), "[^a-z]", ""), _ABC, _DNA)


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """A table over all cores and over a task for every PART bytes of its files, so that a task's share does not grow with
    the table; one of as many files already as it is."""
    spark, leaves = df.sparkSession, df._jdf.queryExecution().analyzed().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // PART))
    return df.repartition(tasks) if len(df.inputFiles()) < tasks else df


_TO_DNA, _TO_QUAL = bytes.maketrans(_ABC.encode(), _DNA.encode()), bytes.maketrans(b"ACGT", b"IH5+")
_NO_LETTER = bytes(set(range(256)) - set(_ABC.encode()))


def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, k, seq and qual of each read of doc_id and text (in small letters), about CHUNK bytes of text at a time."""
    for batch in batches:
        ids, texts, at = batch["doc_id"], batch["text"].cast(pa.binary()).to_pylist(), 0
        while at < len(texts):
            whole, size, first = [], 0, at
            while at < len(texts) and size < CHUNK:
                whole.append((texts[at] or b"").translate(_TO_DNA, _NO_LETTER))
                size += len(texts[at] or b"")
                at += 1
            sizes = np.array([len(x) for x in whole], np.int64)
            n = -(-sizes // SIZE)
            owner = np.repeat(np.arange(len(whole)), n)
            k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            ends = np.append((np.cumsum(sizes) - sizes)[owner] + k * SIZE, sizes.sum()).astype(np.int32)
            data = b"".join(whole)
            seq, qual = (pa.StringArray.from_buffers(len(k), pa.py_buffer(ends), pa.py_buffer(x)) for x in (data, data.translate(_TO_QUAL)))
            yield pa.record_batch({"doc_id": ids.take(pa.array(first + owner)), "k": pa.array(k.astype(np.int32)), "seq": seq, "qual": qual})


def reads(spark: SparkSession, sf_dir: str) -> Reads:
    whole = _spread(_table(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.lower("text").alias("text"))
    kind = whole.schema["doc_id"].dataType.simpleString()
    rows = whole.mapInArrow(cut_up, f"doc_id {kind}, k int, seq string, qual string")
    rows = rows.select((F.col("doc_id") * 1000000 + F.col("k")).alias("idx"), F.concat(F.lit("doc"), "doc_id", F.lit("."), "k").alias("name"), "seq", "qual")
    return Reads.from_dataframe(rows, "idx", name1="name", seq1="seq", qual1="qual")


def pairs(spark: SparkSession, sf_dir: str) -> Reads:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", _dna(F.col("text")).alias("s"))
    even = turns.where("turn % 2 = 0").alias("a")
    both = even.join(turns.alias("b"), F.expr("a.conv_id = b.conv_id and b.turn = a.turn + 1"))
    rows = both.selectExpr("a.conv_id * 1000 + a.turn as idx", "concat('c', a.conv_id, '/1') as n1", "a.s as s1", "concat('c', a.conv_id, '/2') as n2", "b.s as s2")
    return Reads.from_dataframe(rows, "idx", name1="n1", seq1="s1", qual1=F.translate("s1", "ACGT", "IH5+"), name2="n2", seq2="s2", qual2=F.translate("s2", "ACGT", "IH5+"))


READS = f"""WITH src AS (SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{_ABC}', '{_DNA}') AS s FROM documents),
cutup AS (SELECT doc_id, s, unnest(range(0, (length(s) + {SIZE - 1}) // {SIZE})) AS k FROM src),
r0 AS (SELECT doc_id * 1000000 + k AS idx, 'doc' || doc_id || '.' || k AS name1, substr(s, k * {SIZE} + 1, {SIZE}) AS seq1 FROM cutup),
reads AS (SELECT *, translate(seq1, 'ACGT', 'IH5+') AS qual1, length(seq1) AS n FROM r0)
"""
PAIRS = f"""WITH t AS (SELECT conv_id, turn, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{_ABC}', '{_DNA}') AS s FROM conversations),
pairs AS (SELECT a.conv_id * 1000 + a.turn AS idx, 'c' || a.conv_id || '/1' AS n1, a.s AS s1, 'c' || a.conv_id || '/2' AS n2, b.s AS s2
  FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0)
"""
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, base: str = READS):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = base + sql
        return f

    return add


@query("SELECT idx, instr(seq1, 'GATTC')::BIGINT - 1 AS at FROM reads WHERE contains(seq1, 'GATTC')")
def retain_sel(spark, d):
    got = reads(spark, d).match_one("", "seq1.* -> _, seq1.m, _", "GATTC", ExactSearch)
    return got.retain("seq1.m").flat(idx="idx", at="seq1.m:start")


@query("""SELECT idx, name1 FROM reads WHERE (starts_with(seq1, 'AC') AND NOT ends_with(seq1, 'A')) OR (n > 50 AND contains(seq1, 'TTTT'))""")
def selector_bool(spark, d):
    got = reads(spark, d).match_one("", "seq1.* -> seq1.p, _", "AC", ExactPrefix).match_one("", "seq1.* -> _, seq1.s", "A", ExactSuffix)
    got = got.match_one("", "seq1.* -> _, seq1.f, _", "TTTT", ExactSearch).length_in_bounds("", "seq1.* -> seq1.*.long", (51, None))
    return got.retain("(seq1.p & !seq1.s) | (seq1.*.long & seq1.f)").flat(idx="idx", name1="{name1.*}")


@query("SELECT idx, seq1 FROM reads WHERE idx BETWEEN 5000000 AND 299999999")
def take_range(spark, d):
    return reads(spark, d).take(range(5_000_000, 300_000_000)).flat(idx="idx", seq1="{seq1.*}")


@query("SELECT idx, n BETWEEN 40 AND 99 AS fits FROM reads")
def length_in_bounds(spark, d):
    return reads(spark, d).length_in_bounds("", "seq1.* -> seq1.*.fits", range(40, 100)).flat(idx="idx", fits="seq1.*.fits?")


@query("SELECT idx, substr(seq1, 1, 12) AS a, substr(seq1, 13) AS b, substr(qual1, 13) AS bq FROM reads")
def cut_left(spark, d):
    got = reads(spark, d).cut("", "seq1.* -> seq1.a, seq1.b", left_end(12))
    return got.flat(idx="idx", a="{seq1.a}", b="{seq1.b}", bq="seq1.b:qual")


@query("SELECT idx, greatest(n - 12, 0)::BIGINT AS a_len, least(n, 12)::BIGINT AS b_len, greatest(n - 12, 0)::BIGINT AS b_start FROM reads")
def cut_right(spark, d):
    got = reads(spark, d).cut("", "seq1.* -> seq1.a, seq1.b", right_end(12))
    return got.flat(idx="idx", a_len="seq1.a:len", b_len="seq1.b:len", b_start="seq1.b:start")


_TWO = """, two AS (SELECT *, 0 AS a_start, least(n, 60) AS a_end, n - least(n, 50) AS b_start, n AS b_end FROM reads)
"""


def _two(spark, d) -> Reads:
    return reads(spark, d).cut("", "seq1.* -> seq1.a, _", left_end(60)).cut("", "seq1.* -> _, seq1.b", right_end(50))


@query(_TWO + """SELECT idx, CASE WHEN hit THEN greatest(a_start, b_start)::BIGINT END AS start, CASE WHEN hit THEN (least(a_end, b_end) - greatest(a_start, b_start))::BIGINT END AS len
FROM (SELECT *, (b_start <= a_start AND a_start < b_end) OR (a_start <= b_start AND b_start < a_end) AS hit FROM two)""")
def intersect_labels(spark, d):
    return _two(spark, d).intersect("", "seq1.a, seq1.b -> seq1.x").flat(idx="idx", start="seq1.x:start", len="seq1.x:len")


@query(_TWO + "SELECT idx, least(a_start, b_start)::BIGINT AS start, (greatest(a_end, b_end) - least(a_start, b_start))::BIGINT AS len FROM two")
def union_labels(spark, d):
    return _two(spark, d).union("", "seq1.a, seq1.b -> seq1.x").flat(idx="idx", start="seq1.x:start", len="seq1.x:len")


@query("""SELECT idx, substr(seq1, 1, a) || substr(seq1, b + 1) AS seq1, a::BIGINT AS mid_start, 0::BIGINT AS mid_len, a::BIGINT AS tail_start, (n - b)::BIGINT AS tail_len
FROM (SELECT *, least(n, 20) AS a, least(n, 45) AS b FROM reads)""")
def trim_label(spark, d):
    got = reads(spark, d).cut("", "seq1.* -> _, seq1.rest", left_end(20)).cut("", "seq1.rest -> seq1.mid, seq1.tail", left_end(25)).trim("", "seq1.mid")
    return got.flat(idx="idx", seq1="{seq1.*}", mid_start="seq1.mid:start", mid_len="seq1.mid:len", tail_start="seq1.tail:start", tail_len="seq1.tail:len")


@query("""SELECT idx, 'GG' || substr(seq1, 1, 4) || substr(seq1, 9) AS seq1, (2 + least(n, 4))::BIGINT AS bc_len, (2 + least(n, 4))::BIGINT AS rest_start, name1 || '_' || substr(seq1, 1, 8) AS name1 FROM reads""")
def set_label(spark, d):
    got = reads(spark, d).cut("", "seq1.* -> seq1.bc, seq1.rest", left_end(8)).cut("", "seq1.bc -> seq1.four, _", left_end(4))
    got = got.set("", "name1.*", "{name1.*}_{seq1.bc}").set("", "seq1.bc", "GG{seq1.four}")
    return got.flat(idx="idx", seq1="{seq1.*}", bc_len="seq1.bc:len", rest_start="seq1.rest:start", name1="{name1.*}")


@query("SELECT idx, '<' || name1 || ':' || substr(seq1, 1, 5) || '>' AS note FROM reads")
def set_attr(spark, d):
    got = reads(spark, d).cut("", "seq1.* -> seq1.a, _", left_end(5)).set("", "seq1.a.note", "<{name1.*}:{seq1.a}>")
    return got.flat(idx="idx", note="{seq1.a.note}")


@query("SELECT idx, 'AAAA' || repeat('N', least(n, 7)::INTEGER) || '{' || repeat(substr(seq1, 1, 3), 2) AS x FROM reads")
def format_repeat(spark, d):
    got = reads(spark, d).cut("", "seq1.* -> seq1.a, _", left_end(7)).cut("", "seq1.a -> seq1.b, _", left_end(3))
    return got.flat(idx="idx", x=r"{'A'; 4}{'N'; |seq1.a|}\{{seq1.b; 2}")


_FOUR = ["ACGT", "GATA", "TTGA", "CATG"]


def _case(test: str, patterns=_FOUR, value="{i}", other="NULL") -> str:
    return "CASE " + " ".join(f"WHEN {test.format(p=p)} THEN {value.format(i=i, p=p, n=len(p))}" for i, p in enumerate(patterns)) + f" ELSE {other} END"


@query(f"SELECT idx, coalesce({_case("substr(seq1, 1, 4) = '{p}'", value="'{p}'")}, 'false') AS p FROM reads")
def match_exact(spark, d):
    got = reads(spark, d).cut("", "seq1.* -> seq1.bc, _", left_end(4)).match_any("", "seq1.bc -> seq1.hit", Patterns.of("p", _FOUR), Exact)
    return got.flat(idx="idx", p="{seq1.bc.p}")


_SHORT = ["AC", "ACGT", "G"]


@query(f"SELECT idx, {_case("starts_with(seq1, '{p}')", _SHORT, "{n}::BIGINT")} AS a_len, n::BIGINT - {_case("starts_with(seq1, '{p}')", _SHORT, "{n}")} AS b_len FROM reads")
def match_exact_prefix(spark, d):
    got = reads(spark, d).match_any("", "seq1.* -> seq1.a, seq1.b", Patterns.of("p", _SHORT), ExactPrefix)
    return got.flat(idx="idx", a_len="seq1.a:len", b_len="seq1.b:len")


@query(f"SELECT idx, n::BIGINT - {_case("ends_with(seq1, '{p}')", _SHORT, "{n}")} AS b_start, {_case("ends_with(seq1, '{p}')", _SHORT, "{n}::BIGINT")} AS b_len FROM reads")
def match_exact_suffix(spark, d):
    got = reads(spark, d).match_any("", "seq1.* -> seq1.a, seq1.b", Patterns.of("p", _SHORT), ExactSuffix)
    return got.flat(idx="idx", b_start="seq1.b:start", b_len="seq1.b:len")


@query(f"SELECT idx, {_case("contains(seq1, '{p}')", ["GATTC", "TTTT", "CCC"], "instr(seq1, '{p}')::BIGINT - 1")} AS at, coalesce({_case("contains(seq1, '{p}')", ["GATTC", "TTTT", "CCC"], "'{p}'")}, 'false') AS p FROM reads")
def match_exact_search(spark, d):
    got = reads(spark, d).match_any("", "seq1.* -> seq1.l, seq1.m, seq1.r", Patterns.of("p", ["GATTC", "TTTT", "CCC"]), ExactSearch)
    return got.flat(idx="idx", at="seq1.m:start", p="{seq1.*.p}")


def _ham(s: str, p: str, least: int) -> str:
    """Equal bases of a window with a pattern, null below the least or where it does not fit."""
    got = f"CASE WHEN length({s}) = {len(p)} THEN {len(p)} - hamming({s}, '{p}') END"
    return f"CASE WHEN {got} >= {least} AND {got} > 0 THEN {got} END"


@query(f"SELECT idx, {_ham("substr(seq1, 1, 8)", "ACGTACGT", 3)} IS NOT NULL AS hit FROM reads")
def match_hamming(spark, d):
    got = reads(spark, d).cut("", "seq1.* -> seq1.bc, _", left_end(8)).match_any("", "seq1.bc -> seq1.h", Patterns.of("p", ["ACGTACGT"]), Hamming(Count(3)))
    return got.flat(idx="idx", hit="seq1.bc.p?")


@query(f"SELECT idx, CASE WHEN {_ham("substr(seq1, 1, 10)", "GATTACAGAT", 5)} IS NOT NULL THEN n::BIGINT - 10 END AS rest FROM reads")
def match_hamming_prefix(spark, d):
    return reads(spark, d).match_one("", "seq1.* -> _, seq1.rest", "GATTACAGAT", HammingPrefix(Frac(0.5))).flat(idx="idx", rest="seq1.rest:len")


@query(f"SELECT idx, CASE WHEN n >= 10 THEN CASE WHEN {_ham("substr(seq1, n - 9, 10)", "GATTACAGAT", 5)} IS NOT NULL THEN n::BIGINT - 10 END END AS at FROM reads")
def match_hamming_suffix(spark, d):
    return reads(spark, d).match_one("", "seq1.* -> _, seq1.m", "GATTACAGAT", HammingSuffix(Frac(0.5))).flat(idx="idx", at="seq1.m:start")


@query("""SELECT idx, CASE WHEN list_max(h) >= 6 THEN list_position(h, list_max(h))::BIGINT - 1 END AS at
FROM (SELECT idx, list_transform(range(0, n - 7), lambda i: 8 - hamming(substr(seq1, i + 1, 8), 'GATTACAG')) AS h FROM reads)""")
def match_hamming_search(spark, d):
    return reads(spark, d).match_one("", "seq1.* -> _, seq1.m, _", "GATTACAG", HammingSearch(Frac(0.75))).flat(idx="idx", at="seq1.m:start")


@query("""SELECT idx, regexp_matches(seq1, 'GA(T+)C') AS hit, CASE WHEN regexp_matches(seq1, 'GA(T+)C') THEN (instr(seq1, regexp_extract(seq1, 'GAT+C', 0)) + 1)::BIGINT END AS at,
CASE WHEN regexp_matches(seq1, 'GA(T+)C') THEN length(regexp_extract(seq1, 'GA(T+)C', 1))::BIGINT END AS len FROM reads""")
def match_regex(spark, d):
    got = reads(spark, d).match_regex("", "seq1.* -> seq1.*.hit", "GA(?P<ts>T+)C")
    return got.flat(idx="idx", hit="seq1.*.hit?", at="seq1.ts:start", len="seq1.ts:len")


@query("""SELECT r.idx, CASE WHEN m.best > 0 AND length(replace(replace(replace(r.seq1, 'C', ''), 'G', ''), 'T', '')) / m.at >= 0.7 THEN n::BIGINT - m.at::BIGINT END AS start FROM reads r JOIN (
  SELECT idx, max(s) AS best, arg_min(i, (-s, i)) AS at FROM (
    SELECT idx, i, sum(CASE WHEN c = 'A' THEN 1 ELSE -2 END) OVER (PARTITION BY idx ORDER BY i) AS s
    FROM (SELECT idx, i, substr(seq1, n - i + 1, 1) AS c FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM reads))) GROUP BY idx) m USING (idx)""")
def match_polyx(spark, d):
    return reads(spark, d).match_polyx("", "seq1.* -> _, seq1.run", "A", False, 0.7).flat(idx="idx", start="seq1.run:start")


_YAML = """
name: plate
patterns:
  - {pattern: "ACGT", well: !UInt 3, pool: !String a, ctrl: !Bool true}
  - {pattern: "GATA", well: !UInt 0, pool: !String b, ctrl: !Bool false}
  - {pattern: "CC", well: !UInt 7, pool: !String c, ctrl: !Bool false}
"""
_YP = ["ACGT", "GATA", "CC"]
_PICK = _case("starts_with(seq1, '{p}')", _YP)


@query(f"""SELECT idx, coalesce(['ACGT', 'GATA', 'CC'][k + 1], 'false') AS plate, ['3', '0', '7'][k + 1] AS well, ['a', 'b', 'c'][k + 1] AS pool, ['true', 'false', 'false'][k + 1] AS ctrl
FROM (SELECT idx, {_PICK} AS k FROM reads)""")
def match_any_attrs(spark, d):
    got = reads(spark, d).match_any("", "seq1.* -> seq1.bc, _", _YAML, ExactPrefix)
    return got.flat(idx="idx", plate="{seq1.*.plate}", well="{seq1.*.well}", pool="{seq1.*.pool}", ctrl="{seq1.*.ctrl}")


@query("SELECT count(*) FILTER (starts_with(seq1, 'AC')) AS n_prefix, count(*) FILTER (n = 100) AS n_full, count(*) AS n_all FROM reads")
def count_selectors(spark, d):
    got = reads(spark, d).match_one("", "seq1.* -> seq1.p, _", "AC", ExactPrefix).length_in_bounds("", "seq1.* -> seq1.*.full", (100, 100))
    seen: list[int] = []
    got.count(["seq1.p", "seq1.*.full", ""], seen.extend).run()
    return spark.createDataFrame([tuple(seen)], "n_prefix bigint, n_full bigint, n_all bigint")


@query("SELECT idx, ('0x' || substr(md5(idx || ':7'), 1, 8))::BIGINT < 0.3::DOUBLE * 4294967296 AS kept FROM reads")
def bernoulli(spark, d):
    return reads(spark, d).bernoulli("", "seq1.*.kept", 0.3, 7).flat(idx="idx", kept="seq1.*.kept?")


@query("SELECT idx, 'left' AS side, name1 || '_' || substr(seq1, 1, 3) AS text FROM reads UNION ALL SELECT idx, 'right', substr(seq1, 4) FROM reads")
def fork_two(spark, d):
    a, b = reads(spark, d).cut("", "seq1.* -> seq1.a, _", left_end(3)).boxed().fork()
    one = a.set("", "name1.*", "{name1.*}_{seq1.a}").flat(idx="idx", side="left", text="{name1.*}")
    return one.union(b.trim("", "seq1.a").flat(idx="idx", side="right", text="{seq1.*}"))


def _reverse(read) -> None:
    read.set("seq1.*", read.substring("seq1.*")[::-1], read.substring_qual("seq1.*")[::-1])
    read.set_data("seq1.*.done", True)


@query("SELECT idx, CASE WHEN starts_with(seq1, 'AC') THEN reverse(seq1) ELSE seq1 END AS seq1 FROM reads")
def for_each(spark, d):
    got = reads(spark, d).match_one("", "seq1.* -> seq1.p, _", "AC", ExactPrefix)
    return got.for_each("seq1.p", _reverse, attrs=["seq1.*.done"]).flat(idx="idx", seq1="{seq1.*}")


@query("SELECT idx, n1 AS name1, s1 AS seq1, n2 AS name2, substr(s2, 1, 10) AS head2 FROM pairs", PAIRS)
def fastq_pairs(spark, d):
    return pairs(spark, d).cut("", "seq2.* -> seq2.h, _", left_end(10)).flat(idx="idx", name1="{name1.*}", seq1="{seq1.*}", name2="{name2.*}", head2="{seq2.h}")


@query("SELECT idx, '@' || name1 || chr(10) || seq1 || chr(10) || '+' || chr(10) || qual1 || chr(10) AS record FROM reads")
def collect_fastq_text(spark, d):
    return records(reads(spark, d), "", ("out.fastq",)).select("idx", "record")


@query("SELECT 'out/' || CASE WHEN length(substr(s1, 1, 2)) = 2 THEN substr(s1, 1, 2) ELSE 'short' END || '.fastq.gz' AS path, 2 * count(*) AS n FROM pairs GROUP BY 1", PAIRS)
def demux_paths(spark, d):
    got = pairs(spark, d).cut("", "seq1.* -> seq1.bc, _", left_end(2)).length_in_bounds("", "seq1.bc -> seq1.bc.ok", (2, 2))
    got = got.set("", "seq1.bc.dir", "{seq1.bc}").set("!seq1.bc.ok", "seq1.bc.dir", "short")
    path = "out/{seq1.bc.dir}.fastq.gz"
    return records(got, "", (path, path)).groupBy("path").agg(F.count("*").alias("n"))


_ADAPTER = Patterns.of("adapter", ["GATTACAGATTACA", "ACGTTGCAACGT"])


def _align_sql(source: str, name: str, pattern: str, start: str = "both", end: str = "both") -> str:
    """CTEs that align a pattern with each distinct s of ``source``, a CTE for each of its bytes; the last is ``name`` (s,
    score, equal, columns, start, stop). It starts with ``both``, somewhere in the ``read`` or at ``any`` place of both, and
    ends with ``both``, at any byte of the ``pattern`` with the read's end, or at ``any`` place. A cell is one number, so that the better of two
    is the greater: from the top its score, the way it came (2: both, 1: a gap in s), how far left it starts, equal columns,
    columns. A gap in the pattern is a running greatest along s."""
    number = lambda score, equal=0, columns=1: (score << 47) + (equal << 13) + columns
    opened, longer, clean, left = number(-2), number(-1), ~(3 << 45), (1 << 20) - 1
    zero = number(1 << 14, 0, 0)
    fresh = lambda j: f"({zero + (left << 25)} - ({j}) * {1 << 25})"  # noqa: E731  an alignment that starts at j
    local = start == "any"
    first = fresh("j") if start != "both" else f"{fresh(0)} + CASE WHEN j = 0 THEN 0 ELSE {number(-1, 0, 0)} + j * {longer} END"
    before = f"greatest(before, {fresh('j - 1')})" if local else "before"
    edge = f"greatest(up, {fresh(0)})" if local else "up"
    out = f"""{name}_0 AS (SELECT s, j, {first} AS cell, {zero // 2} AS up
  FROM (SELECT s, unnest(range(0, length(s) + 1)) AS j FROM (SELECT DISTINCT s FROM {source}))),"""
    for i, c in enumerate(pattern, 1):
        out += f"""
{name}_{i} AS MATERIALIZED (
  SELECT s, j, up, CASE WHEN j = 0 THEN base ELSE greatest(base, coalesce(side, 0) + {opened} + (j - 1) * {longer}) & {clean} END AS cell FROM (
    SELECT *, max((base & {clean}) - j * {longer}) OVER (PARTITION BY s ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS side FROM (
      SELECT s, j, up, CASE WHEN j = 0 THEN {edge} ELSE greatest(({before} + CASE WHEN substr(s, j, 1) = '{c}' THEN {number(1, 1)} ELSE {number(-1)} END) | {2 << 45}, up | {1 << 45}) END AS base FROM (
        SELECT s, j, greatest(cell + {opened}, up + {longer}) AS up, lag(cell) OVER (PARTITION BY s ORDER BY j) AS before FROM {name}_{i - 1})))),"""
    if end == "any":  # the best of all cells, the first of equals
        each = " UNION ALL ".join(f"SELECT s, max(cell) AS cell, {i} AS i, arg_max(j, (cell, -j)) AS j FROM {name}_{i} GROUP BY s" for i in range(len(pattern) + 1))
        ends = f"SELECT s, max(cell) AS cell, arg_max(j, (cell, -i)) AS stop FROM ({each}) GROUP BY s"
    elif end == "pattern":
        each = " UNION ALL ".join(f"SELECT s, cell FROM {name}_{i} WHERE j = length(s)" for i in range(len(pattern) + 1))
        ends = f"SELECT s, max(cell) AS cell, length(s) AS stop FROM ({each}) GROUP BY s"
    else:
        ends = f"SELECT s, cell, j AS stop FROM {name}_{len(pattern)} WHERE j = length(s)"
    return f"{out}\n{name} AS (SELECT s, (cell >> 47) - {1 << 14} AS score, (cell >> 13) & 4095 AS equal, cell & 8191 AS columns, {left} - ((cell >> 25) & {left}) AS start, stop FROM ({ends}))"


@query(f""", codes AS (SELECT idx, substr(seq1, 1, 14) AS s FROM reads),
{_align_sql("codes", "one", "GATTACAGATTACA")},
{_align_sql("codes", "two", "ACGTTGCAACGT")},
best AS (
  SELECT s, CASE WHEN a.equal / a.columns >= 0.5 THEN a.equal ELSE 0 END AS a, CASE WHEN b.equal / b.columns >= 0.5 THEN b.equal ELSE 0 END AS b FROM one a JOIN two b USING (s))
SELECT idx, CASE WHEN b > a AND a < 12 THEN 'ACGTTGCAACGT' WHEN a > 0 THEN 'GATTACAGATTACA' ELSE 'false' END AS adapter,
  CASE WHEN greatest(a, b) > 0 THEN length(s)::BIGINT END AS len FROM codes JOIN best USING (s)
""")
def aln_global(spark, d):
    got = reads(spark, d).cut("", "seq1.* -> seq1.bc, _", left_end(14)).match_any("", "seq1.bc -> seq1.hit", _ADAPTER, GlobalAln(0.5))
    return got.flat(idx="idx", adapter="{seq1.bc.adapter}", len="seq1.hit:len")


@query(f""", whole AS (SELECT idx, seq1 AS s FROM reads),
{_align_sql("whole", "one", "GATTACAGATTACA", "any", "any")},
{_align_sql("whole", "two", "ACGTTGCAACGT", "any", "any")},
best AS (
  SELECT s, CASE WHEN a.columns > 0 AND a.equal / a.columns >= 0.8 AND a.equal / 14 >= 0.6 THEN a.equal ELSE 0 END AS a,
    CASE WHEN b.columns > 0 AND b.equal / b.columns >= 0.8 AND b.equal / 12 >= 0.6 THEN b.equal ELSE 0 END AS b,
    a.start AS a_start, a.stop AS a_stop, b.start AS b_start, b.stop AS b_stop FROM one a JOIN two b USING (s)),
picked AS (SELECT *, CASE WHEN b > a AND a < 12 THEN 2 WHEN a > 0 THEN 1 END AS k FROM best)
SELECT idx, CASE k WHEN 2 THEN 'ACGTTGCAACGT' WHEN 1 THEN 'GATTACAGATTACA' ELSE 'false' END AS adapter,
  CASE k WHEN 2 THEN b_start WHEN 1 THEN a_start END::BIGINT AS start, CASE k WHEN 2 THEN b_stop - b_start WHEN 1 THEN a_stop - a_start END::BIGINT AS len
FROM whole JOIN picked USING (s)
""")
def aln_local(spark, d):
    got = reads(spark, d).match_any("", "seq1.* -> seq1.l, seq1.hit, seq1.r", _ADAPTER, LocalAln(0.8, 0.6))
    return got.flat(idx="idx", adapter="{seq1.*.adapter}", start="seq1.hit:start", len="seq1.hit:len")


def _end_sql(prefix: bool) -> str:
    """CTE ``picked`` (idx, n, k, at): which pattern, if any, has an end of the read, and how many bytes of it."""
    out = ""
    for name, pattern, width in (("one", "GATTACAGATTACA", 19), ("two", "ACGTTGCAACGT", 16)):
        side = f"reverse(substr(seq1, 1, {width}))" if prefix else f"right(seq1, {width})"
        p = pattern[::-1] if prefix else pattern
        short = "stop < length(s) AND score > 0"
        out += f""", {name}_src AS (SELECT idx, {side} AS s FROM reads),
{_align_sql(f"{name}_src", f"{name}_a", p, "read", "any")},
{name}_left AS (SELECT substr(s, start + 1) AS s FROM {name}_a WHERE {short}),
{_align_sql(f"{name}_left", f"{name}_b", p, "both", "pattern")},
{name}_all AS (SELECT a.s, a.start, coalesce(b.equal, a.equal) AS equal, coalesce(b.columns, a.columns) AS columns
  FROM (SELECT *, CASE WHEN {short} THEN substr(s, start + 1) END AS rest FROM {name}_a) a LEFT JOIN {name}_b b ON b.s = a.rest),
{name} AS (SELECT idx, length(s) - start AS size, CASE WHEN columns > 0 AND equal / columns >= 0.7 AND equal / {len(p)} >= 0.4 THEN equal ELSE 0 END AS equal
  FROM {name}_src JOIN {name}_all USING (s))"""
    return f"""{out},
picked AS (SELECT idx, n, CASE WHEN b.equal > a.equal AND a.equal < 12 THEN 2 WHEN a.equal > 0 THEN 1 END AS k, CASE WHEN b.equal > a.equal AND a.equal < 12 THEN b.size ELSE a.size END AS size
  FROM reads JOIN one a USING (idx) JOIN two b USING (idx))
"""


_ADAPTERS = "CASE k WHEN 2 THEN 'ACGTTGCAACGT' WHEN 1 THEN 'GATTACAGATTACA' ELSE 'false' END AS adapter"


@query(f"{_end_sql(True)} SELECT idx, {_ADAPTERS}, CASE WHEN k > 0 THEN size::BIGINT END AS len FROM picked")
def aln_prefix(spark, d):
    got = reads(spark, d).match_any("", "seq1.* -> seq1.hit, seq1.r", _ADAPTER, PrefixAln(0.7, 0.4))
    return got.flat(idx="idx", adapter="{seq1.*.adapter}", len="seq1.hit:len")


@query(f"{_end_sql(False)} SELECT idx, {_ADAPTERS}, CASE WHEN k > 0 THEN (n - size)::BIGINT END AS start, CASE WHEN k > 0 THEN size::BIGINT END AS len FROM picked")
def aln_suffix(spark, d):
    got = reads(spark, d).match_any("", "seq1.* -> seq1.l, seq1.hit", _ADAPTER, SuffixAln(0.7, 0.4))
    return got.flat(idx="idx", adapter="{seq1.*.adapter}", start="seq1.hit:start", len="seq1.hit:len")


@query("""SELECT idx, name1 || '_' || substr(seq1, 1, 3) AS name1, substr(seq1, 4) AS seq1 FROM reads""")
def simple_protocol(spark, d):
    """Cut a barcode off, note it in the name."""
    got = reads(spark, d).cut("", "seq1.* -> seq1.a, seq1.b", left_end(3)).set("", "name1.*", "{name1.*}_{seq1.a}").trim("", "seq1.a")
    return got.flat(idx="idx", name1="{name1.*}", seq1="{seq1.*}")


_STEPS = 10


@query(f"""SELECT idx, name1 || {" || ".join(f"'_' || substr(seq1, {3 * i + 1}, 3)" for i in range(_STEPS))} AS name1, substr(seq1, {3 * _STEPS + 1}) AS seq1, 0::BIGINT AS first_len
FROM reads WHERE n - {3 * _STEPS} >= 10 AND NOT contains(substr(seq1, {3 * _STEPS + 1}), 'TTTT')""")
def long_protocol(spark, d):
    """Ten times a barcode is cut off, noted in the name and trimmed, and a filter stands on labels of the first and last step."""
    got = reads(spark, d)
    for i in range(_STEPS):
        got = got.cut("", f"seq1.* -> seq1.bc{i}, seq1.rest{i}", left_end(3)).set("", "name1.*", f"{{name1.*}}_{{seq1.bc{i}}}").trim("", f"seq1.bc{i}")
    last = f"seq1.rest{_STEPS - 1}"
    got = got.match_one("", f"{last} -> _, seq1.poly, _", "TTTT", ExactSearch).length_in_bounds("", f"{last} -> {last}.fits", (10, None))
    return got.retain(f"seq1.bc0 & {last}.fits & !seq1.poly").flat(idx="idx", name1="{name1.*}", seq1="{seq1.*}", first_len="seq1.bc0:len")


# files: written by the sinks to the folder that the cluster shares, and read back

_FEW = ", few AS (SELECT * FROM reads WHERE contains(seq1, 'GATTAC'))\n"


def _few(spark, d) -> Reads:
    return reads(spark, d).match_one("", "seq1.* -> _, seq1.m, _", "GATTAC", ExactSearch).retain("seq1.m")


@query(_FEW + "SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, name1, seq1, qual1 FROM few")
def fastq_single(spark, d):
    path = f"{folder(spark)}/all.fastq.gz"
    _few(spark, d).collect_fastq1("", path).run()
    return Reads.fastq1(spark, path).flat(idx="idx", name1="{name1.*}", seq1="{seq1.*}", qual1="seq1.*:qual")


@query(_FEW + "SELECT row_number() OVER (PARTITION BY substr(seq1, 1, 2) ORDER BY idx) - 1 AS idx, substr(seq1, 1, 2) || '.fastq' AS file, name1, seq1 FROM few")
def fastq_demux(spark, d):
    to = folder(spark)
    _few(spark, d).cut("", "seq1.* -> seq1.bc, _", left_end(2)).collect_fastq1("", to + "/{seq1.bc}.fastq").run_with_threads(4)
    file = F.substring_index(F.col("_seq1.origin"), "/", -1)
    return Reads.fastq1(spark, to).df.select(F.col("_seq1.idx").alias("idx"), file.alias("file"), F.col("_name1.str").alias("name1"), F.col("_seq1.str").alias("seq1"))


@query("SELECT 2 * (row_number() OVER (ORDER BY idx) - 1) AS idx, n1 AS name1, s1 AS seq1, n2 AS name2, s2 AS seq2 FROM pairs", PAIRS)
def fastq_interleaved(spark, d):
    path = f"{folder(spark)}/both.fastq"
    pairs(spark, d).collect_fastq2("", path, path).run()
    return Reads.fastq_interleaved(spark, path).flat(idx="idx", name1="{name1.*}", seq1="{seq1.*}", name2="{name2.*}", seq2="{seq2.*}")


@query("SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, n1 AS name1, s1 AS seq1, n2 AS name2, s2 AS seq2 FROM pairs", PAIRS)
def fastq_zip(spark, d):
    """Mates in two files, by paths with a scheme, which Spark's own readers and writers take."""
    to = folder(spark, scheme=True)
    pairs(spark, d).collect_fastq2("", f"{to}/1.fastq", f"{to}/2.fastq.gz").run()
    return Reads.fastq2(spark, f"{to}/1.fastq", f"{to}/2.fastq.gz").flat(idx="idx", name1="{name1.*}", seq1="{seq1.*}", name2="{name2.*}", seq2="{seq2.*}")


@query(_FEW + "SELECT row_number() OVER (PARTITION BY starts_with(seq1, 'A') ORDER BY idx) - 1 AS idx, CASE WHEN starts_with(seq1, 'A') THEN 'a' ELSE 'b' END AS side, seq1 FROM few")
def fastq_two_sinks(spark, d):
    """Two sinks of one chain, whose first steps are evaluated once."""
    to = folder(spark)
    got = _few(spark, d).match_one("", "seq1.* -> seq1.a, _", "A", ExactPrefix)
    got.collect_fastq1("seq1.a", f"{to}/a.fastq").collect_fastq1("!seq1.a", f"{to}/b.fastq").run()
    sides = [Reads.fastq1(spark, f"{to}/{x}.fastq").flat(idx="idx", side=x, seq1="{seq1.*}") for x in "ab"]
    return sides[0].union(sides[1])


# templates and patterns of a read itself

@query("""SELECT idx, repeat('AC', 3) || ';{}' AS x, repeat(substr(seq1, 1, 2), n % 4) AS y, repeat('N', 2 * length(substr(seq1, 1, 2))) AS z FROM reads""")
def format_counts(spark, d):
    """Repeats by an attribute, quotes with ; and braces, the length of an attribute's text."""
    got = reads(spark, d).cut("", "seq1.* -> seq1.a, _", left_end(2)).for_each("", _modulo, attrs=["seq1.*.n"])
    got = got.set("", "seq1.a.twice", "{seq1.a; 2}")
    return got.flat(idx="idx", x=r"{'AC'; 3}{';'}\{\}", y="{seq1.a; seq1.*.n}", z="{'N'; |seq1.a.twice|}")


def _modulo(read) -> None:
    read.set_data("seq1.*.n", len(read.substring("seq1.*")) % 4)


@query("""SELECT idx, 'GG' || substr(seq1, 1, 2) || 'TTT' || name1 || substr(seq1, 5) AS seq1, 'GG' || substr(qual1, 1, 2) || 'TTT' || repeat('I', length(name1)) || substr(qual1, 5) AS qual1 FROM reads""")
def set_quality(spark, d):
    """A template's qualities: a label's own where it has some, else I; literal text stands for itself."""
    got = reads(spark, d).cut("", "seq1.* -> seq1.a, _", left_end(4)).cut("", "seq1.a -> seq1.b, _", left_end(2))
    got = got.set("", "seq1.a", "GG{seq1.b}{'T'; 3}{name1.*}")
    return got.flat(idx="idx", seq1="{seq1.*}", qual1="seq1.*:qual")


@query("""SELECT idx, CASE WHEN n > 4 AND contains(substr(seq1, 5), substr(seq1, 1, 4)) THEN (3 + instr(substr(seq1, 5), substr(seq1, 1, 4)))::BIGINT END AS at,
CASE WHEN n >= 8 THEN 4 - hamming(substr(seq1, n - 3, 4), substr(seq1, 1, 4)) >= 3 ELSE false END AS ends FROM reads""")
def match_own_label(spark, d):
    """Patterns that the read itself gives: its first four bytes, again later and near its end."""
    got = reads(spark, d).cut("", "seq1.* -> seq1.bc, seq1.rest", left_end(4)).match_one("", "seq1.rest -> _, seq1.again, _", "{seq1.bc}", ExactSearch)
    got = got.match_any("", "seq1.rest -> _, _", Patterns.of("tail", ["{seq1.bc}"]), HammingSuffix(Count(3)))
    return got.flat(idx="idx", at="seq1.again:start", ends="seq1.rest.tail?")


# the record by itself, in a user function


def _by_hand(read) -> None:
    n = len(read.substring("seq1.*"))
    read.add_mapping("seq1.mid", min(n, 10), min(n, 30) - min(n, 10))
    start, size = read.mapping("seq1.mid")
    again = Read.from_fastq1(*read.to_fastq1(), idx=read.first_idx())
    same = again.substring("seq1.*") == read.strand("seq1").text and again.strand("seq1").qual == read.substring_qual("seq1.*")
    read.set_data("seq1.mid.note", read.format("{seq1.mid; 2}:{name1.*}"))
    kind, shared = read.relation("seq1.*", "seq1.mid")
    read.set_data("seq1.mid.seen", f"{start}+{size} {same} {kind} {shared} {read.matches('seq1.mid & !seq1.none')}")
    read.set_data("seq1.mid.picture", str(read).split("seq1\n")[-1].split("\n")[0])


@query("""SELECT idx, repeat(substr(seq1, 11, 20), 2) || ':' || name1 AS note,
least(n, 10) || '+' || (least(n, 30) - least(n, 10)) || ' True ' || CASE WHEN n <= 10 THEN 'ab 0' WHEN n <= 30 THEN 'ab ' || (n - 10) ELSE 'b inside a 20' END || ' True' AS seen,
'*     ' || CASE WHEN n = 1 THEN '|' ELSE '|' || repeat('-', n - 2) || '|' END AS picture FROM reads""")
def record_by_hand(spark, d):
    """A label made by hand, a record written and read again, a template, a selector, a relation and a picture."""
    got = reads(spark, d).for_each("", _by_hand, labels=["seq1.mid"], attrs=["seq1.mid.note", "seq1.mid.seen", "seq1.mid.picture"])
    return got.flat(idx="idx", note="{seq1.mid.note}", seen="{seq1.mid.seen}", picture="{seq1.mid.picture}")


_BAD = {
    "no such file": lambda spark: Reads.fastq1(spark, "/nowhere/at/all.fastq").collect(),
    "no mate": lambda spark: Reads.fastq_interleaved_bytes(spark, b"@a\nA\n+\nI\n"),
    "no record": lambda spark: Reads.fastq1_bytes(spark, b"@a\nAC\n+\nI\n"),
    "no expression": lambda spark: Reads.fastq1_bytes(spark, b"").retain("seq1.a &"),
    "no name": lambda spark: Reads.fastq1_bytes(spark, b"").cut("", "seq3.* -> seq1.a, _", left_end(1)),
    "open brace": lambda spark: Reads.fastq1_bytes(spark, b"").set("", "name1.*", "{seq1.*"),
    "no pattern list": lambda spark: Patterns.from_yaml("patterns: 3"),
    "never made": lambda spark: Reads.fastq1_bytes(spark, b"").trim("", "seq1.a"),
    "made twice": lambda spark: Reads.fastq1_bytes(spark, b"").cut("", "seq1.* -> seq1.a, seq1.a", left_end(1)),
    "not in this read": lambda spark: Reads.fastq1_bytes(spark, b"@a\nC\n+\nI\n").match_one("", "seq1.* -> _, seq1.m, _", "A", ExactSearch).trim("", "seq1.m").collect(),
    "nothing": lambda spark: Reads.fastq1_bytes(spark, b"@a\nC\n+\nI\n").cut("", "seq1.* -> seq1.a, _", left_end(1)).collect(),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {'false' if k == 'nothing' else 'true'})" for k in _BAD) + ") t(what, fails)", "")
def errors(spark, d):
    """What must fail, when the plan is built or when it runs."""
    from pyspark.errors import PySparkException

    rows = []
    for what, job in _BAD.items():
        try:
            job(spark)
            rows.append((what, False))
        except (StrandError, PySparkException):
            rows.append((what, True))
    return spark.createDataFrame(rows, "what string, fails boolean")
