"""Language-model scores by prediction by partial matching.

The model is a trie of byte contexts: for each context of up to ``order`` bytes, how often each byte (or the text's end)
followed it in the training documents. A byte's probability is its share in the longest context that was seen; a byte that
is new there costs an escape and is looked for one byte shorter, where the followers of the longer context, already ruled
out, are left out of the counts (symbol exclusion). Escapes are those of method D: of 2n chances, a follower seen c times
has 2c - 1 and an escape one for each follower. Below the longest contexts a follower counts once for each context one
longer that it follows (update exclusion). What no context has is spread evenly over the rest of the 257 symbols. A text's
score is the log10 probability of its bytes and its end, so the probabilities of all texts add up to 1.

The trie is a table of every order's entries, never in one place. Documents are dealt into chunks of about ``CHUNK_BYTES``;
each chunk asks for its distinct (context, symbol) keys, which are joined with the probabilities of all keys, and what was
asked for meets the chunk's texts again in one task. Keys that training has not seen go from order to order, one join each,
those that were found dropping out. Nothing of the model is sent to the driver or held whole by a task.

Adaptive scores (:func:`score_adaptive`) learn from the document itself alone, from an empty trie.

The unigram base: tokens are the words of the lower-cased (A-Z) text and one end. Words of the largest counts (at most
``FREQUENT``) are sent to the tasks; the others are shuffled to their counts.

Defined results: a null text counts as empty; an empty text is scored for its end. Without training documents every symbol
has probability 1/257 and every token 1/(N + V + 1) = 1. Repeated ids are scored row by row. A text is held whole by one
task, however long.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, documents, save

ORDER, END, BEFORE, SYMBOLS, BITS = 5, 256, 257, 257, 9
#: A chunk is scored so many bytes at a time.
FREQUENT, CHUNK, CHUNK_BYTES = 200_000, 1 << 19, 32 << 20


def contexts(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every symbol of the texts, itself and the ``order`` symbols before it as one number (its own bits lowest), and
    where each text's symbols begin."""
    if not texts:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    sizes = np.array([len(t) + 1 + order for t in texts], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(b"\0" * order + t + b"\0" for t in texts), np.uint8).astype(np.uint64)
    for k in range(order):
        data[at[:-1] + k] = BEFORE
    data[at[1:] - 1] = END
    key = data[order:].copy()
    for k in range(1, order + 1):
        key |= data[order - k : len(data) - k] << np.uint64(BITS * k)
    own = np.ones(len(data) - order, bool)
    for k in range(order):  # the places of the next text's padding
        own[at[1:-1] - order + k] = False
    starts = np.concatenate([[0], np.cumsum(sizes - order)])
    return key[own], starts


def chunks(batches, columns: tuple[str, ...]):
    """Lists of the columns' values, texts as bytes, of about CHUNK bytes of text at a time."""
    held, size = [[] for _ in columns], 0
    for batch in batches:
        texts = batch["text"].cast(pa.binary()).to_pylist()
        others = [batch[c].to_pylist() if c != "text" else texts for c in columns]
        for row in zip(*others, strict=True):
            for x, v in zip(held, row, strict=True):
                x.append(v)
            size += len(row[columns.index("text")])
            if size >= CHUNK:
                yield held
                held, size = [[] for _ in columns], 0
    if held[0]:
        yield held


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def count_contexts(docs: DataFrame, order: int = ORDER, by: str | None = None) -> DataFrame:
    """``docs``: text. Returns key (of the longest contexts) and n. ``by``: a column of whole numbers that lie together;
    then each of its numbers' distinct keys instead, as rows of it and key."""

    def count(batches):
        held, rows, most, now = [], 0, 1_000_000, 0

        def flush():
            keys, n = merged(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
            for s in range(0, len(keys), 100_000):
                k, m = keys[s : s + 100_000].view(np.int64), n[s : s + 100_000]
                yield pa.record_batch({"key": k, "n": m} if by is None else {by: np.full(len(k), now), "key": k})

        def texts_of():
            if by is None:
                for (texts,) in chunks(batches, ("text",)):
                    yield 0, texts
                return
            for texts, own in chunks(batches, ("text", by)):
                own = np.array(own)
                cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
                for a, b in zip(cuts, cuts[1:]):
                    yield int(own[a]), texts[a:b]

        for mine, texts in texts_of():
            if held and (mine != now or (rows > most and by is None)):
                yield from flush()
                held, rows, most = [], 0, 1_000_000
            elif rows > most:  # a chunk's keys are given once
                held = [merged(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))]
                rows = len(held[0][0])
                most = max(most, 2 * rows)
            now = mine
            keys = np.sort(contexts(texts, order)[0])
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            held.append((keys[first], np.diff(np.append(first, len(keys)))))
            rows += len(first)
        if held:
            yield from flush()

    if by is not None:
        return docs.select("text", F.col(by).cast("bigint").alias(by)).mapInArrow(count, f"{by} bigint, key bigint")
    return docs.select("text").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _shorter(key: Column, k: int) -> Column:
    """The key's symbol with the last k symbols before it."""
    return key.bitwiseAND(F.lit((1 << BITS * (k + 1)) - 1))


def _context(key: Column) -> Column:
    return F.shiftright(key, BITS)


def probabilities(counts: DataFrame, asked: DataFrame, order: int = ORDER) -> DataFrame:
    """``counts``: key and n of the longest contexts; ``asked``: distinct keys that are not among them. key and log (log10 of
    the probability of its symbol in its context) of all of them."""
    n, key = F.col("n"), F.col("key")
    whole = F.sum("n").over(Window.partitionBy(_context(key)))  # 257 rows at most
    done = [counts.select("key", F.log10((2 * n - 1) / (2 * whole)).alias("log"))]
    entries = {order: counts}
    for k in range(order - 1, -1, -1):
        entries[k] = save(entries[k + 1].groupBy(_shorter(key, k).alias("key")).agg(F.count("*").alias("n")))
    left = asked.select("key", F.lit(0.0).alias("log"), F.lit(0).cast("bigint").alias("ruled"), F.lit(0).cast("bigint").alias("gone"))
    for k in range(order, -1, -1):
        left = left.withColumn("own", _shorter(key, k)).withColumn("ctx", _context(F.col("own")))
        # the asked contexts: their counts in all, their followers, and the counts of these one byte shorter
        mine = entries[k].withColumn("ctx", _context(key)).join(left.select("ctx").distinct(), "ctx", "left_semi")
        if k:
            lower = entries[k - 1].select(F.col("key").alias("short"), F.col("n").alias("below"))
            mine = mine.withColumn("short", _shorter(key, k - 1)).join(lower, "short")
        else:
            mine = mine.withColumn("below", F.lit(0))
        info = mine.groupBy("ctx").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum("below").alias("next"))
        met = left.join(F.broadcast(info) if k < 2 else info, "ctx", "left")  # 258 contexts of one symbol at most
        if k < order:
            met = met.join(entries[k].select(key.alias("own"), "n"), "own", "left")
        else:
            met = met.withColumn("n", F.lit(None).cast("bigint"))
        rest, new = F.col("total") - F.col("ruled"), F.col("distinct") - F.col("gone")
        chance = F.when(n.isNotNull(), 2 * n - 1).otherwise(new)
        # nothing is left where all followers were ruled out: no choice, no cost
        log = F.col("log") + F.when(rest > 0, F.log10(chance / (2 * rest))).otherwise(0.0)
        met = save(met.select("key", log.alias("log"), n.isNotNull().alias("found"), F.coalesce("next", F.lit(0)).alias("ruled"), F.coalesce("distinct", F.lit(0)).alias("gone")))
        done.append(met.where("found").select("key", "log"))
        left = met.where("not found").drop("found")
    none = float(np.log10(SYMBOLS - entries[0].count()))  # 257 entries at most
    done.append(left.select("key", F.col("log") - F.lit(none)))
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


class _Table:
    """Look-up of 64-bit keys: slots by a multiplicative hash, the next free one on a clash."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.at = np.zeros(1 << bits, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            won = left[free]
            self.keys[slot[won]] = keys[won]
            self.at[slot[won]] = won
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among those given, or -1."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.at[slot], -1)
        left = np.flatnonzero((there != keys) & (there != np.uint64(0xFFFFFFFFFFFFFFFF)))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.at[slot[left[hit]]]
            left = left[~hit & (there != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out


def adaptive(texts: list[bytes], order: int = ORDER) -> list[float]:
    """log10 probability of each text by a trie that starts empty and learns each symbol after it was scored."""
    out = []
    for text in texts:
        seen: dict[tuple, Counter] = {}
        log, past = 0.0, []
        for s in [*text, END]:
            ruled: set[int] = set()
            ctxs = [tuple(past[len(past) - k :]) for k in range(min(order, len(past)), -1, -1)]
            for at, c in enumerate(ctxs):
                own = {x: n for x, n in seen.get(c, {}).items() if x not in ruled}
                if not own:
                    continue
                whole = 2 * sum(own.values())
                if s in own:
                    log += np.log10((2 * own[s] - 1) / whole)
                    break
                log += np.log10(len(own) / whole)
                ruled |= own.keys()
            else:
                log -= np.log10(SYMBOLS - len(ruled))
            for c in ctxs[: at + 1]:
                seen.setdefault(c, Counter())[s] += 1
            past.append(s)
        out.append(float(log))
    return out


def score_adaptive(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """id and adaptive score of every row of ``df``; a worker holds the contexts of one text at a time."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(adaptive(texts.cast(pa.binary()).to_pylist(), order), pa.float64())

    return documents(df, id_col, text_col).select("id", run("text").alias("score"))


def held_out(id_col: Column, mod: int = 7, rest: int = 2) -> Column:
    """Whether the CRC-32 of the id as text leaves ``rest``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod == rest


def deal(docs: DataFrame) -> DataFrame:
    """``docs`` with ``chunk``: rows that lie together, of about CHUNK_BYTES of text; to be written, so that it stays."""
    names, kind = docs.columns, docs.withColumn("chunk", F.lit(0).cast("bigint")).schema

    def run(batches):
        held, chunk = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            size = held + np.cumsum(pc.binary_length(batch["text"].cast(pa.binary())).to_numpy())
            step = size // CHUNK_BYTES
            yield pa.record_batch([*(batch[c] for c in names), pa.array(chunk + step)], [*names, "chunk"])
            if len(size):
                held, chunk = int(size[-1] % CHUNK_BYTES), int(chunk + step[-1])

    return docs.mapInArrow(run, kind)


def count_tokens(docs: DataFrame) -> DataFrame:
    """``docs``: text. token (bytes; empty: the end) and n."""

    def count(batches):
        held: Counter = Counter()

        def flush():
            yield pa.record_batch({"token": pa.array(held.keys(), pa.binary()), "n": pa.array(held.values(), pa.int64())})

        for batch in batches:
            for text in batch["text"].cast(pa.binary()).to_pylist():
                held.update(text.lower().split())
                held[b""] += 1
                if len(held) > 150_000:
                    yield from flush()
                    held.clear()
        yield from flush()

    return docs.select("text").mapInArrow(count, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def _unigrams(texts: list[bytes], logs: dict[bytes, float]) -> dict[str, pa.Array]:
    """n, known and log of each text by the words that have a log, and the others (rare)."""
    n, known, total, offsets, names, times = [], [], [], [0], [], []
    for text in texts:
        own = Counter(text.lower().split())
        own[b""] = 1
        k, s = 0, 0.0
        for t, m in own.items():
            x = logs.get(t)
            if x is None:
                names.append(t), times.append(m)
            else:
                k += m
                s += m * x
        n.append(own.total()), known.append(k), total.append(s), offsets.append(len(names))
    items = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(times, pa.int64())], ["token", "k"])
    rare = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)
    return {"n": pa.array(n, pa.int64()), "known": pa.array(known, pa.int64()), "log": pa.array(total, pa.float64()), "rare": rare}


_BASE = "n bigint, known bigint, log double, rare array<struct<token:binary,k:bigint>>"


def _based(docs: DataFrame, sent) -> DataFrame:
    """id and row of every document with what :func:`_unigrams` tells of its text."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            more = _unigrams(batch["text"].cast(pa.binary()).to_pylist(), sent.value)
            yield pa.record_batch({"id": batch["id"], "row": batch["row"], **more})

    return save(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, f"id {kind}, row bigint, {_BASE}"))


def _scored(docs: DataFrame, train: DataFrame, order: int, sent) -> DataFrame:
    """The same with the score of each by the trie of ``train``."""
    counts = save(count_contexts(train, order))
    dealt = save(deal(docs.withColumn("row", F.monotonically_increasing_id())))
    needs = save(count_contexts(dealt, order, "chunk"))
    asked = save(needs.select("key").distinct().join(counts, "key", "left_anti"))
    logs = probabilities(counts, asked, order)
    known = save(needs.join(logs, "key").select("chunk", "key", "log"))
    discard(needs)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        table, own = _Table(right["key"].to_numpy().view(np.uint64)), right["log"].to_numpy()
        texts, scores, held, size = left["text"].cast(pa.binary()).to_pylist(), [], 0, 0
        for i, text in enumerate(texts, 1):
            size += len(text)
            if size >= CHUNK or i == len(texts):
                keys, starts = contexts(texts[held:i], order)
                scores.append(np.add.reduceat(own[table.find(keys)], starts[:-1]))
                held, size = i, 0
        more = _unigrams(texts, sent.value)
        return pa.table({"id": left["id"], "row": left["row"], "score": np.concatenate(scores), **more})

    kind = f"{dealt.schema['id'].dataType.simpleString()}"
    fields = f"id {kind}, row bigint, score double, {_BASE}"
    out = save(dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(score, fields))
    for x in (dealt, known, counts, asked):
        discard(x)
    return out


def evaluate(df: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, frequent: int = FREQUENT, scores: bool = True) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score of every row of ``df``, by what ``training`` has. Without
    ``scores`` the last column is left out, and the trie that only it needs is not made."""
    if not 1 <= order <= 6:
        raise ValueError("order must be from 1 to 6")
    docs, train = documents(df, id_col, text_col), documents(training, id_col, text_col)
    tokens = save(count_tokens(train))
    big_n, big_v = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    base = float(np.log10(big_n + big_v + 1))
    # the words of the largest counts, by powers of two, so that their number is bounded whatever the corpus
    tall = sorted(tokens.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).count().collect(), reverse=True)
    least, held = None, 0
    for p, k in tall:
        held += k
        if held > frequent:
            break
        least = 1 << p
    common = {bytes(r.token): float(np.log10(r.n + 1)) for r in tokens.where(F.col("n") >= least).collect()} if least else {}
    sent = docs.sparkSession.sparkContext.broadcast(common)

    first = _scored(docs, train, order, sent) if scores else _based(docs, sent)
    others = first.select("row", F.explode("rare").alias("x")).select("row", "x.token", "x.k").join(tokens, "token")
    others = others.groupBy("row").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("s"))
    out = first.drop("rare").join(others, "row", "left")
    return out.select(
        "id",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(big_n).cast("bigint").alias("train_tokens"),
        (F.col("log") + F.coalesce("s", F.lit(0.0)) - F.col("n") * F.lit(base)).alias("base_score"),
        *["score"] * scores,
    )
