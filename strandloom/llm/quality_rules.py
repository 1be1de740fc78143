"""Quality rules: decision lists learned by sequential covering.

Labelled documents give rows of text statistics. A rule is a conjunction of thresholds that describes bad documents; it
is grown condition by condition for information gain on two thirds of the rows, pruned on the rest, and kept while it is
more often right than wrong there. What it covers is removed and the next rule is grown. The ordered rules become one
chain of Spark conditional expressions, so applying them costs no more than a projection.

The learner works on a bounded sample of labelled rows (``max_labelled``, lowest hashes of the id); statistics and
verdicts are made for every document.

Defined results: a null text counts as empty, all its counts are 0 and it fails the base rules. Labels of ids that no
document has, and null labels, are passed over; an id labelled twice counts twice. Without labels of both kinds the list is
empty and the verdict is that of the base rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, let, shingle_hashes, words

WINDOW, SYMBOLS = 8, "#*$%&|<>"
FEATURES = ["n_words", "mean_chars", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "marks_per_word", "distinct_share"]


def repeated_words(tokens: Column, width: int = WINDOW) -> Column:
    """How many words lie in runs of ``width`` words that the text has twice or more, the first included."""
    spans = lambda at: F.aggregate(
        at,
        F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s.n + F.least(F.lit(width), i - s.last)).alias("n")),
        lambda s: s.n,
    )
    twice = lambda s: F.transform(
        s, lambda e, j: F.when((F.get(s, j - 1).h == e.h) | (F.get(s, j + 1).h == e.h), e.i)
    )
    search = lambda g: let(F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda s: spans(F.sort_array(F.array_compact(twice(s)))))
    return let(tokens, lambda w: F.when(F.size(w) <= width, 0).otherwise(let(shingle_hashes(w, width), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(search(g)))))


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the five base counts as bigint, and the learner's FEATURES, of every document."""
    text, n = F.col("text"), F.col("n_words")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    tokens = documents(df, id_col, text_col).select("id", "text", words(text).alias("w"))
    counts = tokens.select(
        "id",
        F.size("w").cast("bigint").alias("n_words"),
        F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(repeated_words(F.col("w")), F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("_upper"),
        (F.char_length(text) - F.char_length(F.translate(text, "!?", ""))).alias("_marks"),
        F.size(lines).alias("_lines"),
        F.size(F.array_distinct("w")).alias("_distinct"),
    )
    per = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return counts.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        per(F.col("word_chars"), n).alias("mean_chars"),
        per(F.col("n_symbols"), n).alias("symbols_per_word"),
        per(F.col("n_dup_lines"), F.col("_lines")).alias("dup_line_share"),
        per(F.col("n_repeat_words"), n).alias("repeat_share"),
        per(F.col("_upper"), F.col("word_chars")).alias("upper_share"),
        per(F.col("_marks"), n).alias("marks_per_word"),
        per(F.col("_distinct"), n).alias("distinct_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    cut: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.cut if self.at_least else row[self.feature] <= self.cut

    def column(self) -> Column:
        return F.col(self.feature) >= F.lit(self.cut) if self.at_least else F.col(self.feature) <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.cut:g}"


def _best(rows: list[tuple[dict, bool]], features: list[str], least: int) -> tuple[float, Condition | None]:
    """The condition of greatest information gain over these rows; each feature is sorted once."""
    p, n = sum(bad for _, bad in rows), len(rows)
    before, best, found = math.log2(max(p, 1e-9) / n), 0.0, None
    for f in features:
        vals = sorted((r[f], bad) for r, bad in rows)
        low = 0
        for i in range(len(vals) - 1):
            low += vals[i][1]
            if vals[i][0] == vals[i + 1][0]:
                continue
            for at_least, bad, k in ((False, low, i + 1), (True, p - low, n - i - 1)):
                if bad >= least and (gain := bad * (math.log2(bad / k) - before)) > best + 1e-9:
                    best, found = gain, Condition(f, at_least, round((vals[i][0] + vals[i + 1][0]) / 2, 7))
    return best, found


def learn(rows: list[tuple[dict, bool]], features: list[str] = FEATURES, least: int = 5, worth: float = 0.8, most_rules: int = 12, most_conditions: int = 4) -> list[list[Condition]]:
    """Ordered rules for bad rows. ``least``: bad rows that a rule covers; ``worth``: its precision on the rows held for
    pruning, or on all where those hold fewer than ``least``."""
    left, rules = rows, []
    while len(rules) < most_rules and sum(bad for _, bad in left) >= least:
        grow, prune = [x for i, x in enumerate(left) if i % 3], left[::3]
        rule, inside = [], grow
        while len(rule) < most_conditions and any(not bad for _, bad in inside):
            _, c = _best(inside, features, least)
            if c is None:
                break
            rule.append(c)
            inside = [x for x in inside if c.holds(x[0])]
        covered = lambda conds, some: [bad for r, bad in some if all(c.holds(r) for c in conds)]
        value = lambda conds: (2 * sum(b := covered(conds, prune)) - len(b)) / max(1, len(b))
        if not rule:
            break
        rule = rule[: max(range(1, len(rule) + 1), key=lambda k: (value(rule[:k]), -k))]
        seen = covered(rule, prune)
        if len(seen) < least:
            seen = covered(rule, left)
        if sum(seen) < least or sum(seen) < worth * len(seen):
            break
        rules.append(rule)
        left = [x for x in left if not all(c.holds(x[0]) for c in rule)]
    return rules


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 6000) -> list[list[Condition]]:
    """Learn from documents that have a label (0 bad, else good), at most ``max_labelled``."""
    some = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").alias("_label")).where("_id is not null and _label is not null")
    some = some.orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_labelled)
    docs = df.select(F.col(f"`{id_col}`").alias("_doc"), F.col(f"`{text_col}`").alias("_text"))
    held = docs.join(F.broadcast(some), F.col("_doc") == F.col("_id"))  # max_labelled ids and labels at most
    stats = statistics(held.select(F.struct("_id", "_label").alias("k"), "_text"), "k", "_text").where(~base_failed())
    rows = stats.collect()
    rows = sorted(rows, key=lambda r: (hash_order(r["id"][0]), r["id"][1], [r[f] for f in FEATURES]))
    return learn([({f: float(r[f]) for f in FEATURES}, r["id"][1] == 0) for r in rows])


def hash_order(x: int) -> int:
    """A fixed order of ids that has nothing to do with their size."""
    return (int(x) * 0x9E3779B97F4A7C15) % (1 << 64)


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one conditional expression: the number of the first rule that holds, or null."""
    out = F.lit(None).cast("int")
    for k, rule in reversed([*enumerate(rules, 1)]):
        cond = rule[0].column()
        for c in rule[1:]:
            cond = cond & c.column()
        out = F.when(cond, F.lit(k)).otherwise(out)
    return out


def apply_rules(df: DataFrame, rules: list[list[Condition]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of every document with ``base_failed``, ``kept`` and ``rule``, the number of the rule that rejected it."""
    out = statistics(df, id_col, text_col).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
