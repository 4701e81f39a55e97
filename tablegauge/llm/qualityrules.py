"""Quality rules: decision lists learned by sequential covering from labelled statistics.

Statistics of each text are cut at quantiles. A rule for junk grows threshold by threshold
from counts of junk and clean rows per statistic and cut, is pruned on rows held back, and
the rows it covers leave before the next rule grows. The outcome is an ordered list of
threshold conjunctions that becomes one Spark conditional expression. All counts are Spark
aggregates over every labelled row; only cut counts, as many as there are statistics and
cuts, come to the driver. Only DataFrame functions run here.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import neighbours, split_words, where_computed, whole, written

#: fixed by the contract of the base rule
LEAST_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = r"[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_different", "n_upper", "n_marks", "n_digits")
SHARES = {
    "symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"), "different_share": ("n_different", "n_words"),
    "upper_share": ("n_upper", "word_chars"), "mark_share": ("n_marks", "word_chars"),
    "digit_share": ("n_digits", "word_chars"), "mean_word": ("word_chars", "n_words"),
}
FEATURES = ("n_words", *SHARES)


@dataclass(frozen=True)
class Condition:
    """feature <= cut, or feature > cut."""

    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.cut if self.above else c <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


Rule = tuple[Condition, ...]


def _repeated_words(words: str) -> Column:
    """Words inside 3-word windows that are found twice or more; `_three` holds the windows' hashes."""
    by_hash = F.sort_array(F.transform("_three", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    pairs = neighbours(F.col("_sorted"), 1, lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    places = F.array_distinct(F.flatten(pairs))
    covered = F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2))))
    return by_hash, F.size(covered)


def with_statistics(df: DataFrame, text: str) -> DataFrame:
    """Add the columns of COUNTS (long) and SHARES (double, 0 for 0 / 0) of a text column.

    Null reads as empty. Words lie between ASCII white space; the windows of three words are
    told apart by 64-bit hashes.
    """
    t = whole(f"`{text}`")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_words", split_words(t)).withColumn("_lines", lines)
    df = df.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_two", neighbours(F.col("_hash"), 1, lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_three", neighbours(F.col("_two"), 1, lambda a, b: F.xxhash64(a, b)))
    by_hash, covered = _repeated_words("_words")
    # only texts that repeat a window are sorted
    repeats = F.size(F.array_distinct("_three")) < F.size("_three")
    df = df.withColumn("_sorted", F.when(repeats, by_hash).otherwise(F.array().cast("array<struct<x:bigint,i:int>>")))
    counts = {
        "n_words": F.size("_words"), "word_chars": F.length(F.array_join("_words", "")), "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")), "n_repeat_words": covered, "n_lines": F.size("_lines"),
        "n_different": F.size(F.array_distinct("_hash")), "n_upper": F.regexp_count(t, F.lit("[A-Z]")),
        "n_marks": F.regexp_count(t, F.lit("[!?]")), "n_digits": F.regexp_count(t, F.lit("[0-9]")),
    }
    for name, c in counts.items():
        df = df.withColumn(name, c.cast("long"))
    df = df.drop("_words", "_lines", "_hash", "_two", "_three", "_sorted")
    for name, (a, b) in SHARES.items():
        df = df.withColumn(name, F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)))
    return df


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id and its statistics. Rows with equal or no doc_id stay apart."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return with_statistics(rows, "text").drop("text")


def learn_rules(
    labelled: DataFrame, junk: str = "junk", by: str = "doc_id", cuts: int = 24, most_rules: int = 8, most_conditions: int = 3,
    precision: float = 0.95, least_rows: int = 10, held_back: int = 3,
) -> list[Rule]:
    """An ordered list of rules for junk from rows with FEATURES, a boolean `junk` and an id.

    Cuts are quantiles of all and of the junk rows, and the middles between them; of cuts that
    part the rows alike, the one that covers least of the line is taken. One row in `held_back`, chosen by a hash of
    its id, only prunes. A rule needs `precision` on the held-back rows and covers `least_rows`
    rows or more in the growing part; without labels, or without either kind, the list is empty.
    """
    points = [0.0, 0.001, 0.01] + [i / cuts for i in range(1, cuts)] + [0.99, 0.999]
    every = labelled.agg(*[F.percentile_approx(f, points, 10_000).alias(f) for f in FEATURES],
                         *[F.percentile_approx(F.when(F.col(junk), F.col(f)), points, 10_000).alias(f"junk_{f}") for f in FEATURES]).first()
    at = {f: _with_middles(sorted({float(x) for x in (every[f] or []) + (every[f"junk_{f}"] or [])})) for f in FEATURES}
    if not any(at.values()):
        return []
    # the number of cuts below a value stands for it: x <= cuts[i] just if its code is <= i
    codes = [F.size(F.filter(F.array(*[F.lit(c) for c in at[f]]), _below(f))).cast("int").alias(f) for f in FEATURES]
    rows = written(labelled.select(*codes, F.col(junk).alias("junk"), (F.pmod(F.xxhash64(by), F.lit(held_back)) == 0).alias("held")), "labelled")
    rules: list[list[tuple[str, bool, int]]] = []

    def meets(rule) -> Column:
        out = F.lit(True)
        for f, above, i in rule:
            out = out & (F.col(f) > i if above else F.col(f) <= i)
        return out

    for _ in range(most_rules):
        left = rows
        for rule in rules:
            left = left.where(~meets(rule))
        rule = _grow(left.where("not held"), meets, {f: len(c) for f, c in at.items()}, most_conditions, least_rows)
        rule = _prune(left.where("held"), rule, meets, precision)
        if not rule:
            break
        rules.append(rule)
    return [tuple(Condition(f, above, at[f][i]) for f, above, i in rule) for rule in rules]


def _with_middles(values: list[float]) -> list[float]:
    return sorted({*values, *((a + b) / 2 for a, b in zip(values, values[1:]))})


def _below(feature: str):
    return lambda cut: F.col(feature) > cut


def _grow(rows: DataFrame, meets, cuts: dict[str, int], most: int, least_rows: int) -> list:
    """Add the condition with the best information gain until no clean row is left, or none helps."""
    rule: list[tuple[str, bool, int]] = []
    while len(rule) < most:
        pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f).alias("code")) for k, f in enumerate(cuts)]))
        counts = rows.where(meets(rule)).select("junk", pairs.alias("p")).groupBy("p.f", "p.code").agg(
            F.count_if(F.col("junk")).alias("p"), F.count_if(~F.col("junk")).alias("n")).collect()
        names, by = list(cuts), {}
        for r in counts:
            by.setdefault(names[r["f"]], {})[r["code"]] = (r["p"], r["n"])
        p0 = sum(p for p, _ in next(iter(by.values()), {}).values())
        n0 = sum(n for _, n in next(iter(by.values()), {}).values())
        if not p0 or not n0:
            break
        best = (0.0, None)
        for f, found in sorted(by.items()):
            p = n = 0
            for i in range(cuts[f]):
                p, n = p + found.get(i, (0, 0))[0], n + found.get(i, (0, 0))[1]
                for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                    if a and a + b >= least_rows:
                        gain = a * (math.log2(a / (a + b)) - math.log2(p0 / (p0 + n0)))
                        if gain > best[0] + 1e-9 or above and best[1] and best[1][:2] == (f, above) and gain > best[0] - 1e-9:
                            best = (gain, (f, above, i))
        if best[1] is None:
            break
        rule.append(best[1])
    return rule


def _prune(rows: DataFrame, rule: list, meets, precision: float) -> list:
    """The beginning of the rule that parts junk from clean best on held-back rows; none if not pure enough."""
    if not rule:
        return []
    parts = [rule[: k + 1] for k in range(len(rule))]
    found = rows.agg(*[F.count_if(meets(r) & F.col("junk")).alias(f"p{k}") for k, r in enumerate(parts)],
                     *[F.count_if(meets(r) & ~F.col("junk")).alias(f"n{k}") for k, r in enumerate(parts)]).first()
    best = (0.0, [])
    for k, r in enumerate(parts):
        p, n = found[f"p{k}"], found[f"n{k}"]
        if p and p / (p + n) >= precision and (p - n) / (p + n) > best[0]:
            best = ((p - n) / (p + n), r)
    return best[1]


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one expression: false for what a rule covers, else true."""
    out = None
    for rule in rules:
        met = rule[0].column()
        for c in rule[1:]:
            met = met & c.column()
        out = F.when(met, F.lit(False)) if out is None else out.when(met, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def labelled_statistics(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """Statistics of the labelled rows that the base rule lets pass, with `junk`.

    An id with several labels is junk if one says so; null labels and ids count as none.
    """
    marks = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{quality}`").alias("q")).where(
        "q is not null and doc_id is not null").groupBy("doc_id").agg((F.min("q") == 0).alias("junk"))
    return stats.where(~base_failed()).join(marks, "doc_id")


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document row: doc_id, its statistics, base_failed and kept.

    The statistics are written once; rules are learned from the labelled ones and applied to all.
    Null and empty texts have no words and fail the base rule. Other columns are not read.
    """
    stats = written(statistics(docs, doc_id, text), "statistics")
    rules = learn_rules(labelled_statistics(stats, labels), **options)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & verdict(rules))


def filter_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that the base rule and the learned list keep, with all their columns.

    Null and empty texts have no words and go. Repeated rows stay or go together. An empty table
    stays empty; without labels the base rule alone decides.
    """
    stats = written(statistics(docs, doc_id, text).select("doc_id", "n_repeat_words", *FEATURES), "statistics")
    rules = learn_rules(labelled_statistics(stats, labels), **options)
    rows = with_statistics(docs.select(F.struct("*").alias("row"), F.col(f"`{text}`").alias("text")), "text")
    return where_computed(rows, ~base_failed() & verdict(rules)).select("row.*")
