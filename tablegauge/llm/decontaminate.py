"""Benchmark decontamination by winnowed fingerprints.

Documents and benchmark items are cut into words. Of every run of `window` words the
smallest hash of its k-word grams is the fingerprint, so two texts that share a run of
`window` words always share its fingerprint. Shared fingerprints are extended to the whole
run, which is compared word by word.

Only DataFrame functions run here. The benchmark's fingerprints become a bit set of bounded
size that is tested inside each document row; only runs that pass it leave the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import (
    BROADCAST_BYTES, NOT_WORD, keep, lower_ascii, null_safe, sliding, split_words, whole,
)

WINDOW = 13
GRAM = 8
# bits of the set for each fingerprint, and for all: 8 MB at most
BITS_EACH = 256
MAX_BITS = 1 << 26


def benchmark_words(text: str | Column) -> Column:
    """Words of letters and digits: A-Z in lower case, everything else of ASCII separates."""
    return split_words(lower_ascii(whole(text)), NOT_WORD)


def _fingerprints(df: DataFrame, words: str, name: str, length: int, gram: int) -> DataFrame:
    """Add `name`: the fingerprint of every run of `length` words, by the run's place."""
    gram = min(gram, length)
    hashed = df.withColumn("_hash", F.transform(words, lambda w: F.xxhash64(w)))
    grams = sliding(hashed, "_hash", "_grams", gram, lambda a, b: F.xxhash64(a, b))
    return sliding(grams, "_grams", name, length - gram + 1, lambda a, b: F.least(a, b)).drop("_hash", "_grams")


def benchmark_runs(benchmark: DataFrame, item_id: str, text: str, window: int, gram: int) -> tuple[DataFrame, list[int]]:
    """(the different runs of all items with fingerprint and items, the run lengths there are).

    An item of fewer than `window` words is one run. A null item id reads as the empty text.
    """
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), benchmark_words(text).alias("words")
    ).withColumn("length", F.least(F.size("words"), F.lit(window)))
    # at most `window` different lengths
    lengths = sorted(r[0] for r in items.where("length > 0").select("length").distinct().collect())
    parts = []
    for length in lengths:
        own = _fingerprints(items.where(F.col("length") == length), "words", "prints", length, gram)
        # the outer form keeps Spark from testing for empty arrays ahead, which would compute them twice
        runs = own.select("item", "length", "words", F.posexplode_outer("prints").alias("at", "print")).where("at is not null")
        parts.append(runs.select("item", "length", "print", F.slice("words", F.col("at") + 1, F.lit(length)).alias("run")))
    if not parts:
        return items.select("length", F.lit(0).cast("long").alias("print"), F.col("words").alias("run"),
                            F.array("item").alias("items")).where("false"), []
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("length", "print", "run").agg(F.sort_array(F.collect_set("item")).alias("items")), lengths


def _bit(print_: Column, bits: int, turn: int) -> Column:
    return F.shiftrightunsigned(print_, turn).bitwiseAND(F.lit(bits - 1))


def _bit_set(prints: DataFrame, bits: int) -> DataFrame:
    """One row with an array of `bits` / 64 longs in which two bits of each fingerprint are set."""
    slots = prints.select(F.explode(F.array(_bit(F.col("print"), bits, 0), _bit(F.col("print"), bits, 32))).alias("slot"))
    masks = slots.groupBy(F.shiftright("slot", 6).alias("id")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("mask")
    )
    every = prints.sparkSession.range(bits // 64).join(masks, "id", "left")
    placed = F.sort_array(F.collect_list(F.struct("id", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))))
    return every.agg(F.transform(placed, lambda s: s["mask"]).alias("set"))


def _is_set(bit_set: Column, slot: Column) -> Column:
    word = bit_set[F.shiftright(slot, 6).cast("int")]
    return F.shiftrightunsigned(word, 0).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))) != 0


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Per document row: doc_id, text_key, n_words, n_hit, items, contaminated.

    n_hit counts the words inside any occurrence of a benchmark run, items lists the items
    with an occurring run (sorted texts), contaminated is n_hit > 0 and n_hit >= 5 % of n_words.
    text_key is a hash of the text that tells rows of equal doc_id apart.

    Null or empty texts have no words and no hits; so has every document if the benchmark is
    empty. Rows with a null or repeated doc_id are judged each by their own text. Other columns
    of either table are not read.
    """
    runs, lengths = benchmark_runs(benchmark, item_id, item_text, window, gram)
    # named apart, so columns of these names in the input don't matter
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), whole(f"`{text}`").alias("text"))
    keyed = rows.select("doc_id", F.xxhash64("text").alias("text_key"), benchmark_words("text").alias("words"))
    base = keyed.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"))
    if not lengths:
        hits = base.select("doc_id", "text_key", F.lit(0).cast("long").alias("n_hit"),
                           F.array().cast("array<string>").alias("items")).where("false")
    else:
        hits = _hits(keyed, keep(runs), lengths, gram, broadcast_bytes)
    joined = null_safe(base, hits, ["doc_id", "text_key"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "text_key", "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def _places(prints: str, length: int, known) -> Column:
    """The runs whose fingerprint passes `known`: listed only for the few documents that have one."""
    p = F.col(prints)
    every = F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1)))
    places = F.transform(
        F.filter(every, lambda t: known(p[t - 1])),
        lambda t: F.struct(t.alias("start"), F.lit(length).alias("length"), p[t - 1].alias("print")),
    )
    none = F.array().cast("array<struct<start:int,length:int,print:bigint>>")
    return F.when(F.exists(p, known), places).otherwise(none)


def _hits(keyed: DataFrame, runs: DataFrame, lengths: list[int], gram: int, broadcast_bytes: int) -> DataFrame:
    """Per document with hits: doc_id, text_key, n_hit, items."""
    size = runs.agg(
        F.count_distinct("print").alias("prints"),
        F.coalesce(F.sum(F.octet_length(F.array_join("run", " ")) + 24 * F.size("run")
                         + F.octet_length(F.array_join("items", " ")) + 24 * F.size("items") + 64), F.lit(0)).alias("bytes"),
    ).first()
    bits = min(MAX_BITS, 1 << max(12, (BITS_EACH * size["prints"]).bit_length()))
    # a column, since subqueries can't stand inside array functions
    bit_set = F.col("_bit_set")

    def known(p: Column) -> Column:
        return _is_set(bit_set, _bit(p, bits, 0)) & _is_set(bit_set, _bit(p, bits, 32))

    found, places = keyed.withColumn("_bit_set", _bit_set(runs.select("print").distinct(), bits).scalar()), []
    for length in lengths:
        found = _fingerprints(found, "words", f"_prints_{length}", length, gram)
        found = found.withColumn(f"_places_{length}", _places(f"_prints_{length}", length, known)).drop(f"_prints_{length}")
        places.append(F.col(f"_places_{length}"))
    candidates = found.select("doc_id", "text_key", "words", F.explode_outer(F.concat(*places)).alias("p")).where("p is not null").select(
        "doc_id", "text_key", "p.start", "p.length", "p.print", F.slice("words", F.col("p.start"), F.col("p.length")).alias("run")
    )
    other = F.broadcast(runs) if size["bytes"] <= broadcast_bytes else runs
    exact = candidates.join(other, ["length", "print", "run"])
    spans = exact.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("start", "length")).alias("spans"), F.collect_set("items").alias("lists")
    )
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    return spans.select(
        "doc_id", "text_key", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten("lists"))).alias("items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns.

    Null and empty texts have no words and stay. Repeated rows stay or go together. Without
    benchmark items, or with items without words, all rows stay.
    """
    bad = contamination(docs, benchmark, doc_id, text, **options).where("contaminated").select(
        F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key")).distinct()
    key = F.xxhash64(whole(f"`{text}`"))
    return docs.join(bad, F.col(f"`{doc_id}`").eqNullSafe(F.col("_bad_id")) & (key == F.col("_bad_key")), "left_anti")
