"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has 64 bits; two fingerprints within `distance` 2 share at least 6 of their 8
bytes, place by place. The index lists fingerprints under four bytes at a time, the bytes of
two of the four byte pairs: two differing bytes touch at most two pairs, so the two other
pairs bring every linked pair of fingerprints together. Pairs from the index tally their
shared positional bytes, pairs below the guaranteed count go, the others are compared bit by
bit. A posting of a single byte would hold 1 / 256 of the corpus, which is why bytes are
taken together.

Equal fingerprints are one entry of the index. A posting with more than `posting` entries is
not paired: its entries list all fingerprints one bit away, and entries that meet there are
linked. Two fingerprints lie within two bits exactly if they meet so, hence nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.common import lower_ascii, null_safe, split_words, whole, written
from tablegauge.llm.graph import components

WORDS = 3
DISTANCE = 2
# entries of a posting that are paired with each other
POSTING = 64
# shingles whose bits are counted at a time
COUNTED = 1 << 16


def with_shingles(df: DataFrame, text: str, name: str, words: int = WORDS) -> DataFrame:
    """Add `name`: XXH64 (seed 42) of every run of `words` words; of all words if they are fewer.

    Step by step in columns of their own, so nothing is computed twice.
    """
    df = df.withColumn("_words", split_words(lower_ascii(F.col(text)))).withColumn("_runs", F.col("_words"))
    for k in range(1, words):
        n = F.greatest(F.size("_words") - k, F.lit(0))
        longer = F.zip_with(F.slice("_runs", F.lit(1), n), F.slice("_words", F.lit(1 + k), n), lambda a, b: F.concat(a, F.lit(" "), b))
        df = df.withColumn("_runs", longer)
    few = F.when(F.size("_words") > 0, F.array(F.array_join("_words", " "))).otherwise(F.array().cast("array<string>"))
    runs = F.when(F.size("_words") >= words, F.col("_runs")).otherwise(few)
    return df.withColumn(name, F.transform(runs, lambda r: F.xxhash64(r))).drop("_words", "_runs")


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit number; 0 for none."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = hashes[at : at + COUNTED].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("hashes")
        ends = column.offsets.to_numpy()
        values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
        prints = [majority(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(prints, pa.int64())], ["doc_id", "text_key", "print"]
        )


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Per document row: doc_id, text_key (a hash of the text), print (a signed long)."""
    t = whole(f"`{text}`")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(t).alias("text_key"), t.alias("text"))
    hashed = with_shingles(rows, "text", "hashes", words).drop("text")
    kind = hashed.schema["doc_id"].dataType.simpleString()
    return hashed.mapInArrow(_fingerprint_batches, f"doc_id {kind}, text_key long, print long")


def _byte_pairs(print_: Column) -> list[Column]:
    return [F.shiftrightunsigned(print_, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]


def shared_bytes(a: Column, b: Column) -> Column:
    """The number of places at which two fingerprints have the same byte."""
    x = a.bitwiseXOR(b)
    same = [F.when(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(0xFF)) == 0, 1).otherwise(0) for i in range(8)]
    return sum(same[1:], same[0])


def linked_fingerprints(prints: DataFrame, distance: int = DISTANCE, posting: int = POSTING) -> DataFrame:
    """Links a, b between different fingerprints of a table with the distinct long column `print`.

    The links connect exactly the fingerprints that are connected through pairs of at most
    `distance` (1 or 2) differing bits.
    """
    if not 1 <= distance <= 2:
        raise ValueError("distance must be 1 or 2")
    pairs = _byte_pairs(F.col("print"))
    keys = [
        F.struct(F.lit(16 * i + j).alias("places"), F.shiftleft(pairs[i], 16).bitwiseOR(pairs[j]).alias("bytes"))
        for i, j in combinations(range(4), 2)
    ]
    index = prints.select("print", F.explode(F.array(*keys)).alias("key")).select("print", "key.places", "key.bytes")
    sizes = index.groupBy("places", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    listed = written(index.join(sizes, ["places", "bytes"]), "postings")
    short = listed.where(F.col("n") <= posting).drop("n")
    other = short.select("places", "bytes", F.col("print").alias("b"))
    tally = shared_bytes(F.col("print"), F.col("b"))
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("b"))) <= distance
    # each differing bit spoils one byte at most
    met = short.join(other, ["places", "bytes"]).where("print < b").where(tally >= 8 - distance).where(near)
    long = listed.where(F.col("n") > posting).select("print").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    if distance == 1:  # pairs then meet only if one is among the other's neighbours
        ring = long.select("print", F.explode(flips).alias("flip")).select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("meet"))
        hubs = ring.where("print <> meet").join(long.select(F.col("print").alias("meet")), "meet").select(
            F.col("print").alias("a"), F.col("meet").alias("b"))
    else:
        ring = long.select("print", F.explode(flips).alias("flip")).select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("meet"))
        least = ring.groupBy("meet").agg(F.min("print").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        hubs = ring.join(least, "meet").where("print <> b").select(F.col("print").alias("a"), "b")
    return met.select(F.col("print").alias("a"), "b").unionByName(hubs).distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, distance: int = DISTANCE, posting: int = POSTING
) -> DataFrame:
    """Per document row: doc_id, text_key, print, component_id and the row's standing.

    component_id is the smallest doc_id reachable over links; first_id and first_key name the
    row of the component that comes first by (doc_id, text_key), null ids last. Null and empty
    texts have fingerprint 0 and are linked like any other; null ids never name a component
    unless it has no other. Repeated rows are members like any other. Other columns are not read.
    """
    marked = written(fingerprints(docs, doc_id, text, words), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    nodes = marked.groupBy("print").agg(first)
    roots = components(linked_fingerprints(nodes.select("print"), distance, posting))
    placed = nodes.join(roots, nodes["print"] == roots["node"], "left").select(
        "print", F.coalesce("root", "print").alias("root"), "first")
    whose = placed.groupBy("root").agg(F.min("first").alias("first"))
    named = placed.select("print", "root").join(whose, "root").select(
        "print", F.col("first.doc_id").alias("component_id"), F.col("first.text_key").alias("first_key"))
    return marked.join(named, "print").select("doc_id", "text_key", "print", "component_id", "first_key")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component with all its columns: the first by (doc_id, text); of rows that
    repeat both the one whose other columns have the least digest, so that reruns agree.

    Null and empty texts are near-duplicates of each other; null ids come last. An empty table
    stays empty.
    """
    found = near_duplicates(docs, doc_id, text, **options)
    stay = found.select(F.col("component_id").alias("_id"), F.col("first_key").alias("_key")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{doc_id}`").alias("_id"), F.xxhash64(whole(f"`{text}`")).alias("_key"))
    kept = null_safe(rows, stay, ["_id", "_key"], "left_semi")
    others = F.to_json(F.struct(*[F.col(f"row.`{c}`") for c in docs.columns if c != text])) if len(docs.columns) > 1 else F.lit("")
    order = Window.partitionBy("_id", "_key").orderBy(F.xxhash64(others), others)
    return kept.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("row.*")
