"""Line dedup: repeated lines go, found through two Bloom filters and confirmed exactly.

Lines are compared by key. A first pass sets a bit pattern for each key in a filter of keys
seen once, and in a second filter for keys seen again: within a task, or by two tasks. Keys
that are not in the second filter occur in one document only and never leave their task. The
others are shuffled as 128-bit hashes with their documents, counted exactly, and the
documents that lose lines are told which: a map of their texts' keys parts the texts that may be
among them, and only those are shuffled. Both filters have a fixed size limit; if the corpus
outgrows it they let more keys pass to the exact count, and the result stays the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh64_intdigest

from tablegauge.llm.bitmaps import may_be_in, sent_map
from tablegauge.llm.common import fetched, null_safe, whole, written

LEAST_CHARS = 40
LEAST_DOCS = 5
# bits per line that could be long enough, and the limit of one filter: 16 MB
BITS_EACH = 4
MAX_BITS = 1 << 27
PROBES = 3
# filters travel in pieces of so many bytes
PIECE = 1 << 17
# parts into which a key's rows are dealt
SALTS = 16


def line_keys(text: bytes, least_chars: int) -> list[tuple[int, bytes]]:
    """(place, key) of the lines whose key is long enough.

    The key is the line without ASCII white space at its ends, A-Z in lower case; bytes know
    just that white space and lower just those letters.
    """
    out = []
    for i, line in enumerate(text.lower().split(b"\n")):
        key = line.strip()
        # a code point has four bytes at most
        if len(key) >= least_chars and (len(key) >= 4 * least_chars or len(key.decode(errors="replace")) >= least_chars):
            out.append((i, key))
    return out


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bit places of each hash, one row per probe; bits is a power of two."""
    h = hashes
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) & np.uint64(bits - 1) for i in range(PROBES)])


def _has(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    found = np.ones(at.shape[1], dtype=bool)
    for row in at:
        found &= (filter_[row >> np.uint64(3)] >> (row & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return found


def _put(filter_: np.ndarray, at: np.ndarray) -> None:
    # in order, so that each byte is met once and its neighbours next
    places = np.sort(at, axis=None)
    if len(places):
        byte, bit = places >> np.uint64(3), np.left_shift(1, (places & np.uint64(7)).astype(np.uint8), dtype=np.uint8)
        first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        filter_[byte[first]] |= np.bitwise_or.reduceat(bit, first)


def note(once: np.ndarray, twice: np.ndarray, hashes: np.ndarray, bits: int) -> None:
    """Enter the hashes of one batch: of those known already, or repeated in it, into `twice`."""
    different, counts = np.unique(hashes, return_counts=True)
    at = probes(different, bits)
    again = _has(once, at) | (counts > 1)
    _put(twice, at[:, again])
    _put(once, at)


def _build(bits: int, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, dtype=np.uint8), np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            for hashes in hashes_of(batch):
                note(once, twice, hashes, bits)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        size = min(PIECE, bits // 8)
        for k in range(bits // 8 // size):
            a, b = once[k * size : (k + 1) * size], twice[k * size : (k + 1) * size]
            if a.any():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "once": [squeeze(a.tobytes())], "twice": [squeeze(b.tobytes())]})

    return run


def _merge(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, held = zstandard.ZstdDecompressor().decompress, {}
        for batch in batches:
            for k, a, b in zip(*(batch.column(c).to_pylist() for c in ("piece", "once", "twice"))):
                a, b = np.frombuffer(expand(a), dtype=np.uint8), np.frombuffer(expand(b), dtype=np.uint8)
                if k not in held:
                    held[k] = (a.copy(), b.copy())
                else:
                    once, twice = held[k]
                    twice |= b | (once & a)
                    once |= a
        for k, (_, twice) in held.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "twice": [zstandard.compress(twice.tobytes(), 1)]})

    return run


def repeat_filter(rows: DataFrame, bits: int, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> bytes:
    """The merged filter, bits / 8 bytes, of hashes that two documents or more hold.

    hashes_of gives arrays of the hashes in a batch of `text`, in which no text has a hash twice.
    """
    size = min(PIECE, bits // 8)
    parts = rows.select("text").mapInArrow(_build(bits, hashes_of), "piece int, once binary, twice binary")
    merged = parts.repartition("piece").mapInArrow(_merge(size), "piece int, twice binary")
    out = bytearray(bits // 8)
    for row in fetched(merged, "filter"):
        out[row["piece"] * size : (row["piece"] + 1) * size] = zstandard.decompress(row["twice"])
    return bytes(out)


def _line_hashes(least_chars: int) -> Callable[[pa.RecordBatch], Iterator[np.ndarray]]:
    def run(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield np.array([h for t in _texts(batch) for h in {xxh3_64_intdigest(k) for _, k in line_keys(t, least_chars)}], dtype=np.uint64)

    return run


def _suspects(sent, bits: int, least_chars: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(sent.value, dtype=np.uint8)
        for batch in batches:
            lines = [(row, i, k) for row, t in enumerate(_texts(batch)) for i, k in line_keys(t, least_chars)]
            hashes = np.array([xxh3_64_intdigest(k) for _, _, k in lines], dtype=np.uint64)
            found = np.flatnonzero(_has(twice, probes(hashes, bits)))
            at = pa.array([lines[j][0] for j in found], pa.int64())
            second = np.array([xxh64_intdigest(lines[j][2]) for j in found], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("text_key").take(at), pa.array(hashes[found].view(np.int64)),
                 pa.array(second.view(np.int64)), pa.array([lines[j][1] for j in found], pa.int32())],
                ["doc_id", "text_key", "h1", "h2", "place"])

    return run


def dropped_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """Per document row that loses lines: doc_id, text_key, places (of lines, from 0).

    Keys of at least least_chars code points in at least least_docs different doc_ids lose
    their lines in all but the largest doc_id that holds them. A null doc_id counts as one that
    is smaller than any other; rows that share a doc_id are parts of one document.
    """
    t = whole(f"`{text}`")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(t).alias("text_key"), t.alias("text"))
    # no more keys than that are long enough
    most = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // (least_chars + 1)
    bits = min(max_bits, 1 << max(13, (BITS_EACH * most).bit_length() - 1))
    sent = docs.sparkSession.sparkContext.broadcast(repeat_filter(rows, bits, _line_hashes(least_chars)))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(_suspects(sent, bits, least_chars), f"doc_id {id_type}, text_key long, h1 long, h2 long, place int")
    suspects = written(found, "suspects")
    in_docs = suspects.select("h1", "h2", "doc_id").distinct()
    # count(1), since a null id is a document as well; max leaves nulls out
    often = in_docs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= least_docs)
    # a line may stand in a large part of all documents: its rows are dealt by salt as well
    salted = suspects.withColumn("salt", F.pmod(F.xxhash64("text_key"), F.lit(SALTS)))
    keys = often.select("h1", "h2", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    lost = salted.join(keys, ["h1", "h2", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    return lost.groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("places"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs as the struct `row` with n_lines, n_dropped and kept_text of each row.

    Null and empty texts have one empty line. Lines stay joined by line ends. Repeated rows
    lose the same lines. Names of other columns don't matter.
    """
    lost = written(dropped_lines(docs, doc_id, text, **options), "lost")
    t = whole(f"`{text}`")
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(t).alias("text_key"))
    # only texts that may lose a line are shuffled
    may = may_be_in(sent_map(lost, F.col("text_key")), F.col("text_key"))
    marked = rows.withColumn("may", may)
    found = null_safe(marked.where("may").drop("may"), lost, ["doc_id", "text_key"], "left").select("row", "places")
    found = found.unionByName(marked.where("not may").select("row", F.lit(None).cast("array<int>").alias("places")))
    found = found.select("row", whole(F.col(f"row.`{text}`")).alias("text"), "places")
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "places")
    kept = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: lines[i]), "\n"))
    return found.select("row", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
                        kept.alias("kept_text"))
