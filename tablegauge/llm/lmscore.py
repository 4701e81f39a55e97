"""Language-model scores from a log-frequency Bloom filter.

Word and word-pair counts of the training documents are quantised to powers of two. The
filter holds an n-gram of level q as the q pairs (n-gram, 1) .. (n-gram, q), so its level is
read by asking for (n-gram, 1), (n-gram, 2) and on until one is missing; a count can only be
overstated, by one level in less than ERROR of the reads. All bits of an n-gram lie in one
block of the filter. Counts are shuffled once, by block; where a block's counts meet they are
added up, and the block gets as many bits as the levels of its n-grams ask for.

The filter grows with the levels of the different n-grams. It is sent to the workers in segments
of a fixed size limit. A task reads its texts once and looks their n-grams up in one segment after
the other, so it holds one segment at a time if there are several.

Scores under the plain unigram model are exact. The most frequent words, as many as fit a
size limit, are looked up in the workers; the others are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import null_safe, whole, written
from tablegauge.llm.tokens import END, START, batch_tokens, batch_words, chunks, mix

#: fixed by the contract: documents whose crc32 leaves HELD of FOLDS are held out
FOLDS, HELD = 7, 2
# filter bits for each level of a different n-gram, bits set for each level
BITS_EACH, PROBES = 24, 6
# training tokens for each block
BLOCK_TOKENS = 1 << 16
# share of absent n-grams that read as held: (1 - exp(-6 / 24)) ** 6 is 0.00012
ERROR = 0.0005
SEGMENT_BYTES = 32 << 20
HEAD_WORDS = 1 << 20
# weight of the pair model against the word model
PAIR_WEIGHT = 0.7
# keys counted at a time
COUNTED = 1 << 22
# levels of more than this are not told apart (2**48 occurrences)
TOP_LEVEL = 48


def held_out(doc_id: str | Column) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit(""))) % FOLDS == HELD


def word_keys(h: np.ndarray) -> np.ndarray:
    return mix(h + np.uint64(1))


def pair_keys(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(mix(before) + h * np.uint64(3))


def _before(h: np.ndarray) -> np.ndarray:
    """The token before each; START after an END and at first."""
    out = np.empty_like(h)
    out[:1], out[1:] = START, h[:-1]
    out[out == END] = START
    return out


def level(counts: np.ndarray) -> np.ndarray:
    """1 for 1, 2 for 2 and 3, 3 for 4 to 7 and so on."""
    return np.minimum(np.frexp(counts.astype(np.float64))[1], TOP_LEVEL)


#: the middle of the counts of each level, 0 for level 0
LEVEL_COUNT = np.array([0.0] + [(2.0 ** (q - 1) + 2.0**q - 1) / 2 for q in range(1, TOP_LEVEL + 1)])


def _halves(keys: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of 32 bits for (n-gram, q); the second is odd."""
    x = mix(keys + np.uint64(q * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)


def _place(a: np.ndarray, b: np.ndarray, probe: int, sizes: np.ndarray | np.uint64) -> np.ndarray:
    """The place of a bit in blocks of so many bits."""
    return ((((a + np.uint64(probe) * b) & np.uint64(0xFFFFFFFF)) * sizes) >> np.uint64(32)).view(np.int64)


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def block_bits(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A block that holds the n-grams of it: bytes, as many as their levels ask for."""
    out = np.zeros(max(1, -(-BITS_EACH * int(levels.sum(dtype=np.int64)) // 8)), dtype=np.uint8)
    for q in range(1, int(levels.max(initial=0)) + 1):
        a, b = _halves(keys[levels >= q], q)
        for probe in range(PROBES):
            at = _place(a, b, probe, np.uint64(8 * len(out)))
            np.bitwise_or.at(out, at >> 3, np.left_shift(1, (at & 7).astype(np.uint8), dtype=np.uint8))
    return out


def read_levels(segment: np.ndarray, first: int, ends: np.ndarray, blocks: int, keys: np.ndarray, out: np.ndarray) -> None:
    """Put the levels of the n-grams whose blocks are in the segment into `out`.

    The segment has the blocks from `first` on; `ends` are where they end in it, a 0 first.
    """
    block = block_of(keys, blocks).view(np.int64) - first
    alive = np.flatnonzero((block >= 0) & (block < len(ends) - 1))
    base, sizes = ends[block[alive]], 8 * np.diff(ends)[block[alive]].view(np.uint64)
    keys = keys[alive]
    for q in range(1, TOP_LEVEL + 1):
        a, b = _halves(keys, q)
        held = np.arange(len(alive))
        for probe in range(PROBES):  # most absent ones go with the first bits
            at = _place(a[held], b[held], probe, sizes[held])
            held = held[(segment[base[held] + (at >> 3)] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
        alive, base, sizes, keys = alive[held], base[held], sizes[held], keys[held]
        if not len(alive):
            break
        out[alive] = q


def _summed(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each different key with its number, or the sum of its n."""
    if n is None:
        return np.unique(keys, return_counts=True)
    some, back = np.unique(keys, return_inverse=True)
    return some, np.bincount(back, weights=n, minlength=len(some)).astype(np.int64)


def _rows(columns: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 18)]) for c in columns], names)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for part in chunks(batch):
            own, index, _ = batch_words(part.column("text"))
            held.append((own, np.bincount(index, minlength=len(own))))
            size += len(own)
            if size >= COUNTED:
                keys, n = _summed(*map(np.concatenate, zip(*held)))
                yield from _rows([keys.view(np.int64), n], ["h", "n"])
                held, size = [], 0
    if held:
        keys, n = _summed(*map(np.concatenate, zip(*held)))
        yield from _rows([keys.view(np.int64), n], ["h", "n"])


def _keyed(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield from _rows([keys.view(np.int64), n], ["key", "n"])


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for part in chunks(batch):
            h, _ = batch_tokens(part.column("text"))
            held.append(pair_keys(_before(h), h))
            size += len(h)
            if size >= COUNTED:
                yield from _keyed(*_summed(np.concatenate(held)))
                held, size = [], 0
    if held:
        yield from _keyed(*_summed(np.concatenate(held)))


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _keyed(word_keys(batch.column("h").to_numpy().view(np.uint64)), batch.column("n").to_numpy())


def _blocked(blocks: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = block_of(batch.column("key").to_numpy().view(np.uint64), blocks)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(block.astype(np.int32))], ["key", "n", "block"])

    return run


def _built(blocks: int) -> Callable:
    """Counts of whole blocks, in any order, to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(batch.column(c).to_numpy() for c in ("key", "n")) for batch in batches]
        if not held:
            return
        key, n = map(np.concatenate, zip(*held))
        held.clear()
        # in the order of the keys blocks follow each other
        keys, n = _summed(key.view(np.uint64), n)
        block = block_of(keys, blocks)
        some, first = np.unique(block, return_index=True)
        for b, part, own in zip(some.tolist(), np.split(keys, first[1:]), np.split(level(n), first[1:])):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([block_bits(part, own).tobytes()], pa.binary())], ["block", "bits"])

    return run


def filter_blocks(train: DataFrame, words: DataFrame, tokens: int) -> tuple[DataFrame, int]:
    """(the filter's blocks as rows block, bits; how many there may be) from texts and their words' counts."""
    kind = "key long, n long"
    blocks = 1 + tokens // BLOCK_TOKENS
    counted = train.mapInArrow(_pair_counts, kind).unionByName(words.select("h", "n").mapInArrow(_word_rows, kind))
    dealt = counted.mapInArrow(_blocked(blocks), "key long, n long, block int").repartition("block")
    return written(dealt.mapInArrow(_built(blocks), "block int, bits binary"), "filter"), blocks


def token_logs(words: np.ndarray, pairs: np.ndarray, starts: np.ndarray, tokens: float, different: float, end_count: float) -> np.ndarray:
    """log10 probability of each token from the levels of its word and pair; texts begin at `starts`."""
    words, pairs = LEVEL_COUNT[words], LEVEL_COUNT[pairs]
    context = np.empty_like(words)
    context[1:] = words[:-1]
    context[starts] = end_count  # as many texts start as end
    alone = (words + 1) / (tokens + different + 1)
    seen = context > 0
    share = np.minimum(np.divide(pairs, context, out=np.zeros_like(pairs), where=seen), 1.0)
    return np.log10(np.where(seen, PAIR_WEIGHT * share + (1 - PAIR_WEIGHT) * alone, alone))


def _levels_of(segments: list, blocks: int, keys: np.ndarray) -> np.ndarray:
    """The levels of n-grams, looked up in one segment after the other; 0 for those in none."""
    out = np.zeros(len(keys), dtype=np.uint8)
    for first, ends, sent in segments:
        read_levels(np.frombuffer(sent.value, dtype=np.uint8), first, ends, blocks, keys, out)
        if len(segments) > 1:  # only one is held
            del sent._value
    return out


def _scored(segments: list, blocks: int, head, model: tuple) -> Callable:
    """Per document its score, the exact base figures of frequent words, and its rare words.

    segments: (first block, ends of the blocks, the broadcast bits); model: arguments of token_logs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = head.value
        for batch in batches:
            for part in chunks(batch):
                some, back, ends = batch_words(part.column("text"))
                h, starts = some[back], np.concatenate([[0], ends[:-1]])
                pair, pair_back = np.unique(pair_keys(_before(h), h), return_inverse=True)
                levels = _levels_of(segments, blocks, np.concatenate([word_keys(some), pair]))
                score = np.add.reduceat(token_logs(levels[: len(some)][back], levels[len(some) :][pair_back], starts, *model), starts)
                at = np.minimum(np.searchsorted(known, some), max(len(known) - 1, 0))
                is_head = known[at] == some if len(known) else np.zeros(len(some), dtype=bool)
                base = np.where(is_head, logs[at], 0.0) if len(known) else np.zeros(len(some))
                # rare words of each text, once with their number
                text = np.repeat(np.arange(len(ends)), ends - starts)
                rare = ~is_head[back]
                each, n = np.unique(text[rare] * len(some) + back[rare], return_counts=True)
                lists = pa.array(np.searchsorted(each, np.arange(len(ends) + 1) * len(some)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(score), pa.array(ends - starts), pa.array(np.add.reduceat(base[back], starts)),
                     pa.array(np.add.reduceat(is_head[back].astype(np.int64), starts)),
                     pa.ListArray.from_arrays(lists, pa.array(some[each % len(some)].view(np.int64))), pa.ListArray.from_arrays(lists, pa.array(n))],
                    ["doc_id", "text_key", "score", "n_tokens", "base", "known", "tail_h", "tail_n"])

    return run


def _segments(table: DataFrame, segment_bytes: int) -> list:
    """The filter's blocks in segments of so many bytes, or of one block, each sent to the workers."""
    sizes = {r["block"]: r["n"] for r in table.select("block", F.octet_length("bits").alias("n")).collect()}
    last = max(sizes, default=-1)
    each, first, held = [], 0, 0
    for b in range(last + 1):
        if held and held + sizes.get(b, 0) > segment_bytes:
            each.append((first, b))
            first, held = b, 0
        held += sizes.get(b, 0)
    each.append((first, last + 1))
    out = []
    for first, until in each:
        ends = np.concatenate([[0], np.cumsum([sizes.get(b, 0) for b in range(first, until)])]).astype(np.int64)
        bits = bytearray(int(ends[-1]))
        for r in table.where(F.col("block").between(first, until - 1)).toLocalIterator():
            at = r["block"] - first
            bits[ends[at] : ends[at + 1]] = r["bits"]
        out.append((first, ends, table.sparkSession.sparkContext.broadcast(bytes(bits))))
    return out


def scores(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", head_words: int = HEAD_WORDS, segment_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that are not held out. Null texts are empty: their one token is the
    end. A null id reads as the empty text for the fold. Repeated rows count as often as they
    occur. Words are told apart by 64-bit hashes. An empty table gives no rows; without training
    rows every count is 0 and the scores are those of unseen words. Other columns are not read.
    """
    spark = docs.sparkSession
    t = whole(f"`{text}`")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("text_key"))
    train = rows.where(~held_out("doc_id")).select("text")
    counted = train.mapInArrow(_word_counts, "h long, n long")
    words = written(counted.groupBy("h").agg(F.sum("n").alias("n")), "words")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"),
                     F.coalesce(F.max(F.when(F.col("h") == int(END.view(np.int64)), F.col("n"))), F.lit(0)).alias("end")).first()
    total, different = sums["n"], sums["v"]
    # the most frequent words by powers of two of their count, whole powers as long as they fit
    sizes = dict(words.groupBy(F.floor(F.log2("n")).alias("q")).count().collect())
    least, held = TOP_LEVEL + 16, 0
    while least > 0 and held + sizes.get(least - 1, 0) <= head_words:
        least, held = least - 1, held + sizes.get(least - 1, 0)
    is_head = F.floor(F.log2("n")) >= least
    top = words.where(is_head).toArrow()
    known, n = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(known)
    divide = float(total + different + 1)
    head = spark.sparkContext.broadcast((known[order], np.log10((n[order] + 1) / divide)))

    table, blocks = filter_blocks(train, words, total)
    model = (total, different, float(LEVEL_COUNT[level(np.array([sums["end"]]))[0]]))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    kind = f"doc_id {id_type}, text_key long, score double, n_tokens long, base double, known long, tail_h array<long>, tail_n array<long>"
    scored = written(rows.mapInArrow(_scored(_segments(table, segment_bytes), blocks, head, model), kind), "scores")

    # rare and unknown words: repeated rows have the same ones, and count them once
    rare = scored.where(F.size("tail_h") > 0).select("doc_id", "text_key", F.explode(F.arrays_zip("tail_h", "tail_n")).alias("t"))
    rare = rare.select("doc_id", "text_key", F.col("t.tail_h").alias("h"), F.col("t.tail_n").alias("times")).distinct()
    seen = rare.join(words.where(~is_head), "h", "left")
    c = F.coalesce("n", F.lit(0))
    tails = seen.groupBy("doc_id", "text_key").agg(
        F.sum(F.col("times") * F.log10((c + 1) / F.lit(divide))).alias("tail_base"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(F.lit(0))).alias("tail_known"))
    joined = null_safe(scored.drop("tail_h", "tail_n"), tails, ["doc_id", "text_key"], "left")
    return joined.select(
        "doc_id", held_out("doc_id").alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"), "score")
