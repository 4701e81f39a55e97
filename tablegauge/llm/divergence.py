"""Source divergence audit through iceberg prefix refinement.

Which terms a language keeps is found by prefixes. A level counts, per language and prefix of so
many bytes, the documents that have a term with it. Prefixes below the threshold are discarded
with all terms that start with them; only terms whose prefix is left are extended to the next
level, of twice the bytes. A term that ends inside its prefix (a zero byte says so, which no term
has) is complete: it is kept and not looked at again. Levels end when no open prefix is left.

The open prefixes reach the next level as a bitmap of hashes of fixed size. Two prefixes in one
bit let a prefix live on that should go; its longer prefixes are counted like any other, and the
last join with the kept terms is exact. So the bitmap's size bounds the work, not the result.

Counting emits one row per batch, language and prefix, which tasks add up before the shuffle.
Source pairs are compared in blocks of sources: a term is sent to the blocks that have it, terms
that neither source has are accounted for by one product, and tasks hold a few blocks of sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.common import whole, written
from tablegauge.llm.tokens import chunks

LEAST_DOCS = 10
TOP = 10
# bytes of the first level's prefixes; each level doubles them. Fewer bytes discard next to nothing
FIRST_BYTES = 8
# bits of the bitmap of open prefixes: 16 MB
BITS = 1 << 27
# sources compared at a time, and source blocks that a task holds sums of
BLOCK = 256
HELD = 16
# bytes of text worked on at a time, for prefixes and for counts; a longer text is worked on alone
PREFIX_CHUNK, COUNT_CHUNK = 8 << 20, 8 << 20
# (lang, key) pairs of a chunk that are marked in a table instead of being sorted
TABLE = 1 << 26
# numbers of a block of probabilities
CELLS = 1 << 22
# what Spark's xxhash64 starts from
SEED = 42
END = b"\0"

# a byte of a term as it counts, 0 for what stands between terms
BYTES = np.arange(256, dtype=np.uint8)
BYTES[:0x80] = 0
BYTES[ord("a") : ord("z") + 1] = BYTES[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def batch_terms(texts: pa.Array, least_bytes: int = 1) -> tuple[pa.Array, np.ndarray]:
    """(the terms of at least so many bytes in order, the text each is in)."""
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if ends[-1] == ends[0]:
        return pa.array([], pa.binary()), np.zeros(0, dtype=np.int64)
    data = BYTES[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    inside = data != 0
    # a term starts where none goes on from the byte before, in the same text
    fresh = np.empty(len(inside), dtype=bool)
    fresh[0], fresh[1:] = True, ~inside[:-1]
    first = ends[:-1][ends[:-1] < len(inside)]
    fresh[first] = True
    starts = np.flatnonzero(inside & fresh)
    last = np.empty(len(inside), dtype=bool)
    last[:-1], last[-1] = ~inside[1:] | fresh[1:], True
    lengths = np.flatnonzero(inside & last) - starts + 1
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    terms = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    doc = np.searchsorted(ends, starts, side="right") - 1
    if least_bytes > 1:
        enough = lengths >= least_bytes
        terms, doc = terms.filter(pa.array(enough)), doc[enough]
    return terms, doc


def _open(bitmap: np.ndarray, langs: list[bytes], prefixes: list[bytes], lang: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Whether the bitmap has the prefix for the language."""
    seeds = [xxhash.xxh64_intdigest(x, SEED) for x in langs]
    digest = xxhash.xxh64_intdigest
    at = np.array([digest(prefixes[p], seeds[k]) for k, p in zip(lang.tolist(), prefix.tolist())], dtype=np.uint64) & np.uint64(BITS - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _alive(bitmap: np.ndarray, langs: pa.DictionaryArray, doc: np.ndarray, index: np.ndarray, keys: pa.Array) -> np.ndarray:
    """Per term in the texts, of which index tells the vocabulary's entry: whether its key is open."""
    coded = keys.dictionary_encode()
    n, names = len(coded.dictionary), [x.encode() for x in langs.dictionary.to_pylist()]
    pair = langs.indices.to_numpy().astype(np.int64)[doc] * n + coded.indices.to_numpy()[index]
    look = lambda pairs: _open(bitmap, names, coded.dictionary.to_pylist(), pairs // n, pairs % n)
    if n * len(names) > TABLE:
        different, back = np.unique(pair, return_inverse=True)
        return look(different)[back]
    table = np.zeros(n * len(names), dtype=bool)
    table[pair] = True
    different = np.flatnonzero(table)
    table[different] = look(different)
    return table[pair]


def _bits(bitmap) -> np.ndarray:
    return np.frombuffer(bitmap.value, dtype=np.uint8)


def _different(numbers: np.ndarray) -> np.ndarray:
    """The different numbers in order: sorting takes a part of the time of np.unique."""
    numbers = np.sort(numbers)
    return numbers[np.concatenate([[True], numbers[1:] != numbers[:-1]])[: len(numbers)]]


def _prefixes(before: int, width: int, bitmap) -> Callable:
    """Per batch: (lang, prefix, docs) of the terms that are open after the level of `before` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in chunks(b, PREFIX_CHUNK)):
            terms, doc = batch_terms(batch.column("text"), max(before, 1))
            if not len(terms):
                continue
            coded, langs = terms.dictionary_encode(), batch.column("lang").dictionary_encode()
            vocabulary, index = coded.dictionary, coded.indices.to_numpy()
            if before:
                alive = _alive(_bits(bitmap), langs, doc, index, pc.binary_slice(vocabulary, 0, before))
                doc, index = doc[alive], index[alive]
            keys = pc.binary_slice(pc.binary_join_element_wise(vocabulary, END, b""), 0, width).dictionary_encode()
            n = len(keys.dictionary)
            once = _different(doc * n + keys.indices.to_numpy()[index])
            pairs, docs = np.unique(langs.indices.to_numpy().astype(np.int64)[once // n] * n + once % n, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(pairs // n)), keys.dictionary.take(pa.array(pairs % n)), pa.array(docs)], names=["lang", "prefix", "docs"])

    return run


def _counts(bitmap) -> Callable:
    """Per batch: (lang, source, term, n) of the terms in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in chunks(b, COUNT_CHUNK)):
            terms, doc = batch_terms(batch.column("text"))
            if not len(terms):
                continue
            coded, langs, sources = terms.dictionary_encode(), batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
            vocabulary, index = coded.dictionary, coded.indices.to_numpy()
            alive = _alive(_bits(bitmap), langs, doc, index, pc.binary_join_element_wise(vocabulary, END, b""))
            doc, index, n, s = doc[alive], index[alive], len(vocabulary), len(sources.dictionary)
            group = langs.indices.to_numpy().astype(np.int64) * s + sources.indices.to_numpy()
            found, times = np.unique(group[doc] * n + index, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(found // n // s)), sources.dictionary.take(pa.array(found // n % s)),
                 vocabulary.take(pa.array(found % n)), pa.array(times)], names=["lang", "source", "term", "n"])

    return run


def _bitmap(keys: DataFrame):
    """The hashes of (lang, prefix) as a bitmap of BITS bits, sent to the executors."""
    spark = keys.sparkSession
    at = F.pmod(F.xxhash64("lang", "prefix"), F.lit(BITS)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    size = 4096  # bytes of one part, as Spark makes them
    out = bytearray(BITS // 8)
    for r in parts:
        out[(r["bucket"] - 1) * size : r["bucket"] * size] = r["bits"]
    return spark.sparkContext.broadcast(bytes(out))


def kept_terms(rows: DataFrame, least_docs: int = LEAST_DOCS, first_bytes: int = FIRST_BYTES) -> DataFrame:
    """(lang, prefix, docs) of the terms in at least least_docs rows of their language, closed by END.

    rows has lang, source and text without nulls; each row is a document.
    """
    before, width, bitmap, kept = 0, first_bytes, None, None
    while True:
        found = rows.select("lang", "text").mapInArrow(_prefixes(before, width, bitmap), "lang string, prefix binary, docs long")
        level = written(found.groupBy("lang", "prefix").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs), "prefixes")
        closed = F.substring("prefix", -1, 1) == F.lit(END)
        complete = level.where(closed)
        kept = complete if kept is None else kept.unionByName(complete)
        if level.where(~closed).isEmpty():
            return kept
        bitmap = _bitmap(level.where(~closed))
        before, width = width, 2 * width


def share(count: Column, of: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / of), in three steps of 10^3: exact for `of` up to 9 * 10^15."""
    rest, out = count + 2, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + F.call_function("div", rest, of)
        rest = rest % of
    return out + 1


def _share(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """`share` of arrays; 1 where there is nothing to share."""
    safe = np.maximum(of, 1)
    rest, out = np.where(of > 0, count + 2, 0), np.zeros(np.broadcast(count, of).shape, dtype=np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // safe
        rest = rest % safe
    return out + 1


def _difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells (lang, i, j, whether it is a term, entries, denominators of both blocks) to sums per source pair."""
    held: dict[tuple, list] = {}

    def emit(key: tuple) -> pa.RecordBatch:
        lang, i, j = key
        total, seen, left, right = held.pop(key)
        a, b = np.meshgrid(np.arange(len(left)) + i * BLOCK, np.arange(len(right)) + j * BLOCK, indexing="ij")
        none = _difference(_share(np.int64(0), left)[:, None], _share(np.int64(0), right)[None, :])
        use = a < b
        n = int(use.sum())
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * n, pa.string()), *(pa.array(x, pa.int64()) for x in (a[use], b[use], total[use], np.full(n, seen), none[use]))],
            names=["lang", "a", "b", "total", "seen", "none"])

    for batch in batches:
        cells: dict[tuple, list[int]] = {}
        names = [batch.column(c).to_pylist() for c in ("lang", "i", "j")]
        is_term = batch.column("is_term").to_numpy(zero_copy_only=False)
        for at, key in enumerate(zip(*names)):
            cells.setdefault(key, []).append(at)
        for key, at in cells.items():
            if key not in held:
                while len(held) >= HELD:
                    yield emit(next(iter(held)))
                left, right = (np.array(batch.column(c)[at[0]].as_py(), dtype=np.int64) for c in ("left", "right"))
                held[key] = [np.zeros((len(left), len(right)), dtype=np.int64), 0, left, right]
            sums, _, left, right = held[key]
            at = [k for k in at if is_term[k]]
            held[key][1] += len(at)
            step = max(1, CELLS // (len(left) + len(right)))
            for some in (at[k : k + step] for k in range(0, len(at), step)):
                lists = batch.column("entries").take(pa.array(some))
                row = np.repeat(np.arange(len(some)), lists.value_lengths().to_numpy())
                number, n = (lists.flatten().field(f).to_numpy() for f in ("number", "n"))
                sides = []
                for block, of in ((key[1], left), (key[2], right)):
                    own = number // BLOCK == block
                    count = np.zeros((len(some), len(of)), dtype=np.int64)
                    count[row[own], number[own] % BLOCK] = n[own]
                    sides.append(_share(count, of[None, :]))
                p, q = sides
                for k in range(len(left)):
                    sums[k] += _difference(p[:, k : k + 1], q).sum(axis=0)
    for key in list(held):
        yield emit(key)


CELL = "lang string, i int, j int, is_term boolean, entries array<struct<number:int,n:long>>, left array<long>, right array<long>"


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every source of a language and every other."""
    block = lambda c: F.call_function("div", c, F.lit(BLOCK)).cast("int")
    blocks = groups.groupBy("lang", block(F.col("number")).alias("block")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("number", "of"))), lambda x: x["of"]).alias("of"))
    width = groups.groupBy("lang").agg((block(F.max("number")) + 1).alias("blocks"), F.max("terms").alias("terms"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # each pair of blocks once, without a term, so that all pairs of sources come out
    frame = width.select("lang", "blocks", F.explode(every).alias("i")).select("lang", "i", F.explode(F.sequence("i", F.col("blocks") - 1)).alias("j"))
    frame = frame.select("*", F.lit(False).alias("is_term"), F.array().cast("array<struct<number:int,n:long>>").alias("entries"))
    numbered = counts.join(groups.select("lang", "source", "number"), ["lang", "source"])
    entries = numbered.groupBy("lang", "term").agg(F.collect_list(F.struct("number", "n")).alias("entries")).join(width, "lang")
    own = F.array_distinct(F.transform("entries", lambda x: block(x["number"])))
    meets = F.array_distinct(F.flatten(F.transform(own, lambda b: F.transform(every, lambda o: F.struct(F.least(b, o).alias("i"), F.greatest(b, o).alias("j"))))))
    cells = entries.select("lang", "entries", F.explode(meets).alias("at")).select(
        "lang", "at.i", "at.j", F.lit(True).alias("is_term"),
        F.filter("entries", lambda x: block(x["number"]).isin(F.col("at.i"), F.col("at.j"))).alias("entries"))
    side = lambda name, of: blocks.select("lang", F.col("block").alias(name), F.col("of").alias(of))
    cells = cells.unionByName(frame).join(side("i", "left"), ["lang", "i"]).join(side("j", "right"), ["lang", "j"])
    cells = cells.select("lang", "i", "j", "is_term", "entries", "left", "right")
    sums = cells.mapInArrow(_pair_sums, "lang string, a long, b long, total long, seen long, none long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("total").alias("total"), F.sum("seen").alias("seen"), F.max("none").alias("none"))
    # terms that neither source has
    valued = sums.join(width, "lang").select("lang", "a", "b", (F.col("total") + (F.col("terms") - F.col("seen")) * F.col("none")).alias("value"))
    both = valued.select("lang", "value", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    name = lambda number, source: groups.select("lang", F.col("number").cast("long").alias(number), F.col("source").alias(source))
    return both.select("lang", "p.a", "p.b", "value").join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select(
        "lang", "source", "item", "value")


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP,
    first_bytes: int = FIRST_BYTES,
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) that occurs.

    A language keeps the terms (runs of ASCII letters and non-ASCII characters, A-Z lower-cased)
    that at least least_docs of its rows have. A group gives a kept term p = 1 + floor(10^9 *
    (count + 2) / (N + 2 V)): N its count of all V kept terms; p and q differ by f = floor((p -
    q)^2 / (p + q)). Part `pair`: every other source of the language, f summed over all kept
    terms, all ranks. Part `term`: the terms that the group has and gives more than its language
    does, f between the two, ranks to `top`. Ranks fall with value, then rise with the item.

    Null text, lang and source are read as ''. Every row is a document, repeated ones too. Rows
    without terms make their group occur. A language that keeps no term has pairs of value 0; an
    empty table gives no rows. Other columns don't matter.
    """
    rows = docs.select(whole(f"`{text}`").alias("text"), whole(f"`{lang}`").alias("lang"), whole(f"`{source}`").alias("source"))
    kept = kept_terms(rows, least_docs, first_bytes)
    counted = rows.mapInArrow(_counts(_bitmap(kept)), "lang string, source string, term binary, n long")
    summed = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    exact = kept.select("lang", F.expr("substring(prefix, 1, octet_length(prefix) - 1)").alias("term"))
    counts = written(summed.join(exact, ["lang", "term"], "left_semi").select("lang", "source", F.col("term").cast("string").alias("term"), "n"), "terms")

    per_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"))
    langs = per_term.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_n"))
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = written(groups.select("*", number.alias("number"), (F.col("group_n") + 2 * F.col("terms")).alias("of")), "groups")

    p, q = share(F.col("n"), F.col("of")), share(F.col("all"), F.col("lang_n") + 2 * F.col("terms"))
    each = counts.join(per_term, ["lang", "term"]).join(groups.select("lang", "source", "of", "terms", "lang_n"), ["lang", "source"])
    each = each.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    each = each.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(_pairs(counts, groups), "pair").unionByName(ranked(each, "term").where(F.col("rank") <= top))
