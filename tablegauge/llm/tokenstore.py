"""Token ids of a corpus in byte or bit planes.

Documents are dealt into ranges of doc_id (shards), encoded, and their ids written in order.
A shard's stream of ids is cut into blocks of fixed size; a block is turned into one plane
per byte (or per bit) and each plane is compressed with zstandard. A store is a Parquet table
with one row per block:

  shard, block   the block's place: shards follow doc_id, blocks follow the stream
  n_ids          ids in the block
  planes         the compressed planes, lowest byte (bit) first; as many as the largest id needs
  docs           doc_id and number of ids of each document that begins in the block

The columns besides `planes` are the index: reading them alone gives every place in the store.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablegauge.llm.common import whole
from tablegauge.session import new_folder

BLOCK = 1 << 16
LEVEL = 3
END_ID = 1
# characters encoded at a time, and of a long text's parts
PART = 8 << 20
# punctuation that may follow a plain word; plain words are runs of letters up to U+00FF
MARKS = ".,;:!?#*$%&|<>()"
LETTERS = "".join(c for c in map(chr, range(0x100)) if c.isalpha())

Ragged = tuple[np.ndarray, np.ndarray]


def _gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs pool[start : start + size], one after the other."""
    before = np.cumsum(sizes) - sizes
    return pool[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


class PieceEncoder:
    """Ids of texts for tokenizers that never join the pieces between spaces and line ends.

    Of each batch every different piece is encoded once. A `light` tokenizer, if there is one,
    encodes plain words (see light_spec) without the normalizer and the splitting pattern.
    """

    def __init__(self, tokenizer, light=None):
        self.tokenizer, self.light = tokenizer, light
        if light is not None:
            suffix = light.model.end_of_word_suffix
            self.ends = np.zeros(light.get_vocab_size(), dtype=bool)
            self.ends[[i for token, i in light.get_vocab().items() if token.endswith(suffix)]] = True

    def _whole(self, pieces: list[str]) -> Ragged:
        """(ids of the pieces one after the other, how many each has)."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        return np.array([i for x in found for i in x], dtype="<u4"), sizes

    def _words(self, words: list[str]) -> Ragged:
        """Plain lower-case words in one go: each ends with the only id that ends a word."""
        if not words:
            return self._whole(words)
        ids = np.array(self.light.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return self._whole(words)
        return ids, np.diff(ends, prepend=0)

    def _pieces(self, pieces: pa.StringArray) -> Ragged:
        if self.light is None:
            return self._whole(pieces.to_pylist())
        rest = pc.utf8_ltrim(pieces, characters=LETTERS)
        plain = pc.and_(pc.equal(pc.utf8_rtrim(rest, characters=MARKS), ""), pc.less(pc.binary_length(rest), pc.binary_length(pieces)))
        is_plain = plain.to_numpy(zero_copy_only=False)
        marks = pc.dictionary_encode(rest.filter(plain))
        low = pc.dictionary_encode(pc.utf8_lower(pc.utf8_rtrim(pieces.filter(plain), characters=MARKS)))
        parts = [self._words(low.dictionary.to_pylist()), self._whole(marks.dictionary.to_pylist()),
                 self._whole(pieces.filter(pc.invert(plain)).to_pylist())]
        pool = np.concatenate([ids for ids, _ in parts])
        sizes = [n for _, n in parts]
        first = np.cumsum([0] + [len(ids) for ids, _ in parts])
        starts = [at + np.cumsum(n) - n for at, n in zip(first, sizes)]
        # each piece is a word and its marks, or one run and nothing
        start, size = np.zeros((len(pieces), 2), dtype=np.int64), np.zeros((len(pieces), 2), dtype=np.int64)
        for k, of in ((0, low), (1, marks)):
            index = of.indices.to_numpy()
            start[is_plain, k], size[is_plain, k] = starts[k][index], sizes[k][index]
        start[~is_plain, 0], size[~is_plain, 0] = starts[2], sizes[2]
        return _gather(pool, start.ravel(), size.ravel()), size.sum(axis=1)

    def encode(self, texts: pa.StringArray) -> Ragged:
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = pc.dictionary_encode(split.flatten())
        pool, sizes = self._pieces(coded.dictionary)
        index = coded.indices.to_numpy()
        of = sizes[index]
        ends = np.concatenate([[0], np.cumsum(of)])[split.offsets.to_numpy()]
        return _gather(pool, (np.cumsum(sizes) - sizes)[index], of), np.diff(ends)


class WholeTexts:
    """Encodes every text in one go, for tokenizers whose tokens may span spaces."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def encode(self, texts: pa.StringArray) -> Ragged:
        found = [np.array(x.ids, dtype="<u4") for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.zeros(0, dtype="<u4"), *found]), np.array([len(x) for x in found], dtype=np.int64)


_encoders: dict = {}


def encoder(spec: str):
    """The worker's encoder for a tokenizer file's content."""
    key = hash(spec)
    if key not in _encoders:
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(spec)
        made.no_padding()
        made.no_truncation()
        light = light_spec(spec)
        _encoders.clear()
        if drops_spaces(spec):
            _encoders[key] = PieceEncoder(made, light and Tokenizer.from_str(light))
        else:
            _encoders[key] = WholeTexts(made)
    return _encoders[key]


def _parts(text: str) -> Iterator[str]:
    """The text in parts of about PART characters that end at a space."""
    at = 0
    while len(text) - at > PART and (to := text.find(" ", at + PART)) >= 0:
        yield text[at:to]
        at = to + 1
    yield text[at:]


def encoded(texts: pa.StringArray, made) -> Iterator[Ragged]:
    """The ids of a batch of texts and how many each has, about PART bytes of text at a time."""
    at = 0
    while at < len(texts):
        size = np.cumsum(pc.binary_length(texts.slice(at, 1 << 16)).to_numpy())
        n = max(1, int(np.searchsorted(size, PART, side="right")))
        if n == 1 and size[0] > PART and isinstance(made, PieceEncoder):
            found = [made.encode(pa.array([p], pa.string())) for p in _parts(texts[at].as_py())]
            yield np.concatenate([ids for ids, _ in found]), np.array([sum(int(x[0]) for _, x in found)])
        else:
            yield made.encode(texts.slice(at, n))
        at += n


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to about PART bytes: the more text, the more pieces are alike."""
    held = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= PART:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def light_spec(spec: str) -> str | None:
    """The tokenizer without normalizer and splitting pattern, if it encodes plain words alike.

    Plain words are runs of letters up to U+00FF in lower case. Composing, lower-casing and the
    pattern, which takes runs of letters whole, leave them as they are; what follows is
    the same in both.
    """
    made = json.loads(spec)
    steps = [n.get("type") for n in (made.get("normalizer") or {}).get("normalizers", [])]
    before = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
    letters = len(before) == 2 and r"[\p{L}]+" in (before[0].get("pattern") or {}).get("Regex", "").split("|")
    plain = letters and before[1].get("type") == "ByteLevel" and not before[1].get("use_regex") and not before[1].get("add_prefix_space")
    added = any(a["content"].isalpha() for a in made.get("added_tokens", []))
    if not (drops_spaces(spec) and steps == ["NFC", "Replace", "Lowercase"] and plain and not added and made["model"].get("end_of_word_suffix")):
        return None
    made["normalizer"] = None
    made["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
    return json.dumps(made)


def drops_spaces(spec: str) -> bool:
    """Whether no token of the tokenizer can span or depend on a space: its splitter matches runs
    without white space and drops what lies between."""
    made = json.loads(spec)
    before = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [made.get("pre_tokenizer") or {}]
    first = before[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    spaceless = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    alternatives_ok = bool(pattern) and r"[^\s\p{L}\p{N}]+" in pattern and " " not in pattern and r"\s" not in pattern.replace(r"[^\s\p{L}\p{N}]+", "")
    added = all(" " not in a["content"] and not a.get("lstrip") and not a.get("rstrip") and not a.get("single_word") for a in made.get("added_tokens", []))
    return spaceless and alternatives_ok and added


def pack(ids: np.ndarray, by: str = "byte", level: int = LEVEL) -> list[bytes]:
    """The compressed planes of a block of ids."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    ids = np.ascontiguousarray(ids, dtype="<u4")
    top = int(ids.max()) if len(ids) else 0
    if by == "byte":
        wide = ids.view(np.uint8).reshape(-1, 4)
        return [squeeze(wide[:, i].tobytes()) for i in range((top.bit_length() + 7) // 8)]
    if top < 1 << 16:
        ids = ids.astype("<u2")
    return [squeeze(np.packbits((ids >> i) & 1).tobytes()) for i in range(top.bit_length())]


def unpack(planes: list[bytes], n: int, by: str = "byte") -> np.ndarray:
    """The ids of a block."""
    expand = zstandard.ZstdDecompressor().decompress
    if by == "byte":
        wide = np.zeros((n, 4), dtype=np.uint8)
        for i, plane in enumerate(planes):
            wide[:, i] = np.frombuffer(expand(plane), dtype=np.uint8)
        return wide.view("<u4").reshape(-1)
    ids = np.zeros(n, dtype="<u2" if len(planes) <= 16 else "<u4")
    for i, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(expand(plane), dtype=np.uint8), count=n).astype(ids.dtype) << ids.dtype.type(i)
    return ids.astype("<u4")


def _store_schema(id_type: str) -> str:
    return f"shard int, block long, n_ids long, planes array<binary>, docs array<struct<doc_id: {id_type}, n_ids: bigint>>"


def _encode(spec, block: int, by: str, level: int, end_id: int, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(spec.value)
        shard = TaskContext.get().partitionId()
        held, begun, n = np.zeros(0, dtype="<u4"), [], 0

        def row(ids: np.ndarray, docs: list) -> pa.RecordBatch:
            one = {"shard": shard, "block": n, "n_ids": len(ids), "planes": pack(ids, by, level), "docs": docs}
            return pa.RecordBatch.from_pylist([one], schema=schema)

        for batch in _larger(batches):
            doc_ids, at = batch["doc_id"].to_pylist(), 0
            for ids, sizes in encoded(batch["text"].combine_chunks(), made):
                ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
                first = (len(held) + np.cumsum(sizes) - sizes).tolist()
                begun += [(f, {"doc_id": d, "n_ids": s}) for f, d, s in zip(first, doc_ids[at:], sizes.tolist())]
                at += len(sizes)
                held = np.concatenate([held, ids])
                done = 0
                while len(held) - done >= block:
                    k = next((i for i, (f, _) in enumerate(begun) if f >= done + block), len(begun))
                    yield row(held[done : done + block], [d for _, d in begun[:k]])
                    begun, done, n = begun[k:], done + block, n + 1
                held, begun = held[done:], [(f - done, d) for f, d in begun]
        if len(held):
            yield row(held, [d for _, d in begun])

    return run


def arrow_schema(id_type: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(_store_schema(id_type)))


def write_store(
    docs: DataFrame, path: str, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID,
    block: int = BLOCK, by: str = "byte", level: int = LEVEL,
) -> None:
    """Encode docs in ascending doc_id order (null first, then by text) into a store at `path`.

    Null texts are empty; every document ends with end_id, so an empty one has that id alone.
    Repeated doc_ids are documents of their own. An empty table makes a store without rows.
    The tokenizer's file is read here and sent to the workers.
    """
    if by not in ("bit", "byte"):
        raise ValueError("planes are by 'bit' or 'byte'")
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()
    t = whole(f"`{text}`")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("key"),
                       F.monotonically_increasing_id().alias("row"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    # the last column only lets rows that repeat all others be dealt to several shards
    dealt = rows.repartitionByRange("doc_id", "key", "row").sortWithinPartitions("doc_id", "key").select("doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    run = _encode(sent, block, by, level, end_id, arrow_schema(id_type))
    dealt.mapInArrow(run, _store_schema(id_type)).write.option("compression", "uncompressed").parquet(path)


def _decode(by: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start, waiting, held = None, 0, [], np.zeros(0, dtype="<u4")
        for batch in batches:
            names = ("shard", "doc_id", "start", "n_ids", "ids_crc32")
            out: dict[str, list] = {k: [] for k in names}
            for r in range(batch.num_rows):
                now = batch.column("shard")[r].as_py()
                if now != shard:  # a shard's blocks follow each other in one task
                    shard, start, waiting, held = now, 0, [], np.zeros(0, dtype="<u4")
                ids = unpack(batch.column("planes")[r].as_py(), batch.column("n_ids")[r].as_py(), by)
                held = np.concatenate([held, ids]) if len(held) else ids
                waiting += [(d["doc_id"], d["n_ids"]) for d in batch.column("docs")[r].as_py()]
                at = done = 0
                for doc_id, n in waiting:
                    if at + n > len(held):
                        break
                    for k, v in zip(names, (shard, doc_id, start, n, zlib.crc32(held[at : at + n].tobytes()))):
                        out[k].append(v)
                    at, start, done = at + n, start + n, done + 1
                waiting, held = waiting[done:], held[at:]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["shard"], pa.int32()), pa.array(out["doc_id"], batch.schema.field("docs").type.value_type.field("doc_id").type)]
                + [pa.array(out[k], pa.int64()) for k in names[2:]], list(names))

    return run


def read_store(spark: SparkSession, path: str, by: str = "byte") -> DataFrame:
    """Per document of a store, from its decoded ids: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it, ids_crc32 is the unsigned crc32 of its ids
    as little-endian unsigned 32-bit integers.
    """
    store = spark.read.parquet(path)
    id_type = store.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    # one row per shard; shards are as many as the partitions that wrote the store
    sizes = store.groupBy("shard").agg(F.sum("n_ids").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    streams = store.repartition("shard").sortWithinPartitions("shard", "block")
    found = streams.mapInArrow(_decode(by), f"shard int, doc_id {id_type}, start long, n_ids long, ids_crc32 long")
    return found.join(F.broadcast(first), "shard").select(
        "doc_id", (F.col("start") + F.col("first")).alias("start"), F.col("n_ids").alias("n_tokens"), "ids_crc32")


def stored(docs: DataFrame, tokenizer_file: str, by: str = "byte", **options) -> DataFrame:
    """Write a store of docs to a new folder of the shared one and read it back.

    Null and empty texts are their end id alone. Repeated rows are documents of their own, null
    ids come first. An empty table gives no rows.
    """
    path = new_folder(docs.sparkSession, "tokens")
    write_store(docs, path, tokenizer_file, by=by, **options)
    return read_store(docs.sparkSession, path, by)
