"""Word hashes of whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# bytes of text read at a time
CHUNK = 4 << 20
# white space never occurs in a word
START = np.uint64(xxhash.xxh64_intdigest(b" start"))
END = np.uint64(xxhash.xxh64_intdigest(b" end"))


def batch_words(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different word hashes of all texts, A-Z in lower case, with END; which of them each token
    is, where an END follows the words of every text; the places after the ENDs."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, ends = split.flatten(), split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    real = pc.binary_length(words).to_numpy() > 0  # white space at the ends of a text leaves empty pieces
    if not real.all():
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        words = words.filter(pa.array(real))
    coded = pc.dictionary_encode(words)
    own = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()] + [int(END)], dtype=np.uint64)
    return own, np.insert(coded.indices.to_numpy(), ends[1:], len(own) - 1), ends[1:] + np.arange(1, len(ends))


def batch_tokens(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens, and the places after each text's END."""
    own, index, ends = batch_words(texts)
    return own[index], ends


# a byte as it counts in a word: A-Z as lower case, 0 for white space; and by its place in the word
_BYTES = np.random.default_rng(42).integers(1, 1 << 64, 256, dtype=np.uint64)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_BYTES[[0x20, *range(0x09, 0x0E)]] = 0
_PLACES = 1 << 12


def batch_hashes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """As batch_tokens, with other hashes of the words: sums over their bytes, for all words at once."""
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    n, ends = int(ends[-1] - ends[0]), ends - ends[0]
    if not n:
        return np.full(len(texts), END), np.arange(1, len(texts) + 1)
    first = int(np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset])
    value = _BYTES[np.frombuffer(texts.buffers()[2], dtype=np.uint8, count=n, offset=first)]
    inside = value != 0
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    begin = ends[:-1][ends[:-1] < n]
    fresh[begin] = inside[begin]
    starts = np.flatnonzero(fresh)
    h = np.zeros(0, dtype=np.uint64)
    if len(starts):
        lengths = np.add.reduceat(inside, starts, dtype=np.int64)
        factors = mix(np.arange(1, max(_PLACES, int(lengths.max())) + 1, dtype=np.uint64)) | np.uint64(1)
        place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n))) if starts[0] == 0 else np.concatenate(
            [np.zeros(starts[0], dtype=np.int64), np.arange(starts[0], n) - np.repeat(starts, np.diff(np.append(starts, n)))])
        h = mix(np.add.reduceat(value * factors.take(place, mode="clip"), starts) + lengths.astype(np.uint64))
    before = np.searchsorted(starts, ends[1:])
    return np.insert(h, before, END), before + np.arange(1, len(ends))


def chunks(batch: pa.RecordBatch, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about so many bytes of text."""
    at = 0
    while at < batch.num_rows:
        size = np.cumsum(pc.binary_length(batch.column("text").slice(at, 1 << 14)).to_numpy())
        n = max(1, int(np.searchsorted(size, most, side="right")))
        yield batch.slice(at, n)
        at += n


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))
