"""Language-model scores against brute force."""

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from fixtures import DATA, odd_docs  # noqa: F401
from tablegauge.llm import lmscore as lm

UP = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP)) + [None]


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2


def brute(rows, exact=True):
    train = [tokens(t) for d, t in rows if not held(d)]
    words = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip([0] + t[:-1], t))
    n, v = sum(words.values()), len(words)
    middle = lambda c: float(lm.LEVEL_COUNT[c.bit_length()])
    out = []
    for d, text in rows:
        t = tokens(text)
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for before, w in zip([0] + t[:-1], t):
            alone = (middle(words[w]) + 1) / (n + v + 1)
            context = middle(words[None] if before == 0 else words[before])
            p = lm.PAIR_WEIGHT * min(middle(pairs[(before, w)]) / context, 1) + (1 - lm.PAIR_WEIGHT) * alone if context else alone
            score += math.log10(p)
        out.append((d, held(d), len(t), sum(words[w] > 0 for w in t), n, base, score))
    return sorted(out, key=repr)


def close(got, want, slack):
    got = sorted(got, key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert math.isclose(g[5], w[5], rel_tol=1e-9)
        # levels can only be read too high, for a few n-grams
        assert abs(g[6] - w[6]) <= slack * abs(w[6])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("options", [{}, {"head_words": 100, "segment_bytes": 1 << 16}])
def test_whole_table(spark, options, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = [tuple(r) for r in lm.scores(docs, **options).collect()]
    close(got, brute([(r.doc_id, r.text) for r in docs.collect()]), 0.02)


@pytest.mark.parametrize("options", [{}, {"head_words": 2}])
def test_odd_documents(spark, odd_docs, options):  # noqa: F811
    got = [tuple(r) for r in lm.scores(odd_docs, **options).collect()]
    close(got, brute([(r.doc_id, r.text) for r in odd_docs.collect()]), 0.25)
    assert lm.scores(odd_docs.where("false")).count() == 0
    # without training rows
    one = next(d for d in range(50) if held(d))
    got = lm.scores(spark.createDataFrame([(one, "a b")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)]


def test_tokens_split_at_ascii_white_space_only():
    texts = ["", " ", "a", " A\tb\x0b\x0cC\r\n ", "x\x1cy\u3000É é\xa0z", "  two  words"]
    h, ends = lm.batch_tokens(pa.array(texts))
    for t, a, b in zip(texts, [0, *ends], ends):
        want = [xxhash.xxh64_intdigest(w.encode()) for w in tokens(t)[:-1]]
        assert h[a:b].tolist() == want + [int(lm.END)]


def assembled(parts):
    """(the blocks one after the other, their ends) of block number -> bytes, for the blocks from 0 on."""
    sizes = [len(parts.get(b, b"")) for b in range(max(parts) + 1)]
    return np.frombuffer(b"".join(bytes(parts.get(b, b"")) for b in range(len(sizes))), dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def test_filter_reads_levels_back_or_higher():
    rng = np.random.default_rng(3)
    keys = lm.mix(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    levels = lm.level(rng.integers(1, 1000, len(keys)))
    blocks = 3
    own = lm.block_of(keys, blocks)
    parts = {b: lm.block_bits(keys[own == b], levels[own == b]) for b in range(blocks)}
    bits, ends = assembled(parts)
    read = np.zeros(len(keys), dtype=np.uint8)
    lm.read_levels(bits, 0, ends, blocks, keys, read)
    assert (read >= levels).all() and (read > levels).mean() < lm.ERROR
    # the same in two segments
    apart = np.zeros(len(keys), dtype=np.uint8)
    lm.read_levels(bits[: ends[1]], 0, ends[:2], blocks, keys, apart)
    assert (apart[own > 0] == 0).all()
    lm.read_levels(bits[ends[1] :], 1, ends[1:] - ends[1], blocks, keys, apart)
    assert (apart == read).all()
    assert [int(x) for x in lm.level(np.array([1, 2, 3, 4, 7, 8]))] == [1, 2, 2, 3, 3, 4]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_held_out_text_scores_above_its_shuffled_words(spark):
    # ten times the texts of the smallest folder, which holds out about ten English ones
    docs = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet")
    picked = [r for r in docs.collect() if held(r.doc_id) and r.lang == "en" and 200 < len(r.text.split()) < 2000]
    rng = np.random.default_rng(1)
    mixed, taken = [], iter(d for d in range(10**6, 10**6 + 10**5) if held(d))
    for r in picked:
        w = r.text.split()
        rng.shuffle(w)
        mixed.append((next(taken), " ".join(w)))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(mixed, "doc_id long, text string"))
    got = {r.doc_id: r.score for r in lm.scores(both).collect()}
    assert np.mean([got[r.doc_id] > got[d] for r, (d, _) in zip(picked, mixed)]) > 0.8


def test_absent_pairs_read_as_absent(spark):
    # 20,000 different pairs a text: most n-grams are held once
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{x}w" for x in rng.integers(0, 30_000, 20_000)) for _ in range(4)]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    words = train.mapInArrow(lm._word_counts, "h long, n long").groupBy("h").agg({"n": "sum"}).toDF("h", "n")
    table, blocks = lm.filter_blocks(train, words, 3 << 16)
    assert blocks == 4
    bits, ends = assembled({r.block: r.bits for r in table.collect()})

    def levels_of(keys):
        out = np.zeros(len(keys), dtype=np.uint8)
        lm.read_levels(bits, 0, ends, blocks, keys, out)
        return out

    absent = lm.mix(rng.integers(0, 1 << 63, 100_000, dtype=np.uint64))
    assert 0 < (levels_of(absent) > 0).mean() < lm.ERROR
    h, _ = lm.batch_tokens(pa.array(texts))
    keys, n = lm._summed(lm.pair_keys(lm._before(h), h))
    read = levels_of(keys)
    assert (read >= lm.level(n)).all() and (read > lm.level(n)).mean() < lm.ERROR


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_segments_change_nothing(spark, monkeypatch):
    """Scores are those of the exact levels, up to the filter's error, and the same for any number of segments."""
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 1 << 12)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    one = [tuple(r) for r in lm.scores(docs).collect()]
    close(one, brute([(r.doc_id, r.text) for r in docs.collect()]), 0.02)
    for size in (1, 1 << 14):
        several = [tuple(r) for r in lm.scores(docs, segment_bytes=size).collect()]
        assert [x[:5] for x in sorted(several, key=repr)] == [x[:5] for x in sorted(one, key=repr)]
        for x, y in zip(sorted(several, key=repr), sorted(one, key=repr)):
            assert math.isclose(x[5], y[5], rel_tol=1e-9) and math.isclose(x[6], y[6], rel_tol=1e-9)
