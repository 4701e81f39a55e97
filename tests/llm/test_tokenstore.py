"""Token stores: exact round trips."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fixtures import DATA, odd_docs  # noqa: F401
from tablegauge.llm import tokenstore

P = pytest.importorskip("public_tokenizers")


def expected(rows, file="word_bpe_49k.json"):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(file))
    out, at = [], 0
    for doc_id, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("block", [1 << 16, 1000])
def test_whole_table(spark, block):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert got(tokenstore.stored(docs.repartition(7), P.path("word_bpe_49k.json"), block=block)) == expected(rows)


@pytest.mark.parametrize("by", ["bit", "byte"])
@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_odd_documents(spark, odd_docs, by, file):
    found = got(tokenstore.stored(odd_docs, P.path(file), by=by, block=64))
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    each = sorted(((d, n, c) for d, _, n, c in expected(rows, file)), key=repr)
    assert sorted(((d, n, c) for d, _, n, c in found), key=repr) == each
    ids = [d for d, *_ in found]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    at = 0
    for _, start, n, _ in found:
        assert start == at
        at += n


def test_empty_table(spark, odd_docs):
    assert tokenstore.stored(odd_docs.where("false"), P.path("word_bpe_49k.json")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), st.sampled_from(["bit", "byte"]), st.integers(0, 31))
def test_planes(ids, by, shift):
    ids = np.array(ids, dtype="<u4") >> shift
    assert (tokenstore.unpack(tokenstore.pack(ids, by), len(ids), by) == ids).all()


def spec(name="word_bpe_49k.json"):
    with open(P.path(name), encoding="utf-8") as f:
        return f.read()


def test_only_tokenizers_that_drop_spaces_go_by_piece():
    assert tokenstore.drops_spaces(spec()) and tokenstore.light_spec(spec())
    assert not tokenstore.drops_spaces(spec("byte_bpe_50k.json")) and not tokenstore.light_spec(spec("byte_bpe_50k.json"))


def whole(text):
    return tokenstore.encoder(spec()).tokenizer.encode(text, add_special_tokens=False).ids


def by_piece(texts):
    out = []
    for ids, sizes in tokenstore.encoded(pa.array(texts, pa.string()), tokenstore.encoder(spec())):
        out += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    return out


LETTERS = list("aBzéÀÿßµªºİıſœΣς'sİ̇̀ \x1c\x85\xa0\n\t.,!?#(|>漢字😀123ŉǆﬁ") + ["<|endoftext|>", "'s", "'re", " ", "the", "The."]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(LETTERS), max_size=25).map("".join), min_size=1, max_size=5))
def test_pieces_encode_like_whole_texts(texts):
    assert by_piece(texts) == [whole(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_any_text_encodes_like_whole(text):
    assert by_piece([text]) == [whole(text)]


@pytest.mark.parametrize("part", [1, 20, 60])
def test_texts_in_parts(monkeypatch, part):
    monkeypatch.setattr(tokenstore, "PART", part)
    texts = [" ".join(f"w{i}" * (1 + i % 4) for i in range(50)), "", "x" * 100, "a b\nc " * 30, "end"]
    assert by_piece(texts) == [whole(t) for t in texts]
