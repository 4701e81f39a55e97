"""Personal data: the given patterns against plain regular expressions, and the model."""

import os
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fixtures import DATA, odd_docs  # noqa: F401
from tablegauge.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def fits(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")),
            "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def brute(text):
    out = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if fits(k, m.group())]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["1", "25", "255", "300", ".", ".", "@", "a", "a.b", "-", " ", "+", "(", ")", "%", "é", "4111111111111111",
                                 "10.0.0.1", "+49 151 ", "1234567", "x@y.de", "\n", "0", "00"]), max_size=14).map("".join))
def test_patterns_match_leftmost_like_regular_expressions(text):
    assert pii.base_spans(text) == brute(text)


def test_patterns_are_linear():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1 " * 100_000, "a" * 200_000 + "@"):
        pii.base_spans(text)


def test_windows_cover_all_seeds_and_overlap():
    text = "x" * 500 + "1" * 300 + "y" * 40 + "@" + "z" * 700 + "7"
    starts = pii.windows(text)
    covered = np.zeros(len(text), dtype=int)
    for a in starts:
        covered[a : a + pii.WIDTH] += 1
    assert all(covered[m.start()] for m in pii.SEED.finditer(text)) and starts == sorted(set(starts))
    assert (covered[500:800] >= 1).all() and covered[:400].sum() == 0 and pii.windows("no seed") == []


def test_gradients():
    rng = np.random.default_rng(0)
    m = pii.Model.new(3)
    x, y = rng.integers(0, pii.SYMBOLS, (3, 7)), rng.integers(0, pii.LABELS, (3, 7))
    _, grads = pii.loss_and_gradients(m, x, y)
    for name, v in m.arrays().items():
        for at in rng.integers(0, v.size, 4):
            keep = v.flat[at]
            v.flat[at] = keep + 1e-5
            up, _ = pii.loss_and_gradients(m, x, y)
            v.flat[at] = keep - 1e-5
            down, _ = pii.loss_and_gradients(m, x, y)
            v.flat[at] = keep
            assert abs((up - down) / 2e-5 - grads[name].flat[at]) < 1e-4


def test_decoding_is_the_best_path():
    m = pii.Model.new(1)
    m.step += np.random.default_rng(2).normal(size=m.step.shape)
    x = np.array([[1, 5, 9]])
    s = pii.emissions(m, x)[0]
    best = max(np.ndindex(*[pii.LABELS] * 3), key=lambda p: sum(s[i, p[i]] for i in range(3)) + m.step[p[0], p[1]] + m.step[p[1], p[2]])
    assert tuple(pii.decode(m, x)[0]) == best


def test_reconciling_takes_the_central_window():
    found = np.array([[1] * 8, [3] * 8])
    assert pii.reconciled(12, [0, 4], found).tolist() == [1] * 6 + [3] * 6
    spans = pii.model_spans("call 0151 234 5678 now", np.array([0] * 5 + [7] + [8] * 12 + [0] * 4), [])
    assert spans == [("phone", 5, 18)]
    assert pii.model_spans("call 0151 234 5678 now", np.array([0] * 5 + [7] + [8] * 12 + [0] * 4), [("card", 9, 12)]) == []


@pytest.fixture(scope="module")
def sample():
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{DATA.replace('sf0.001', 'sf0.1')}/documents.parquet", columns=["text"])["text"].to_pylist()
    rows = next(pii._windows(iter([pa.RecordBatch.from_pydict({"text": texts})]))).to_pylist()
    return [(r["text"], r["spans"]) for r in rows]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_held_out_accuracy(sample):
    order = np.random.default_rng(0).permutation(len(sample))
    cut = min(len(sample) * 2 // 3, 900)
    m = pii.train(*pii.examples([sample[i] for i in order[:cut]]))
    x, y = pii.examples([sample[i] for i in order[cut : cut + 900]])
    p = pii.decode(m, x)
    assert ((p == y) & (y > 0)).sum() > 0.9 * (y > 0).sum() and ((p != y) & (y == 0)).sum() < 0.1 * (y > 0).sum()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pii.find(docs, steps=40).collect()
    assert len(got) == len(texts) and sum(r.n_email for r in got) > 0
    for r in got:
        want = brute(texts[r.doc_id])
        assert r.base == pii.joined(want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == s[0] for s in want) for k in pii.KINDS]
        assert set(want) <= set(pii.parsed(r.spans))


def test_odd_documents(spark, odd_docs):  # noqa: F811
    some = odd_docs.withColumn("text", F.when(F.col("doc_id") == 5, "mail a.b@c.de, +49 30 1234567 and 10.0.0.1 漢 4111-1111-1111-1111")
                               .otherwise(F.col("text"))).drop("spans").withColumn("spans", F.lit("clash"))
    got = {(r.doc_id, r.base) for r in pii.find(some, steps=20).collect()}
    five = next(b for d, b in got if d == 5)
    assert five == "email:5:13,phone:15:29,ip:34:42,card:45:64"
    assert pii.find(some, steps=20).count() == some.count()
    assert pii.find(some.where("false")).count() == 0
    assert {r.spans for r in pii.find(some.where("doc_id = 6")).collect()} == {""}


def test_rewritten_spans_stay_in_place():
    for turn in range(4):
        text, spans = pii.rewritten("a x@y.de b +49 30 123 4567 c", [("email", 2, 8), ("phone", 11, 26)], turn)
        for kind, a, b in spans:
            assert text[a - 1] == " " and text[b] == " " and (kind != "email" or text[a] == "x")
