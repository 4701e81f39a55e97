"""Decontamination against brute force."""

import random
import re

import pytest

from fixtures import odd_docs  # noqa: F401
from tablegauge.llm import decontaminate as dc

UP = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def brute(docs, items):
    runs = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for t in range(len(w) - n + 1 if n else 0):
            runs.setdefault(tuple(w[t : t + n]), set()).add("" if item is None else str(item))
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for run, own in runs.items():
            for t in range(len(w) - len(run) + 1):
                if tuple(w[t : t + len(run)]) == run:
                    hit |= set(range(t, t + len(run)))
                    found |= own
        out.append((d, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def found(docs, items, **options):
    got = dc.contamination(docs, items, **options).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got), key=repr)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(3)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    long, other, short, tiny = new(40), new(13), new(7), ["Solo"]
    boiler = new(15)
    items = [(1, " ".join(long)), (2, ", ".join(other).upper()), (3, " ".join(short)), (4, "-".join(tiny)), (5, None), (6, ""), (7, "?!"),
             (8, " ".join(boiler + new(9))), (9, " ".join(boiler)), (9, " ".join(boiler)), (None, " ".join(boiler + new(3))),
             (10, " ".join(["aa"] * 20)), (11, "ÀÉ füße " + " ".join(other[:4]))]
    docs = [
        (1, " ".join(new(30) + long[3:30] + new(20))), (2, " ".join(long[:12] + new(40))), (3, ".".join(other)),
        (4, " ".join(new(300) + other)), (5, " ".join(new(247) + other)), (6, " ".join(new(10) + short + new(5) + short)),
        (7, "SOLO"), (8, " ".join(boiler + new(4) + boiler)), (9, " ".join(["aa"] * 200)), (10, " ".join(["aa"] * 12 + new(3))),
        (11, " ".join(other[:12] + new(1) + other[1:])), (12, "àé füße " + " ".join(other[:4])), (13, "ÀÉ FüßE " + " ".join(other[:4])),
        (14, " ".join(long[:13] + long[14:27])), (None, " ".join(long)), (1, " ".join(new(3))), (1, " ".join(long)), (1, " ".join(long)),
    ]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}, {"gram": 3}, {"gram": 13}])
def test_runs_of_all_lengths(spark, cases, options):
    docs, items = cases
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS item", "1 AS words", "2 AS print")
    want = brute(docs, items)
    assert found(d, b, **options) == want and sum(w[4] for w in want) > 8


def test_odd_documents(spark, odd_docs, cases):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = spark.createDataFrame([(1, "beta gamma"), (2, rows[0][1]), (3, "word19999 and")], "item_id long, text string")
    assert found(odd_docs, items) == brute(rows, [(r.item_id, r.text) for r in items.collect()])
    assert found(odd_docs, items.where("false")) == brute(rows, [])
    assert found(odd_docs.where("false"), items) == []
    kept = dc.decontaminate(odd_docs, items)
    assert kept.columns == odd_docs.columns
    clean = [d for d, *_, bad in brute(rows, [(r.item_id, r.text) for r in items.collect()]) if not bad]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(clean, key=repr)
