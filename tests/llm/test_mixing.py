"""Mixing against brute force."""

import hashlib
import math
import re
from collections import defaultdict

import pytest

from fixtures import odd_docs  # noqa: F401
from tablegauge.llm import mixing


def brute(rows, weights=(1, 2, 3), most=3):
    sizes = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in rows]
    keys = [f"null:{hashlib.md5((t or '').encode()).hexdigest()}" if d is None else str(d) for d, t, _ in rows]
    total = defaultdict(int)
    for _, s, n in sizes:
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed = set()
    while True:
        left = sum(total.values()) - sum(most * total[s] for s in fixed)
        share = left / sum(weight[s] for s in order if s not in fixed)
        more = {s for s in order if s not in fixed and share * weight[s] > most * total[s]}
        if not more:
            break
        fixed |= more
    target = {s: float(most * total[s]) if s in fixed else share * weight[s] for s in order}
    out = []
    for (d, s, n), key in zip(sizes, keys):
        rate = target[s] / total[s] if total[s] else 0.0
        coin = int(hashlib.md5(f"mix:{key}".encode()).hexdigest()[:13], 16) / 16**13
        out.append((d, n, total[s], target[s], math.floor(rate) + (coin < rate - math.floor(rate))))
    return sorted(out, key=repr)


def check(df, **options):
    got = [tuple(r) for r in mixing.takes(df, **options).select("row.doc_id", "size", "source_size", "target", "copies").collect()]
    want = brute([(r.doc_id, r.text, r.source) for r in df.collect()])
    got = sorted(got, key=lambda r: repr((r[0], r[1], r[2], r[4])))
    want = sorted(want, key=lambda r: repr((r[0], r[1], r[2], r[4])))
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
    assert all(g[4] <= 3 for g in got)
    return got


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}])
def test_small_and_large_sources(spark, options):
    rows = [(i, "w " * (5 + i % 50), "big") for i in range(600)] + [(1000 + i, "a b c", s) for i, s in enumerate(["tiny", "Z", "é", "a", None, "big2"] * 3)]
    rows += [(2000 + i, "x " * 40, "mid") for i in range(60)] + [(3000, "", "empty"), (3001, None, "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = check(df, **options)
    assert {g[3] for g in got if g[2] == 9} == {27.0} and {g[4] for g in got if g[2] == 0} == {0}
    # sources come near their targets
    taken = sum(g[1] * g[4] for g in got if g[2] == 2400)
    assert abs(taken - next(g[3] for g in got if g[2] == 2400)) < 0.2 * 2400
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(g[4] for g in got)
    assert sorted(map(tuple, mixed.collect()), key=repr) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=repr)


def test_odd_documents(odd_docs):  # noqa: F811
    check(odd_docs)
    assert mixing.mix(odd_docs).columns == odd_docs.columns
    assert mixing.mix(odd_docs.where("false")).count() == mixing.takes(odd_docs.where("false")).count() == 0
    assert mixing.mix(odd_docs.where("doc_id in (2, 3)")).count() == 0


def test_rows_without_an_id_have_coins_of_their_own(spark):
    """A source whose rows have no id comes near its target too."""
    rows = [(None, f"text number {i}", "a") for i in range(2000)] + [(i, "some words here", "b") for i in range(2000)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4))
    for size in {g[2] for g in got}:
        own = [g for g in got if g[2] == size]
        for null in (True, False):
            part = [g for g in own if (g[0] is None) == null]
            if part:
                assert abs(sum(g[1] * g[4] for g in part) / sum(g[1] for g in part) - part[0][3] / size) < 0.1
