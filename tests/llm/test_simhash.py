"""SimHash links against brute force."""

import os
import re
import random
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from fixtures import DATA, odd_docs  # noqa: F401
from tablegauge.llm import graph, simhash

UP = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= 2:
            root[find(b)] = find(a)
    return {p: find(p) for p in prints}


def expected(rows):
    prints = [(d, brute_print(t)) for d, t in rows]
    roots = brute_components({p for _, p in prints})
    least = {}
    for d, p in prints:
        if d is not None:
            least[roots[p]] = min(least.get(roots[p], d), d)
    return sorted(((d, f"{p:016x}", least.get(roots[p])) for d, p in prints), key=repr)


def found(df):
    got = simhash.near_duplicates(df).select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0"), "component_id")
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_odd_documents(spark, odd_docs):
    assert found(odd_docs) == expected([(r.doc_id, r.text) for r in odd_docs.collect()])
    empty = odd_docs.where("false")
    assert simhash.near_duplicates(empty).count() == simhash.keep_first(empty).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert found(docs) == expected([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("posting", [1, 3, 64])
@pytest.mark.parametrize("distance", [1, 2])
def test_links_are_whole_whatever_the_posting_limit(spark, posting, distance):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(20)}
    for base in list(prints):
        for _ in range(6):
            prints.add(base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 4))) % (1 << 64))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.linked_fingerprints(spark.createDataFrame([(p,) for p in signed], "print long"), distance, posting)
    roots = {r.node: r.root for r in graph.components(links).collect()}
    want = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= distance]
    assert want and all(roots[a] == roots[b] for a, b in want)
    linked = {x for pair in want for x in pair}
    assert set(roots) == linked
    near = {}
    for a, b in want:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for start in linked:  # a root's members are reachable by links
        seen, todo = {start}, [start]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert {x for x in linked if roots[x] == roots[start]} == seen


def test_keep_first_leaves_one_row_of_each_group(spark, odd_docs):
    rows = simhash.keep_first(odd_docs).collect()
    assert rows[0].asDict().keys() == odd_docs.first().asDict().keys()
    want = set(brute_components({brute_print(r.text) for r in odd_docs.collect()}).values())
    assert len(rows) == len(want)
    assert [r.doc_id for r in rows if (r.text or "").lower().startswith("alpha")] == [1]


def test_chain_of_links_is_one_component(spark):
    links = spark.range(400).selectExpr("id AS a", "id + 1 AS b")
    assert {r.root for r in graph.components(links).collect()} == {0}
