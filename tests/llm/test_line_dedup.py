"""Line dedup against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import odd_docs  # noqa: F401
from tablegauge.llm import linededup as ld

UP = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(UP)


def brute(rows, chars=40, docs=5):
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= chars:
                holders[key(x)].add(d)
    last = {k: max((x for x in h if x is not None), default=None) for k, h in holders.items() if len(h) >= docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in last or d == last[key(x)]]
        out.append((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df, **options):
    got = ld.dedup_lines(df, **options).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256))
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("bits", [1 << 27, 1 << 6])
def test_repeated_lines(spark, bits):
    line, other = "This line is repeated in many documents, É", "x" * 39 + "é"
    rows = [(d, f"own {d}\n  {line.upper() if d % 2 else line}\t\n{line}\n{'tail' * d}") for d in range(8)]
    rows += [(20 + d, f"{other}\nshort\nshort") for d in range(5)] + [(40 + d, "y" * 50) for d in range(4)]
    rows += [(None, line), (None, line + "\n"), (60, None), (61, ""), (62, "z" * 45 + "\n" + "z" * 45), (3, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert found(df, max_bits=bits) == want and sum(w[2] for w in want) > 15


@pytest.mark.parametrize("least", [1, 3])
def test_odd_documents(odd_docs, least):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(odd_docs, least_chars=least, least_docs=2) == brute(rows, least, 2)
    assert found(odd_docs.where("false")) == []
    assert ld.dedup_lines(odd_docs).select("row.*").columns == odd_docs.columns


def test_second_filter_holds_every_repeated_key():
    rng = np.random.default_rng(0)
    bits = 1 << 12
    once, twice = np.zeros(bits // 8, dtype=np.uint8), np.zeros(bits // 8, dtype=np.uint8)
    keys = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    ld.note(once, twice, keys[:200], bits)
    ld.note(once, twice, keys[150:], bits)
    assert ld._has(once, ld.probes(keys, bits)).all() and ld._has(twice, ld.probes(keys[150:200], bits)).all()
    assert ld._has(twice, ld.probes(keys[:150], bits)).mean() < 0.2


def test_filter_has_what_was_put_in():
    from tablegauge.llm import linededup

    rng = np.random.default_rng(3)
    for n in (0, 1, 5000):
        at, filter_, plain = rng.integers(0, 1 << 13, (3, n)).astype(np.uint64), np.zeros(1 << 10, dtype=np.uint8), np.zeros(1 << 13, dtype=bool)
        filter_[7] = 9
        plain[[56, 59]] = True
        linededup._put(filter_, at)
        plain[at.astype(np.int64)] = True
        assert (np.unpackbits(filter_, bitorder="little").astype(bool) == plain).all()
