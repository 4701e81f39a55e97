"""The divergence audit against plain counting in exact whole numbers."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fixtures import LONG, odd_docs  # noqa: F401
from tablegauge.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
terms_of = lambda text: TERM.findall((text or "").translate(LOWER))


def brute(rows, least=10, top=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, terms = lang or "", source or "", terms_of(text)
        groups[lang].add(source)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def shares(own):
            n = sum(own[t] for t in kept)
            return {t: 1 + 10**9 * (own[t] + 2) // (n + 2 * v) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            own = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", own, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])]
    return sorted(out)


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "'x' AS term", "1 AS n", "2 AS value").repartition(5)
    got = D.audit(df, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    names = {k: v for k, v in options.items() if k in ("top",)}
    want = brute(rows, options.get("least_docs", 10), **names)
    assert sorted(map(tuple, got.collect())) == want
    return want


@given(st.lists(st.text(alphabet="aZ é漢😀@[`{0 \n", max_size=12), max_size=6), st.integers(1, 3))
@settings(max_examples=200, deadline=None)
def test_terms_of_a_batch(texts, least):
    batch = pa.array(["x y"] + texts + [""], pa.string()).slice(1)
    terms, doc = D.batch_terms(batch, least)
    want = [(t.encode(), i) for i, x in enumerate(texts) for t in terms_of(x) if len(t.encode()) >= least]
    assert list(zip(terms.to_pylist(), doc.tolist())) == want


def corpus(n, sources, seed):
    rng = random.Random(seed)
    stems = ["so", "some", "somewhat", "somewhatlonger", "somewhatlongerstill" * 3, "été", "étéàjamais", "漢字", "漢字漢字漢字漢字", "word", "words", "a", "A"]
    stems += [f"rare{i}" for i in range(40)] + [f"commonprefix{'x' * i}" for i in range(30)]
    rows = []
    for i in range(n):
        source = sources[0] if rng.random() < 0.4 else rng.choice(sources)
        lang = "en" if rng.random() < 0.7 else rng.choice(["de", "", None])
        rows.append((" ".join(rng.choice(stems) + rng.choice(["", "", "s", ".", "1x"]) for _ in range(rng.randrange(30))), lang, source))
    return rows


@pytest.mark.parametrize("options", [{}, {"least_docs": 3, "first_bytes": 1, "top": 3}, {"least_docs": 1, "first_bytes": 64}])
def test_against_plain_counting(spark, options):
    rows = corpus(400, ["web", "Web", "news", None, "", "é"], 3)
    rows += [("copied passage here", "en", "web")] * 50 + [(None, "xx", "only"), ("", "xx", None), ("one two", "yy", "z"), (LONG, "en", "books"), (None, None, None)]
    want = check(spark, rows, **options)
    assert {r[2] for r in want} == {"pair", "term"}


def test_many_sources_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "HELD", 1)
    monkeypatch.setattr(D, "CELLS", 64)
    rows = corpus(900, [f"s{i}" for i in range(300)], 4)
    check(spark, rows, least_docs=5)


def test_collisions_in_the_bitmap_change_nothing(spark, monkeypatch):
    rows = corpus(300, ["a", "b", "c"], 5)
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    # every prefix seems open
    monkeypatch.setattr(D, "_bitmap", lambda keys: spark.sparkContext.broadcast(b"\xff" * (D.BITS // 8)))
    assert sorted(map(tuple, D.audit(df).collect())) == brute(rows)


def test_odd_documents(spark, odd_docs):  # noqa: F811
    docs = odd_docs.selectExpr("*", "CASE WHEN doc_id % 2 = 0 THEN 'en' END AS lang")
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    for least in (1, 2, 10):
        assert sorted(map(tuple, D.audit(docs, least_docs=least).collect())) == brute(rows, least)
    assert D.audit(docs.where("false")).count() == 0


def test_shares_are_exact():
    import numpy as np

    count = np.array([0, 5, 10**15], dtype=np.int64)
    of = np.array([7, 10**9 + 7, 8 * 10**15], dtype=np.int64)
    assert D._share(count, of).tolist() == [1 + 10**9 * (int(c) + 2) // int(m) for c, m in zip(count, of)]
