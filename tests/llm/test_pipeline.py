"""The pipeline against brute force: every stage but the learned verdicts is worked out in plain Python."""

import os
import re
from collections import defaultdict

import pytest

import corpus_pipeline
import test_decontaminate
import test_mixing
import test_simhash
import test_tokenstore
from fixtures import DATA, odd_docs  # noqa: F401
from tablegauge.llm import qualityrules
from tablegauge.llm.common import written

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


def base_failed(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = defaultdict(list)
    for i in range(len(w) - 2):
        runs[tuple(w[i : i + 3])].append(i)
    repeated = {x for at in runs.values() if len(at) > 1 for i in at for x in (i, i + 1, i + 2)}
    return len(w) < 50 or 100 * len(repeated) > 50 * len(w)


def brute_pipeline(rows, verdicts, benchmark):
    """(rows after each stage but the last, the store's documents); verdicts: what the learned list says, by id."""
    stages = [[r for r in rows if not base_failed(r.text) and verdicts[r.doc_id]]]
    prints = {r.doc_id: test_simhash.brute_print(r.text) for r in stages[-1]}
    roots = test_simhash.brute_components(set(prints.values()))
    first = {}
    for d, p in prints.items():
        first[roots[p]] = min(first.get(roots[p], d), d)
    stages.append([r for r in stages[-1] if first[roots[prints[r.doc_id]]] == r.doc_id])
    bad = {d for d, *_, contaminated in test_decontaminate.brute([(r.doc_id, r.text) for r in stages[-1]], benchmark) if contaminated}
    stages.append([r for r in stages[-1] if r.doc_id not in bad])
    copies = {d: n for d, *_, n in test_mixing.brute([(r.doc_id, r.text, r.source) for r in stages[-1]])}
    stages.append([r for r in stages[-1] for _ in range(copies[r.doc_id])])
    store = test_tokenstore.expected(sorted((r.doc_id, r.text) for r in stages[-1]))
    return stages, store


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    judged = qualityrules.judged(docs, labels).collect()
    rows = docs.collect()
    assert {r.doc_id: r.base_failed for r in judged} == {r.doc_id: base_failed(r.text) for r in rows}
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    stages, store = brute_pipeline(rows, {r.doc_id: r.kept for r in judged}, benchmark)
    assert all(len(b) < len(a) for a, b in zip([rows, *stages], stages[:3]))
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_dedup", "benchmark_decontamination", "source_mix", "token_output"]
    for (name, stage), want in zip(corpus_pipeline.STAGES, stages):
        kept = written(stage(spark, docs, DATA), name)
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, want)), name
        docs = kept
    got = [tuple(r) for r in corpus_pipeline.run(spark, DATA).orderBy("start").collect()]
    assert got == store


@pytest.mark.parametrize("k", range(5))
def test_each_stage_takes_odd_and_empty_tables(spark, odd_docs, k):  # noqa: F811
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd_docs, DATA)
    out.collect()
    assert name == "token_output" or out.columns == odd_docs.columns
    assert stage(spark, odd_docs.where("false"), DATA).count() == 0


def test_of_rows_with_one_id_and_text_always_the_same_stays(spark, odd_docs):  # noqa: F811
    rows = odd_docs.withColumn("words", odd_docs["size"].cast("string"))
    many = rows.unionByName(rows.selectExpr(*[f"'other' AS {c}" if c == "source" else c for c in rows.columns]))
    from tablegauge.llm import simhash

    kept = [sorted(map(repr, simhash.keep_first(many.repartition(n)).collect())) for n in (1, 5, 9)]
    assert kept[0] == kept[1] == kept[2]
