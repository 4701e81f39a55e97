"""Quality statistics and rules against brute force."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fixtures import DATA, odd_docs  # noqa: F401
from tablegauge.llm import qualityrules as q

SPACE = "\x20\t\n\x0b\x0c\r"
KEYS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    threes = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {t for t, n in Counter(threes).items() if n > 1}
    covered = {i + k for i, t in enumerate(threes) if t in often for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def check(df):
    got = q.statistics(df).select("doc_id", *KEYS)
    want = sorted(((r.doc_id, *brute(r.text)) for r in df.collect()), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_odd_documents(odd_docs):
    check(odd_docs)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_whole_table(spark):
    check(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_repeats(spark):
    texts = ["a b c a b c", "a b c d", "a a a a", "x a b c y a b c z", "a b", "l\nl\n \n\nm\nl", "& | <", "a b c\na b\tc q q q q"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def labelled(spark, n, junk):
    rows = spark.range(n).withColumnRenamed("id", "doc_id")
    for i, f in enumerate(q.FEATURES):
        rows = rows.withColumn(f, F.rand(i))
    return rows.withColumn("junk", F.expr(junk))


def test_rules_find_what_parts_the_kinds(spark):
    rows = labelled(spark, 4000, "symbol_share > 0.8 or (upper_share > 0.5 and mark_share <= 0.3)").cache()
    rules = q.learn_rules(rows)
    said = rows.withColumn("kept", q.verdict(rules)).groupBy("junk", "kept").count().collect()
    by = {(r.junk, r.kept): r["count"] for r in said}
    assert by[(True, False)] > 0.9 * (by[(True, False)] + by.get((True, True), 0))
    assert by.get((False, False), 0) < 0.03 * by[(False, True)]
    assert {c.feature for r in rules for c in r} >= {"symbol_share", "upper_share", "mark_share"}
    assert q.learn_rules(rows) == rules


def test_no_rules_without_both_kinds(spark):
    assert q.learn_rules(labelled(spark, 200, "true")) == []
    assert q.learn_rules(labelled(spark, 200, "false")) == []
    assert q.learn_rules(labelled(spark, 0, "true")) == []
    assert q.learn_rules(labelled(spark, 900, "rand(99) < 0.3")) == []
    assert str(q.Condition("n_words", True, 3.0)) == "n_words > 3"


def test_labels_with_nulls_and_repeats(spark, odd_docs):
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 0), (8, None), (8, 1), (99, 0)], "doc_id long, quality int")
    labels = labels.withColumn("text", F.lit("clash")).withColumn("n_words", F.lit(1))
    found = q.judged(odd_docs, labels).select("doc_id", "base_failed", "kept").collect()
    assert len(found) == odd_docs.count()
    assert {r.doc_id for r in found if not r.base_failed} == {8}
    kept = q.filter_quality(odd_docs, labels)
    assert kept.columns == odd_docs.columns and [r.doc_id for r in kept.collect()] == [8]
    marks = q.labelled_statistics(q.statistics(odd_docs), labels)
    assert [(r.doc_id, r.junk) for r in marks.collect()] == [(8, False)]
    assert q.judged(odd_docs.where("false"), labels.where("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_held_out_accuracy(spark):
    # the smaller folders have fewer labelled junk rows than a rule needs
    folder = DATA.replace("sf0.001", "sf0.1")
    stats = q.labelled_statistics(q.statistics(spark.read.parquet(f"{folder}/documents.parquet")), spark.read.parquet(f"{folder}/labels.parquet")).cache()
    rules = q.learn_rules(stats.where("doc_id % 2 = 0"))
    r = stats.where("doc_id % 2 = 1").withColumn("kept", q.verdict(rules)).agg(
        F.avg((F.col("kept") != F.col("junk")).cast("int")).alias("right"), F.count_if(~F.col("junk") & ~F.col("kept")).alias("lost")).first()
    assert r.right > 0.95 and r.lost <= 2
