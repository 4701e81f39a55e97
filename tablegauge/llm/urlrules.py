"""URL filters: host and path rules, and association rules mined from the URLs they label.

Addresses that a given rule decides are the labelled ones. Tokens that stand in too few of them
are left out, and tokens that stand in the same ones are one item: they say the same, and each
of them is worth the item. FP-growth mines combinations of items together with the label;
combinations that pass the support and confidence bounds and are not implied by a smaller one
become rules. A rule stands in an inverted index under its rarest item; addresses meet it there
and must hold all its other items. Only DataFrame functions and Spark's FP-growth run here.

FP-growth counts every frequent combination, 2^n of an address of n items. Where an address has more
than MOST_ITEMS, the same rules are mined level by level: a combination that all its rows agree on,
or that holds for as many rows as one with an item less, is in no larger rule and not extended. A
rule holds for `least_rows` labelled addresses at least. All items of all addresses count, for
mining as for judging, unless the caller names a number of most_items.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import BROADCAST_BYTES, UPPER, keep, whole, written

#: fixed by the contract: host, path, verdict
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BLOCK, ALLOW = "block", "allow"
MARK = "verdict="
# items of an address up to which FP-growth mines
LEAST_ROWS, MOST_ITEMS = 20, 12
# parts into which the pages of one token set are dealt
SALTS = 16


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without '://'."""
    u = whole(url)
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(u, pattern, 1), UPPER, UPPER.lower()), F.regexp_extract(u, pattern, 2)


def given_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: str | Column) -> Column:
    """The different tokens of an address: scheme, host labels, host endings, path segments,
    endings and query names; digits read as #. Empty for a null address."""
    u = whole(url)
    host, path = host_and_path(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    shaped = F.regexp_replace(path, "[0-9]+", "#")
    parts = F.filter(F.split(shaped, "/"), lambda x: x != "")
    query = F.regexp_extract(u, r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0]), lambda x: x != "")
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    scheme = F.regexp_extract(u, r"(?s)^(.*?)://", 1)
    ending = F.regexp_extract(shaped, r"\.([A-Za-z]+)$", 1)
    tagged = F.concat(
        F.array(F.concat(F.lit("scheme:"), scheme), F.concat(F.lit("ending:"), ending)),
        F.transform(labels, lambda x: F.concat(F.lit("label:"), x)),
        F.transform(F.when(F.size(labels) > 0, ends).otherwise(F.array().cast("array<string>")), lambda x: F.concat(F.lit("host:"), x)),
        F.transform(parts, lambda x: F.concat(F.lit("path:"), x)),
        F.transform(names, lambda x: F.concat(F.lit("query:"), x)),
    )
    return F.sort_array(F.array_distinct(F.filter(tagged, lambda x: ~x.endswith(":"))))


def token_items(labelled: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(token, item, n) from rows `tokens`: tokens of n rows, least_rows at least, and what they count as.

    Tokens that the same rows have are one item, named by the least of them. Rows are told apart
    by two hashes, whose sums tell sets of rows apart.
    """
    each = labelled.select(F.explode("tokens").alias("token"), *[F.xxhash64(F.lit(k), "tokens").alias(f"h{k}") for k in (1, 2)])
    sums = [F.sum(F.col(f"h{k}").cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
    counted = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), *sums).where(F.col("n") >= least_rows)
    names = counted.groupBy("n", "s1", "s2").agg(F.min("token").alias("item"))
    return counted.join(names, ["n", "s1", "s2"]).select("token", "item", "n")


def _small(df: DataFrame, text: Column, broadcast_bytes: int) -> DataFrame:
    """df, to be broadcast if its rows, measured, are few."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(text) + 64), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= broadcast_bytes else df


def with_items(sets: DataFrame, items: DataFrame) -> DataFrame:
    """(a, b, items) of the token sets a, b, tokens that hold an item; the most frequent item first."""
    each = sets.select("a", "b", F.explode("tokens").alias("token")).join(items, "token")
    listed = each.groupBy("a", "b").agg(F.sort_array(F.collect_set(F.struct((-F.col("n")).alias("n"), "item"))).alias("items"))
    return listed.select("a", "b", F.transform("items", lambda x: x["item"]).alias("items"))


def _without_one(antecedent: str = "antecedent") -> Column:
    """The combinations with an item less."""
    return F.transform(antecedent, lambda t: F.array_remove(antecedent, t))


def rules_by_level(rows: DataFrame, least: int, confidence: float) -> DataFrame:
    """The rules antecedent, verdict, n, all that no other implies, from rows (items, verdict) of any length.

    n rows of `least` at least have the antecedent and the verdict, `all` the antecedent. A rule has
    more confidence than each of its combinations with an item less. So these are held by more rows,
    and by rows of several verdicts, of which one has `least`; only such combinations are extended.
    Equal rows are counted once, tasks hold combinations of single rows.
    """
    counts = rows.groupBy("items", "verdict").agg(F.count(F.lit(1)).alias("n"))
    sets = counts.groupBy("items").agg(F.collect_list(F.struct("verdict", "n")).alias("each"))
    sets = keep(sets.withColumn("id", F.monotonically_increasing_id()))
    held = sets.select("id", F.explode("items").alias("t")).select("id", F.array("t").alias("antecedent"))
    found, before, size = [], None, 1
    while True:
        each = held.join(sets.select("id", "each"), "id").select("antecedent", F.explode("each").alias("e"))
        by = each.groupBy("antecedent", "e.verdict").agg(F.sum("e.n").alias("n"))
        level = by.groupBy("antecedent").agg(
            F.sum("n").alias("all"), F.max("n").alias("most"), F.map_from_entries(F.collect_list(F.struct("verdict", "n"))).alias("by")).where(F.col("most") >= least)
        if before is not None:
            # all with an item less must be there, and held by more rows
            less = level.select("antecedent", "all", F.explode(_without_one()).alias("less"))
            less = less.join(before.select(F.col("antecedent").alias("less"), F.col("all").alias("other"), F.col("by").alias("by_less")), "less").where("other > all")
            less = less.groupBy("antecedent").agg(F.collect_list(F.struct("other", "by_less")).alias("less")).where(F.size("less") == size)
            level = level.join(less, "antecedent")
        else:
            level = level.withColumn("less", F.array().cast("array<struct<other:bigint,by_less:map<string,bigint>>>"))
        level = keep(level)
        sure = level.select("antecedent", "all", "less", F.explode("by").alias("verdict", "n")).where((F.col("n") >= least) & (F.col("n") / F.col("all") >= confidence))
        # the shares of both as whole numbers
        better = F.forall("less", lambda x: F.col("n") * x["other"] > F.coalesce(x["by_less"][F.col("verdict")], F.lit(0)) * F.col("all"))
        found.append(sure.where(better).select("antecedent", "verdict", "n", "all"))
        before = level.where(F.size("by") > 1).select("antecedent", "all", "by")
        alive = held.join(before, "antecedent", "left_semi").select(
            "id", F.slice("antecedent", 1, size - 1).alias("head") if size > 1 else F.array().cast("array<string>").alias("head"), F.element_at("antecedent", -1).alias("last"))
        one, two = alive, alive.withColumnRenamed("last", "next")
        held = keep(one.join(two, ["id", "head"]).where("last < next").select("id", F.concat("head", F.array("last", "next")).alias("antecedent")))
        size += 1
        if held.isEmpty():
            return reduce(DataFrame.unionByName, found)


def mine_rules(
    labelled: DataFrame, support: float = 0.005, confidence: float = 0.8, least_rows: int = LEAST_ROWS, most_items: int | None = None,
) -> DataFrame:
    """Association rules antecedent, verdict, confidence, support from rows (items, verdict).

    A rule implied by one with fewer items, the same verdict and no less confidence goes. Empty
    without labelled rows. All items of a row count, or the first most_items. FP-growth brings the
    single items that reach the support to the driver, at most items per row / support of them;
    where a row has more than MOST_ITEMS the same rules are mined by level.
    """
    items = F.col("items") if most_items is None else F.slice("items", 1, most_items)
    rows = labelled.where(F.size("items") > 0).select(items.alias("items"), "verdict")
    kind = "antecedent array<string>, verdict string, confidence double, support double"
    n, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("items"))).first()
    if n < least_rows:
        return labelled.sparkSession.createDataFrame([], kind)
    # a little less than the share, so that least_rows rows reach it in floating numbers too
    share = max(support, (least_rows - 0.5) / n)
    if longest > MOST_ITEMS:
        sure = rules_by_level(rows, math.ceil(share * n), confidence)
        return sure.select("antecedent", "verdict", (F.col("n") / F.col("all")).alias("confidence"), (F.col("n") / F.lit(n)).alias("support"))
    marked = rows.select(F.concat("items", F.array(F.concat(F.lit(MARK), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(marked)
    rules = model.associationRules.where(F.col("consequent")[0].startswith(MARK)).select(
        F.sort_array("antecedent").alias("antecedent"), F.substring_index(F.col("consequent")[0], "=", -1).alias("verdict"), "confidence", "support")
    rules = keep(rules)
    # each rule looks up the rules without one of its items; implied ones fall step by step
    less = rules.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("t")).select(
        F.col("antecedent").alias("of"), F.col("confidence").alias("c"), "verdict", F.array_remove("antecedent", F.col("t")).alias("antecedent"))
    smaller = rules.select("antecedent", "verdict", F.col("confidence").alias("other"))
    implied = less.join(smaller, ["antecedent", "verdict"]).where("other >= c").select(F.col("of").alias("antecedent"), "verdict").distinct()
    return rules.join(implied, ["antecedent", "verdict"], "left_anti").select("antecedent", "verdict", "confidence", "support")


def rule_verdicts(sets: DataFrame, rules: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(a, b, mined) of the sets (a, b, items) that hold a rule's items: the verdict of the surest such rule.

    Surest is by confidence, then support, then number of items; a remaining tie blocks.
    """
    rules = keep(rules)
    counts = sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    each = rules.select("*", F.explode("antecedent").alias("item")).join(counts, "item", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)), "item"))
    index = each.groupBy("antecedent", "verdict", "confidence", "support").agg(rarest.alias("r")).withColumn("item", F.col("r.item")).drop("r")
    size = rules.agg(F.coalesce(F.sum(F.octet_length(F.array_join("antecedent", " ")) + 24 * F.size("antecedent") + 96), F.lit(0))).first()[0]
    index = F.broadcast(index) if size <= broadcast_bytes else index
    met = sets.select("a", "b", "items", F.explode("items").alias("item")).join(index, "item").where(F.size(F.array_except("antecedent", "items")) == 0)
    surest = F.max(F.struct("confidence", "support", F.size("antecedent"), "verdict"))
    return met.groupBy("a", "b").agg(surest["verdict"].alias("mined"))


def judge(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
    support: float = 0.005, confidence: float = 0.8, least_rows: int = LEAST_ROWS, most_items: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict.

    The verdict is the given rule's, else that of the surest mined rule, else allow. Null and
    malformed addresses have an empty host and path, no rule and no tokens beyond their query, and
    are allowed unless a mined rule says otherwise. Repeated rows are judged alike; other columns
    are not read.
    """
    host, path = host_and_path(f"`{url}`")
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path"), url_tokens(f"`{url}`").alias("tokens"))
    # a token set is told by 128 bits
    digests = {x: F.xxhash64(F.lit(k), "tokens") for k, x in enumerate("ab")}
    marked = written(rows.withColumn("given", given_rule(F.col("host"), F.col("path"), rules)).withColumns(digests), "urls")
    labelled = marked.where("given is not null").select("a", "b", "tokens", F.col("given.verdict").alias("verdict"))
    items = keep(token_items(labelled, least_rows))
    items = _small(items, F.concat("token", "item"), broadcast_bytes)
    sets = marked.where(F.size("tokens") > 0).select("a", "b", "tokens").dropDuplicates(["a", "b"])
    held = written(with_items(sets, items), "items")
    mined = mine_rules(labelled.select("a", "b", "verdict").join(held, ["a", "b"]), support, confidence, least_rows, most_items)
    open_sets = marked.where("given is null").select("a", "b").distinct()
    judged = keep(rule_verdicts(held.join(open_sets, ["a", "b"], "left_semi"), mined, broadcast_bytes))
    # one token set may be that of a large part of all pages
    few = _small(judged, F.col("mined"), broadcast_bytes)
    if few is judged:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        found = marked.withColumn("salt", F.pmod(F.xxhash64("page_id", "path", "host"), F.lit(SALTS)).cast("int")).join(
            judged.select("*", salts.alias("salt")), ["a", "b", "salt"], "left")
    else:
        found = marked.join(few, ["a", "b"], "left")
    return found.select("page_id", "host", "path", F.col("given.rule").alias("rule"), F.coalesce("given.verdict", "mined", F.lit(ALLOW)).alias("verdict"))
