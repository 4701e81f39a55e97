"""Rules over the column names of many datasets at once.

Input is a columns table (dataset, column, ...). Word hits are aggregated per dataset
as flags, so a dataset with very many columns is never gathered into one list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions import fixed_values as V
from tablegauge.functions.text import first_match, has_any
from tablegauge.plans.joins import join_null_safe


def _word_flags(columns: DataFrame, words: Sequence[str], dataset: str) -> tuple[DataFrame, dict[str, str]]:
    """One row per dataset with one flag per word: does any column name contain it?"""
    distinct = list(dict.fromkeys(words))
    alias = {w: f"_w{i}" for i, w in enumerate(distinct)}
    name = F.lower("column")
    flags = columns.groupBy(dataset).agg(*[F.max(F.contains(name, F.lit(w))).alias(a) for w, a in alias.items()])
    return flags, alias


def rank_use_cases(columns: DataFrame, dataset: str = "dataset") -> DataFrame:
    """(dataset, place, use_case, score): use cases by the number of their words found.

    Ties keep the library order; a dataset without any hit gets one fallback row.
    """
    flags, alias = _word_flags(columns, [w for _, words in V.USE_CASES for w in words], dataset)
    scored = [
        F.struct(
            (-sum([F.col(alias[w]).cast("int") for w in words], F.lit(0))).alias("minus"),
            F.lit(i).alias("i"),
            F.lit(name).alias("use_case"),
        )
        for i, (name, words) in enumerate(V.USE_CASES)
    ]
    fallback = F.array(
        F.struct(F.lit(0).alias("minus"), F.lit(0).alias("i"), F.lit(V.NO_USE_CASE).alias("use_case"))
    )
    found = F.filter(F.array(*scored), lambda s: s["minus"] < 0)
    ranked = F.when(F.size(found) > 0, F.array_sort(found)).otherwise(fallback)
    return flags.select(dataset, F.posexplode(ranked).alias("_p", "_s")).select(
        dataset, (F.col("_p") + 1).alias("place"), "_s.use_case", (-F.col("_s.minus")).alias("score")
    )


def match_kpi_columns(columns: DataFrame, domain: str, dataset: str = "dataset") -> DataFrame:
    """(dataset, kpi, match): matched if any needed word is part of any column name, else partial."""
    library = V.KPI_CATALOG[domain]
    flags, alias = _word_flags(columns, [w for _, words in library for w in words], dataset)
    rows = []
    for name, words in library:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.col(alias[w])
        rows.append(F.struct(F.lit(name).alias("kpi"), F.when(hit, "matched").otherwise("partial").alias("match")))
    return flags.select(dataset, F.inline(F.array(*rows)))


def match_domain(domain: Column, library: str = "catalog") -> Column:
    """First library whose name is part of the domain text or contains it; null if none.

    An empty text is part of every name, so it gives the first library.
    """
    keys = list({"catalog": V.KPI_CATALOG, "suggested": V.SUGGESTED_KPIS}[library])
    text = F.lower(domain)
    return F.coalesce(
        *[F.when(F.contains(text, F.lit(k)) | F.contains(F.lit(k), text), F.lit(k)) for k in keys]
    )


def suggest_column_kpis(columns: DataFrame, dataset: str = "dataset", domain: str = "domain") -> DataFrame:
    """(dataset, place, kpi): the domain's KPIs, then those triggered by exact column names, no repeats.

    `columns` carries the domain text of its dataset in the `domain` column.
    """
    name = F.lower(F.trim("column"))
    flags = columns.groupBy(dataset).agg(
        match_domain(F.max(domain), "suggested").alias("_d"),
        *[F.max(name.isin(*names)).alias(f"_t{i}") for i, (_, names) in enumerate(V.COLUMN_KPIS)],
    )
    none = F.array().cast("array<string>")
    of_domain = F.coalesce(
        *[F.when(F.col("_d") == k, F.array(*[F.lit(n) for n in names])) for k, names in V.SUGGESTED_KPIS.items()],
        none,
    )
    triggered = F.array_compact(
        F.array(*[F.when(F.col(f"_t{i}"), F.lit(kpi)) for i, (kpi, _) in enumerate(V.COLUMN_KPIS)])
    )
    merged = F.array_distinct(F.concat(of_domain, triggered))
    return flags.select(dataset, F.posexplode(merged).alias("_p", "kpi")).select(
        dataset, (F.col("_p") + 1).alias("place"), "kpi"
    )


def feature_groups(columns: DataFrame, dataset: str = "dataset", wide: bool = False) -> DataFrame:
    """(dataset, group, column): feature groups a column feeds; generic if a dataset feeds none.

    `wide` uses the longer word lists (day, hour, view).
    """
    rules = V.FEATURE_GROUPS_WIDE if wide else V.FEATURE_GROUPS
    name = F.lower("column")
    groups = F.array_compact(F.array(*[F.when(has_any(name, words), F.lit(g)) for g, words in rules]))
    tagged = columns.select(dataset, "column", groups.alias("_g"))
    empty = (
        tagged.groupBy(dataset).agg(F.max(F.size("_g")).alias("_m")).filter(F.col("_m") == 0).select(dataset)
    )
    matched = tagged.select(dataset, F.explode("_g").alias("group"), "column")
    generic = join_null_safe(tagged, empty, [dataset]).select(dataset, F.lit("generic").alias("group"), "column")
    return matched.unionByName(generic)


def recommend_problem_type(goal: Column) -> Column:
    """Problem type of a goal text: the first rule with any word in it."""
    return first_match(F.lower(goal), V.PROBLEM_TYPES, V.DEFAULT_PROBLEM_TYPE)


def metric_advice_flags(context: Column) -> tuple[Column, Column]:
    """(favour_recall, favour_precision) from a context text."""
    text = F.lower(context)
    return has_any(text, V.RECALL_WORDS), has_any(text, V.PRECISION_WORDS)
