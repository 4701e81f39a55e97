"""Keyword expressions on text columns. Tests are substring tests on lower-cased text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_any(lowered: Column, words: Sequence[str]) -> Column:
    """True if any word occurs anywhere in the (already lower-cased) text."""
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(w)) for w in words])


def hits(lowered: Column, words: Sequence[str]) -> Column:
    """How many of the words occur."""
    return reduce(lambda a, b: a + b, [F.contains(lowered, F.lit(w)).cast("int") for w in words])


def first_match(lowered: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Label of the first rule with any word in the text."""
    out = None
    for label, words in rules:
        test = has_any(lowered, words)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(default))


def labels_present(lowered: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Array of the labels whose words occur, in rule order."""
    return F.array_compact(
        F.array(*[F.when(has_any(lowered, words), F.lit(label)) for label, words in rules])
    )
