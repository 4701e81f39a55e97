"""Jobs over tables of texts: requests, conversations, reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.functions import fixed_values as V
from tablegauge.functions.math import micros, ratio
from tablegauge.functions.text import has_any, hits, labels_present
from tablegauge.plans.joins import join_null_safe
from tablegauge.plans.ordered import running_totals


def classify_requests(df: DataFrame, text: str) -> DataFrame:
    """Add intent, matched (categories in list order), keyword_hits and route."""
    lowered = F.lower(text)
    out = df.withColumn("matched", labels_present(lowered, V.INTENTS))
    total = sum([hits(lowered, words) for _, words in V.INTENTS], F.lit(0))
    intent = (
        F.when(F.size("matched") == 0, "analytics").when(F.size("matched") == 1, F.element_at("matched", 1)).otherwise("mixed")
    )
    route = F.create_map(*[F.lit(x) for pair in V.INTENT_ROUTES.items() for x in pair])
    return out.withColumns({"keyword_hits": total, "intent": intent}).withColumn("route", route[F.col("intent")])


def intent_counts(df: DataFrame, text: str) -> DataFrame:
    return classify_requests(df, text).groupBy("intent", "route").agg(F.count(F.lit(1)).alias("n"))


def plan_flags(df: DataFrame, text: str) -> DataFrame:
    """Add needs_analyst, needs_scientist, steps and step_count. The analyst is the default."""
    lowered = F.lower(text)
    science = has_any(lowered, V.SCIENTIST_WORDS)
    analyst = has_any(lowered, V.ANALYST_WORDS) | ~science
    listed = lambda steps: F.array(*[F.lit(s) for s in steps])
    some = lambda test, steps: F.when(test, listed(steps)).otherwise(F.array().cast("array<string>"))
    steps = F.concat(
        listed(V.PLAN_STEPS_BEFORE),
        some(analyst, V.PLAN_STEPS_ANALYST),
        some(analyst & has_any(lowered, V.SQL_STEP_WORDS), V.PLAN_STEPS_SQL),
        some(science, V.PLAN_STEPS_SCIENTIST),
        listed(V.PLAN_STEPS_AFTER),
    )
    out = df.withColumns({"needs_analyst": analyst, "needs_scientist": science, "steps": steps})
    return out.withColumn("step_count", F.size("steps"))


def speaker(role: Column) -> Column:
    """Every role but user speaks as the assistant."""
    return F.when(role == "user", "USER").otherwise("ASSISTANT")


def _stripped(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def conversation_lines(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The non-empty lines of each conversation written as `SPEAKER: text`."""
    message = F.concat(speaker(F.col(role)), F.lit(": "), F.coalesce(F.col(text), F.lit("")))
    lines = df.select(conv, turn, F.posexplode(F.split(message, "\n")).alias("_pos", "_raw"))
    return lines.select(conv, turn, "_pos", _stripped(F.col("_raw")).alias("line")).filter(F.col("line") != "")


def conversation_digest(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Per conversation: message_count (lines), last_user, condensed and topics.

    Only the first and last lines are gathered. The rank filters are applied before
    the shuffle as well, so a very long conversation is cut down where it is read.
    """
    lines = conversation_lines(df, conv, turn, role, text)
    lowered = F.lower("line")
    at = F.struct(F.col(turn), F.col("_pos"))
    is_user = F.startswith(F.upper("line"), F.lit("USER:"))
    facts = lines.groupBy(conv).agg(
        F.count(F.lit(1)).alias("message_count"),
        F.max_by("line", F.when(is_user, at)).alias("_last"),
        *[F.max(has_any(lowered, words)).alias(f"_topic_{name}") for name, words in V.TOPICS],
    )
    edge = V.DIGEST_EDGE_LINES
    first = Window.partitionBy(conv).orderBy(F.col(turn).asc(), F.col("_pos").asc())
    last = Window.partitionBy(conv).orderBy(F.col(turn).desc(), F.col("_pos").desc())
    # later characters of a line cannot reach the condensed text
    short = F.substring("line", 1, V.DIGEST_CHARS).alias("line")
    pick = lambda w: (
        lines.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= edge).select(conv, turn, "_pos", short)
    )
    edges = pick(first).unionByName(pick(last)).distinct()
    parts = edges.groupBy(conv).agg(
        F.sort_array(F.collect_list(F.struct(turn, "_pos", "line"))).alias("_lines")
    )
    texts = F.transform("_lines", lambda s: s["line"])
    context = F.when(
        F.col("message_count") > 2 * edge,
        F.concat(F.slice(texts, 1, edge), F.array(F.lit(V.EARLIER_MARK)), F.slice(texts, edge + 1, edge)),
    ).otherwise(texts)
    topics = F.array_compact(F.array(*[F.when(F.col(f"_topic_{n}"), F.lit(n)) for n, _ in V.TOPICS]))
    last_user = F.substring(_stripped(F.replace(F.col("_last"), F.lit("USER:"), F.lit(""))), 1, V.LAST_USER_CHARS)
    return facts.join(parts, conv).select(
        conv,
        "message_count",
        last_user.alias("last_user"),
        F.substring(F.array_join(context, " | "), 1, V.DIGEST_CHARS).alias("condensed"),
        topics.alias("topics"),
    )


def recent_history(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, history): the last 6 messages as `SPEAKER: text` lines of at most 300 characters of text."""
    newest = Window.partitionBy(conv).orderBy(F.col(turn).desc())
    line = F.concat(speaker(F.col(role)), F.lit(": "), F.substring(F.col(text), 1, V.HISTORY_CHARS))
    recent = (
        df.withColumn("_r", F.row_number().over(newest))
        .filter(F.col("_r") <= V.HISTORY_MESSAGES)
        .select(conv, turn, line.alias("line"))
    )
    listed = recent.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct(turn, "line"))).alias("_l"))
    return listed.select(conv, F.array_join(F.transform("_l", lambda s: s["line"]), "\n").alias("history"))


def usage_columns(chars: Column, window: int = V.CONTEXT_WINDOW) -> dict[str, Column]:
    tokens = F.when(chars == 0, F.lit(0)).otherwise(
        F.greatest(F.floor(chars / V.CHARS_PER_TOKEN), F.lit(1))
    ).cast("long")
    percent = F.round(ratio(tokens, F.lit(window)) * 100, 2)
    band = None
    for limit, name in V.USAGE_BANDS:
        band = F.when(percent < limit, name) if band is None else band.when(percent < limit, name)
    return {"tokens": tokens, "usage_percent": percent, "band": band.otherwise(V.USAGE_TOP_BAND)}


def context_usage(df: DataFrame, text: str, window: int = V.CONTEXT_WINDOW, by: Sequence[str] = ()) -> DataFrame:
    """Tokens (4 characters each), percent of the window and a band, per row or summed over `by`."""
    chars = F.coalesce(F.length(text), F.lit(0))
    if by:
        df = df.groupBy(*by).agg(F.sum(chars).alias("chars"))
    else:
        df = df.withColumn("chars", chars.cast("long"))
    return df.withColumns(usage_columns(F.col("chars"), window))


def section_completeness(df: DataFrame, text: str) -> DataFrame:
    """Add present, score_percent, missing, is_complete. A title may be joined by _ or -."""
    lowered = F.lower(text)

    def found(title: str) -> Column:
        t = title.lower()
        return has_any(lowered, [t, t.replace(" ", "_"), t.replace(" ", "-")])

    missing = F.array_compact(F.array(*[F.when(~found(t), F.lit(t)) for t in V.REPORT_SECTIONS]))
    total = len(V.REPORT_SECTIONS)
    out = df.withColumn("missing", missing)
    present = total - F.size("missing")
    return out.withColumns(
        {
            "present": present,
            "score_percent": F.round(present / total * 100, 1),
            "is_complete": F.size("missing") == 0,
        }
    )


def activity_metrics(df: DataFrame, scope: str, ts: str, actor: str, is_call: Column) -> DataFrame:
    """(scope, calls, actors, place, actor): calls of the scope and its actors in first-seen order.

    Events are first counted per scope and actor; the places are running totals per
    scope and minute, so a scope with very many actors is not one task.
    """
    per = df.groupBy(scope, actor).agg(
        F.min(micros(F.col(ts))).alias("_first"), F.count_if(is_call).alias("_calls")
    )
    whole = per.groupBy(scope).agg(F.sum("_calls").alias("calls"), F.count(F.lit(1)).alias("actors"))
    placed = running_totals(
        per.withColumn("_one", F.lit(1).cast("long")),
        [scope],
        [F.floor(F.col("_first") / 60_000_000)],
        [F.col("_first"), F.col(actor)],
        ["_one"],
    )
    return join_null_safe(placed, whole, [scope]).select(
        scope, "calls", "actors", F.col("_one_upto").alias("place"), actor
    )


def report_table(parts: dict[str, DataFrame]) -> DataFrame:
    """One long table (section, item, metric, value) from one (item, metric, value) table per section."""
    rows = [
        df.select(
            F.lit(section).alias("section"),
            F.col("item").cast("string").alias("item"),
            F.col("metric").cast("string").alias("metric"),
            F.col("value").cast("double").alias("value"),
        )
        for section, df in parts.items()
    ]
    return reduce(DataFrame.unionByName, rows)
