"""Read-only SQL over named tables, and bulk linting of a table of SQL texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablegauge.functions import fixed_values as V
from tablegauge.functions.text import has_any

# kinds of plan nodes that only read; a statement with any other kind in it is refused
READ_NODES = frozenset(
    (
        "Project", "GlobalLimit", "LocalLimit", "Distinct", "Sort", "Aggregate", "Filter", "UnresolvedWith",
        "LocalRelation", "Union", "Intersect", "Except", "SubqueryAlias", "WithWindowDefinition", "Offset",
        "UnresolvedHaving", "Pivot", "UnresolvedPivot", "Unpivot", "UnresolvedInlineTable", "OneRowRelation",
        "UnresolvedSubqueryColumnAliases", "UnresolvedHint", "Sample", "UnresolvedRelation", "Join", "AsOfJoin",
        "LateralJoin", "Generate", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "Window", "Tail", "PipeOperator",
    )
)
# functions that run outside code, and table functions that are part of the language
REFUSED_FUNCTIONS = ("java_method", "reflect", "try_reflect")
TABLE_FUNCTIONS = (
    "range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack",
    "json_tuple", "variant_explode", "variant_explode_outer",
)
# what hides text from the statement, whichever starts first: literals, quoted names, comments
HIDDEN = "'[^']*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\\*(?:[^*]|\\*(?!/))*+\\*/"
# set operations of the text that is left, and parentheses
SET_WORDS = r"\b(?:UNION|INTERSECT|EXCEPT)\b"
MARKS = r"[()]|" + SET_WORDS


@dataclass
class Selected:
    """Outcome of a guarded statement; `frame` is None unless status is success."""

    status: str
    reason: str | None
    frame: DataFrame | None


def blocked_keyword(sql: Column, rules: str = "strict") -> Column:
    """First keyword of the list that occurs as a whole word anywhere in the text."""
    words = {"strict": V.BLOCKED_STRICT, "basic": V.BLOCKED_BASIC}[rules]
    found = [F.when(sql.rlike(rf"(?i)\b{w}\b"), F.lit(w)) for w in words]
    # one test for all words first: safe texts, the usual case, are scanned once
    return F.when(sql.rlike(rf"(?i)\b({'|'.join(words)})\b"), F.coalesce(*found))


class Refused(Exception):
    """A statement that must not run: status and reason."""

    def __init__(self, status: str, reason: str):
        super().__init__(reason)
        self.status = status


class _Reader:
    """Walks a parsed statement and yields the relations that it reads from outside.

    Every part of a node is visited, whatever field holds it: children, subqueries of
    expressions, window definitions, join conditions. A name counts as the statement's own
    only where a WITH that defines it is in scope.
    """

    def __init__(self, spark: SparkSession):
        jvm = spark.sparkContext._jvm
        load = spark._jsparkSession.getClass().getClassLoader().loadClass
        catalyst = "org.apache.spark.sql.catalyst."
        self.plan, self.expression = load(catalyst + "plans.logical.LogicalPlan"), load(catalyst + "expressions.Expression")
        self.holder, self.product = load("scala.collection.Iterable"), load("scala.Product")
        self.converters = jvm.scala.jdk.javaapi.CollectionConverters

    def relations(self, part, own: frozenset[str] = frozenset()) -> Iterator[tuple[str, ...]]:
        if not hasattr(part, "getClass"):  # text and numbers
            return
        if self.holder.isInstance(part):
            for each in self.converters.asJava(part):
                yield from self.relations(each, own)
        elif self.plan.isInstance(part):
            yield from self._of_plan(part, own)
        elif self.product.isInstance(part):
            if self.expression.isInstance(part):
                self._check_expression(part)
            yield from self._parts(part, own)

    def _parts(self, part, own: frozenset[str]) -> Iterator[tuple[str, ...]]:
        for i in range(part.productArity()):
            yield from self.relations(part.productElement(i), own)

    def _of_plan(self, plan, own: frozenset[str]) -> Iterator[tuple[str, ...]]:
        kind = plan.getClass().getSimpleName()
        if kind not in READ_NODES:
            raise Refused("blocked", f"{kind} is not allowed: it does not only read")
        if kind == "UnresolvedWith":
            # a definition sees those before it, and itself if the WITH is recursive
            for definition in self.converters.asJava(plan.cteRelations()):
                name = definition._1().lower()
                yield from self.relations(definition._2(), own | {name} if plan.allowRecursion() else own)
                own = own | {name}
            yield from self.relations(plan.child(), own)
            return
        if kind == "UnresolvedRelation":
            name = tuple(self.converters.asJava(plan.multipartIdentifier()))
            if len(name) > 1 or name[0].lower() not in own:
                yield name
        elif kind == "UnresolvedTableValuedFunction":
            name = ".".join(self.converters.asJava(plan.name()))
            if name.lower() not in TABLE_FUNCTIONS:
                raise Refused("blocked", f"table function {name} is not allowed")
        yield from self._parts(plan, own)

    def _check_expression(self, expression) -> None:
        kind = expression.getClass().getSimpleName()
        if "UnresolvedIdentifier" in kind:  # names that are computed
            raise Refused("blocked", "IDENTIFIER is not allowed")
        if kind == "UnresolvedFunction" and list(self.converters.asJava(expression.nameParts()))[-1].lower() in REFUSED_FUNCTIONS:
            raise Refused("blocked", "calls into the JVM are not allowed")


def relations_read(spark: SparkSession, sql: str) -> list[tuple[str, ...]]:
    """The names, in parts, of what one statement reads, other than what its own WITH defines.

    Raises Refused if the statement does anything but read.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Refused("error", str(e).split("\n")[0]) from e
    return list(dict.fromkeys(_Reader(spark).relations(plan)))


def _refusal(spark: SparkSession, sql: str, tables) -> tuple[str, str] | None:
    """(status, reason) if the statement must not run; it may read the names in `tables` only."""
    if not sql or not sql.strip():
        return "blocked", "empty query"
    for word in V.BLOCKED_STRICT:
        if re.search(rf"\b{word}\b", sql, re.IGNORECASE):
            return "blocked", word
    try:
        read = relations_read(spark, sql)
    except Refused as e:
        return e.status, str(e)
    given = {t.lower() for t in tables}
    for name in read:
        if len(name) > 1 or name[0].lower() not in given:
            return "error" if len(name) > 1 else "blocked", f"{'.'.join(name)} is not among the given tables"
    return None


def guarded_select(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> Selected:
    """Check one statement and plan it over the given tables. Nothing runs yet."""
    refused = _refusal(spark, sql, tables)
    if refused:
        return Selected(refused[0], refused[1], None)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    option = "spark.sql.runSQLOnFiles"
    before = spark.conf.get(option)
    spark.conf.set(option, "false")
    try:
        return Selected("success", None, spark.sql(sql))
    except Exception as e:
        return Selected("error", str(e).split("\n")[0], None)
    finally:
        spark.conf.set(option, before)


def run_select(spark: SparkSession, sql: str, tables: dict[str, DataFrame], cap: int | None = V.ROW_CAP) -> Selected:
    """At most `cap` rows of the statement with a `truncated` column; all rows if cap is None.

    The limit is part of the plan, so the full result is never produced; one row
    above the cap tells whether something was cut.
    """
    out = guarded_select(spark, sql, tables)
    if out.frame is None:
        return out
    if cap is None:
        return Selected(out.status, None, out.frame.withColumn("truncated", F.lit(False)))
    some = out.frame.limit(cap + 1)
    counted = some.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > cap)
    return Selected(out.status, None, counted.limit(cap))


def _bare(sql: Column) -> Column:
    """Upper-cased text without comments, literals and quoted names."""
    return F.regexp_replace(F.upper(sql), HIDDEN, " ")


def _joins_sets(bare: Column) -> Column:
    """Whether a set operation stands outside all parentheses, however deep these are nested."""
    marks = F.regexp_extract_all(bare, F.lit(MARKS), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("found"))
    return F.aggregate(marks, start, lambda s, m: F.struct(
        (s["depth"] + F.when(m == "(", 1).when(m == ")", -1).otherwise(0)).alias("depth"),
        (s["found"] | (~m.isin("(", ")") & (s["depth"] <= 0))).alias("found"),
    ))["found"]


def _kind_of(sql: Column, bare: Column) -> Column:
    # a statement start, first or after a semicolon, that is neither SELECT nor WITH
    other = bare.rlike(r"(^|;)\s*(?!(?:SELECT|WITH)\b)[^\s;]") | ~bare.rlike(r"[^\s;]")
    return (
        F.when(sql.isNull() | (F.trim(sql) == ""), "Empty")
        .when(other, "Other")
        .when(bare.rlike(SET_WORDS) & _joins_sets(bare), "SetOperation")  # parentheses are only followed where it matters
        .otherwise("Select")
    )


def add_statement_kind(log: DataFrame, sql: str, name: str = "statement") -> DataFrame:
    """Add the class of each text: Select, SetOperation, Other or Empty.

    Decided by the leading word of each statement; set operations inside parentheses
    do not count. For running a statement the real parser decides; this form is for
    large logs. The stripped text is a column of its own, so it is made once per row.
    """
    staged = log.withColumn("_bare", _bare(F.col(sql)))
    return staged.withColumn(name, _kind_of(F.col(sql), F.col("_bare"))).drop("_bare")


def audit_sql_log(log: DataFrame, sql: str, rules: str = "strict") -> DataFrame:
    """Lint every SQL text: is_safe, blocked_reason, statement, warnings.

    `strict` and `basic` differ in the keyword list; only strict warns about a
    missing WHERE and about many nested SELECTs.
    """
    text = F.col(sql)
    staged = log.withColumn("_word", blocked_keyword(text, rules))
    # the statement class is only needed where no keyword already decides
    open_text = F.when(F.col("_word").isNull(), text)
    staged = staged.withColumn("_bare", _bare(open_text))
    staged = staged.withColumn(
        "statement", F.when(F.col("_word").isNull(), _kind_of(text, F.col("_bare")))
    )
    reason = (
        F.when(F.col("statement") == "Empty", "empty")
        .when(F.col("_word").isNotNull(), F.col("_word"))
        .when(F.col("statement") != "Select", F.concat(F.lit("statement:"), F.col("statement")))
    )
    upper, lower = F.col("_upper"), F.col("_lower")
    selects = F.length(F.regexp_replace(upper, "SELECT", "SELECT+")) - F.length(upper)
    warn = lambda test, name: F.when(test, F.lit(name))
    found = [
        warn(upper.rlike(r"\bSELECT\s+\*"), "select_star"),
        warn(~upper.rlike(r"\bLIMIT\b"), "no_limit"),
    ]
    if rules == "strict":
        found.append(warn(~upper.rlike(r"\bWHERE\b"), "no_where"))
    found.append(warn(~has_any(lower, V.SQL_DATE_WORDS), "no_date"))
    if rules == "strict":
        found.append(warn(selects > V.MAX_SELECTS, "complex"))
    # texts that are blocked get no warnings, so they need no further tests
    safe = F.when(reason.isNull(), text)
    staged = staged.withColumns({"blocked_reason": reason, "_upper": F.upper(safe), "_lower": F.lower(safe)})
    nothing = F.array().cast("array<string>")
    return staged.select(
        *log.columns,
        F.col("blocked_reason").isNull().alias("is_safe"),
        "blocked_reason",
        "statement",
        F.when(F.col("blocked_reason").isNull(), F.array_compact(F.array(*found))).otherwise(nothing).alias("warnings"),
    )


def warning_summary(audited: DataFrame) -> DataFrame:
    """(kind, item, n): how often each warning and each blocked reason occurs in an audited log."""
    rows = audited.select(
        F.explode(
            F.concat(
                F.transform("warnings", lambda w: F.struct(F.lit("warning").alias("kind"), w.alias("item"))),
                F.when(
                    F.col("blocked_reason").isNotNull(),
                    F.array(F.struct(F.lit("blocked").alias("kind"), F.col("blocked_reason").alias("item"))),
                ).otherwise(F.array().cast("array<struct<kind:string,item:string>>")),
            )
        ).alias("r")
    )
    return rows.groupBy("r.kind", "r.item").agg(F.count(F.lit(1)).alias("n"))
