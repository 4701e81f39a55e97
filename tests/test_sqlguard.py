import pytest
from pyspark.sql import functions as F

from tablegauge.operators import sqlguard as G


@pytest.fixture(scope="module")
def data(spark):
    return spark.range(1200).select(F.col("id"), (F.col("id") % 4).alias("event_type"))


def test_cap_and_flag(spark, data):
    out = G.run_select(spark, "SELECT id FROM data", {"data": data})
    got = out.frame.collect()
    assert len(got) == 500 and all(r["truncated"] for r in got)
    small = G.run_select(spark, "SELECT event_type, count(*) AS n FROM data GROUP BY event_type", {"data": data}).frame.collect()
    assert len(small) == 4 and not any(r["truncated"] for r in small)


@pytest.mark.parametrize("sql,status", [
    ("DELETE FROM data", "blocked"),
    ("select 'please drop it' from data", "blocked"),
    ("", "blocked"),
    ("SHOW TABLES", "blocked"),
    ("SET spark.x=1", "blocked"),
    ("ADD JAR '/tmp/x.jar'", "blocked"),
    ("CACHE TABLE data", "blocked"),
    ("SELECT java_method('java.lang.System', 'exit', 1)", "blocked"),
    ("SELECT reflect('java.util.UUID', 'randomUUID')", "blocked"),
    ("SELECT TRANSFORM(id) USING 'cat' AS (x) FROM data", "blocked"),
    ("SELECT * FROM (SELECT TRANSFORM(id) USING 'cat' AS (x) FROM data)", "blocked"),
    ("SELECT * FROM csv.`/etc/passwd`", "error"),
    ("SELECT 1; SELECT 2", "error"),
    ("SELECT nope FROM data", "error"),
    ("SELECT created_at FROM (SELECT id AS created_at FROM data) LIMIT 3", "success"),
    ("WITH x AS (SELECT id FROM data) SELECT count(*) AS n FROM x", "success"),
    ("SELECT id FROM data UNION SELECT 1", "success"),
    ("SELECT a.id FROM data a JOIN data b ON a.id = b.id", "success"),
])
def test_guard(spark, data, sql, status):
    assert G.run_select(spark, sql, {"data": data}).status == status


@pytest.mark.parametrize("sql,safe,reason,warnings", [
    ("DELETE FROM events", False, "DELETE", []),
    ("SELECT * FROM events LIMIT 10", True, None, ["select_star", "no_where", "no_date"]),
    ("SELECT created_at, user_id FROM events LIMIT 100", True, None, ["no_where"]),
    ("SELECT a FROM t UNION SELECT b FROM t", False, "statement:SetOperation", []),
    ("SELECT a FROM (SELECT a FROM x UNION SELECT a FROM y) WHERE day = 1 LIMIT 1", True, None, []),
    ("   ", False, "empty", []),
    (None, False, "empty", []),
    ("SELECT 'it; is; UNION' AS x FROM t WHERE year = 1 LIMIT 1", True, None, []),
    ("-- note\nSELECT a FROM t /* x; y */ WHERE year = 1 LIMIT 1", True, None, []),
    ("EXPLAIN SELECT 1", False, "statement:Other", []),
])
def test_audit(spark, sql, safe, reason, warnings):
    got = G.audit_sql_log(spark.createDataFrame([(sql,)], "q string"), "q").first()
    assert (got["is_safe"], got["blocked_reason"], got["warnings"]) == (safe, reason, warnings)


def test_basic_rules_are_shorter(spark):
    df = spark.createDataFrame([("SELECT a FROM t -- grant",)], "q string")
    assert G.audit_sql_log(df, "q", "strict").first()["blocked_reason"] == "GRANT"
    got = G.audit_sql_log(df, "q", "basic").first()
    assert got["is_safe"] and got["warnings"] == ["no_limit", "no_date"]


@pytest.mark.parametrize("sql", [
    "SELECT '--' AS a\nFROM t UNION SELECT 'x', 2", 'SELECT "a (" FROM t UNION SELECT ")" FROM t',
    "SELECT `(` FROM t /* ' */ UNION SELECT 1 -- '", "SELECT a FROM t" + " WHERE (a IN (1" * 12 + "))" * 12 + " UNION SELECT 1",
])
def test_hidden_set_operations_are_found(spark, sql):
    got = G.audit_sql_log(spark.createDataFrame([(sql,)], "q string"), "q", "basic").first()
    assert not got["is_safe"] and got["blocked_reason"] == "statement:SetOperation"


def test_set_operations_inside_any_depth_do_not_count(spark):
    sql = "SELECT a FROM " + "(" * 15 + "SELECT a FROM x UNION SELECT a FROM y" + ")" * 15
    assert G.add_statement_kind(spark.createDataFrame([(sql,)], "q string"), "q").first()["statement"] == "Select"


def test_other_views_of_the_session_are_refused(spark, data):
    spark.range(3).createOrReplaceTempView("secret")
    for sql in ("SELECT * FROM secret", "SELECT id FROM data WHERE id IN (SELECT id FROM secret)",
                "WITH x AS (SELECT * FROM secret) SELECT * FROM x", "SELECT 'with secret as (' FROM secret",
                "SELECT * FROM data d JOIN SECRET s ON d.id = s.id"):
        assert G.run_select(spark, sql, {"data": data}).status == "blocked", sql
    assert G.run_select(spark, "WITH a AS (SELECT 1 AS x), b (y) AS (SELECT x FROM a) SELECT y FROM b", {}).status == "success"
    assert G.run_select(spark, "SELECT id FROM data", {"data": data}, cap=None).frame.count() == 1200


LEAKS = [
    "SELECT id, row_number() OVER w AS n FROM secret WINDOW w AS (ORDER BY id), secret AS (ORDER BY id DESC)",
    "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
    "WITH secret (id) AS (SELECT id FROM secret) SELECT * FROM secret",
    "WITH a AS (SELECT * FROM secret), secret AS (SELECT 1 AS id) SELECT * FROM a",
    "SELECT * FROM (WITH secret AS (SELECT 1 AS id) SELECT * FROM secret) x JOIN secret s ON x.id = s.id",
    "WITH a AS (WITH secret AS (SELECT 1 AS id) SELECT * FROM secret) SELECT * FROM a, secret",
    "SELECT id FROM data WHERE EXISTS (SELECT 1 FROM secret s WHERE s.id = data.id)",
    "SELECT (SELECT max(id) FROM secret) AS x FROM data",
    "SELECT id FROM data ORDER BY (SELECT max(id) FROM secret)",
    "SELECT id FROM data GROUP BY id HAVING count(*) > (SELECT max(id) FROM secret)",
    "SELECT d.id FROM data d JOIN data e ON d.id = e.id AND e.id IN (SELECT id FROM secret)",
    "SELECT * FROM data, LATERAL (SELECT * FROM secret)",
    "SELECT CASE WHEN id IN (SELECT id FROM secret) THEN 1 END FROM data",
    "SELECT * FROM VALUES ((SELECT max(id) FROM secret)) AS t(x)",
    "SELECT id FROM data LIMIT (SELECT 1 FROM secret)",
    "SELECT * FROM data PIVOT (sum(id) FOR event_type IN (0, 1)) UNION ALL SELECT 1, id FROM secret",
    "TABLE secret",
    "FROM secret SELECT id",
    "SELECT * FROM IDENTIFIER('secret')",
    "SELECT * FROM IDENTIFIER('sec' || 'ret')",
    "SELECT sum(id) OVER (ORDER BY (SELECT max(id) FROM secret)) FROM data",
    "WITH RECURSIVE r AS (SELECT 1 AS id UNION ALL SELECT r.id + 1 FROM r JOIN secret s ON s.id = r.id) SELECT * FROM r",
    "SELECT transform(array(1), x -> x + (SELECT max(id) FROM secret)) FROM data",
    "FROM data |> JOIN secret USING (id)",
]


@pytest.mark.parametrize("sql", LEAKS)
def test_names_outside_the_scope_are_refused(spark, data, sql):
    spark.range(3).createOrReplaceTempView("secret")
    out = G.run_select(spark, sql, {"data": data})
    assert out.frame is None and out.status in ("blocked", "error"), sql
    assert "secret" in out.reason or "not allowed" in out.reason or out.status == "error", out.reason


@pytest.mark.parametrize("sql,rows", [
    ("WITH secret AS (SELECT id FROM data) SELECT count(*) AS n FROM secret", 1),
    ("WITH a AS (SELECT 1 AS id), b AS (SELECT id + 1 AS id FROM a) SELECT * FROM a UNION ALL SELECT * FROM b", 2),
    ("WITH a AS (WITH b AS (SELECT 1 AS x) SELECT x FROM b) SELECT x FROM a", 1),
    ("WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT n FROM r", 5),
    ("WITH RECURSIVE r (n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3), s AS (SELECT n FROM r) SELECT n FROM s", 3),
    ("SELECT id, row_number() OVER w AS n FROM data WINDOW w AS (PARTITION BY event_type ORDER BY id) LIMIT 7", 7),
    ("SELECT id FROM DATA WHERE id IN (SELECT max(id) FROM Data)", 1),
    ("SELECT d.id, x FROM data d LATERAL VIEW explode(array(1, 2)) t AS x WHERE d.id = 0", 2),
    ("SELECT t.* FROM data d, LATERAL (SELECT d.id + 1 AS y) t WHERE d.id = 3", 1),
    ("SELECT id FROM range(4)", 4),
    ("SELECT * FROM VALUES (1), (2) AS t(x)", 2),
    ("SELECT event_type, count(*) AS n FROM data GROUP BY ROLLUP (event_type) HAVING count(*) > 0", 5),
    ("SELECT * FROM (SELECT event_type, id FROM data) PIVOT (count(id) FOR event_type IN (0, 1))", 1),
    ("FROM data |> WHERE id < 2 |> SELECT id", 2),
    ("SELECT id FROM data TABLESAMPLE (3 ROWS)", 3),
    ("SELECT DISTINCT event_type FROM data ORDER BY 1 OFFSET 1", 3),
])
def test_legal_statements_still_run(spark, data, sql, rows):
    out = G.run_select(spark, sql, {"data": data}, cap=None)
    assert out.status == "success", out.reason
    assert out.frame.count() == rows


def test_relations_read(spark):
    assert G.relations_read(spark, "WITH a AS (SELECT * FROM t) SELECT * FROM a JOIN b.c ON true") == [("t",), ("b", "c")]
    with pytest.raises(G.Refused):
        G.relations_read(spark, "SELECT * FROM my_table_function(1)")
