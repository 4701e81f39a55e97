"""Sources and sinks (A1-A5)."""

from pyspark.sql import functions as F

from tablegauge.session import new_folder
from tablegauge.sources import tables as io
from tablegauge.sources.schema import columns_table
from tablegauge.workload.registry import plain, query

NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


@query(
    "a1_read_table",
    " UNION ALL ".join(f"SELECT '{n}' AS dataset, count(*) AS n_rows FROM {n}" for n in NAMES),
)
def _(t):
    parts = None
    for n in NAMES:
        df = io.read_table(t.spark, f"{n}.parquet", t.folder, "parquet")
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("dataset"), "n_rows")
        parts = one if parts is None else parts.unionByName(one)
    return parts


@query(
    "a1_read_csv",
    """SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 THEN round(CAST(c_acctbal AS DOUBLE), 4) END AS balance,
 CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment, c_custkey % 2 = 0 AS even, 'int,double,string,boolean' AS types FROM customer""",
)
def _(t):
    key = F.col("c_custkey")
    cells = t.customer.select(
        key, F.when(key % 7 == 0, "NA").when(key % 11 == 0, "N/A").otherwise(F.col("c_acctbal").cast("string")).alias("balance"),
        F.when(key % 5 == 0, "null").otherwise(F.col("c_mktsegment")).alias("segment"), (key % 2 == 0).alias("even"))
    folder = new_folder(t.spark, "csv")
    io.write_result(cells, f"{folder}/customers.csv", "csv")
    back = io.read_table(t.spark, "customers.csv", folder)
    return plain(back.withColumn("types", F.lit(",".join(kind for _, kind in back.dtypes))))


# texts with line ends, quotes and commas, written as CSV and read back
@query(
    "a1_read_csv_quoted",
    """SELECT doc_id, CASE WHEN text NOT IN ('', 'NA', 'null') THEN sha256(text) END AS text_sha256, lang, CAST(n_chars AS BIGINT) AS n_chars
FROM (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN chr(10) || '"quoted, ""twice""' WHEN 1 THEN ',' WHEN 2 THEN chr(13) || chr(10) || ' end ' ELSE '' END AS text, lang, n_chars FROM documents)""",
)
def _(t):
    more = F.when(F.col("doc_id") % 4 == 0, '\n"quoted, ""twice""').when(F.col("doc_id") % 4 == 1, ",").when(F.col("doc_id") % 4 == 2, "\r\n end ").otherwise("")
    folder = new_folder(t.spark, "csv")
    io.write_result(t.documents.select("doc_id", F.concat("text", more).alias("text"), "lang", "n_chars"), f"{folder}/documents.csv", "csv")
    back = io.read_table(t.spark, "documents.csv", folder)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2("text", 256).alias("text_sha256"), "lang", F.col("n_chars").cast("long").alias("n_chars"))


# lines with a cell too few or too many, and some with quoted commas, which are even
UNEVEN_SQL = """lines AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 2 WHEN c_custkey % 17 = 0 THEN 4 ELSE 3 END AS cells FROM customer)"""


def uneven_file(t) -> str:
    key = F.col("c_custkey")
    line = (
        F.when(key % 13 == 0, F.concat_ws(",", key, "c_mktsegment"))
        .when(key % 17 == 0, F.concat_ws(",", key, "c_mktsegment", F.col("c_acctbal").cast("string"), F.lit("extra")))
        .when(key % 5 == 0, F.concat(key.cast("string"), F.lit(',"'), F.col("c_mktsegment"), F.lit(', ""so""",'), F.col("c_acctbal").cast("string")))
        .otherwise(F.concat_ws(",", key, "c_mktsegment", F.col("c_acctbal").cast("string")))
    )
    folder = new_folder(t.spark, "csv")
    # every file of a table has a header of its own
    head = t.spark.range(1).select(F.lit(0).alias("place"), F.lit("id,segment,balance").alias("value"))
    rows = head.unionByName(t.customer.select(F.lit(1).alias("place"), line.alias("value")))
    rows.repartition(1).sortWithinPartitions("place").select("value").write.text(f"{folder}/customers.csv")
    return folder


@query(
    "a1_record_account",
    f"""WITH {UNEVEN_SQL} SELECT count(*) AS records, count(*) FILTER (cells = 3) AS even, count(*) FILTER (cells < 3) AS short, count(*) FILTER (cells > 3) AS long FROM lines""",
)
def _(t):
    return io.record_account(t.spark, "customers.csv", uneven_file(t))


@query(
    "a1_uneven_records",
    f"WITH {UNEVEN_SQL} SELECT c_custkey AS id, CAST(cells AS BIGINT) AS cells, CAST(3 AS BIGINT) AS expected FROM lines WHERE cells <> 3",
)
def _(t):
    found = io.uneven_records(t.spark, "customers.csv", uneven_file(t))
    return found.select(F.split("record", ",")[0].cast("long").alias("id"), "cells", "expected")


@query(
    "a2_register_view",
    "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type",
)
def _(t):
    io.register_view(t.events, "data")
    return t.spark.sql(
        "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM data GROUP BY event_type"
    )


# the listing is metadata; the rows of each listed file are counted next to it
@query(
    "a3_list_datasets",
    " UNION ALL ".join(f"SELECT '{n}.parquet' AS dataset, true AS has_bytes, count(*) AS n_rows FROM {n}" for n in NAMES),
)
def _(t):
    listed = io.list_datasets(t.spark, t.folder, "*.parquet")
    counts = None
    for n in NAMES:
        one = getattr(t, n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(f"{n}.parquet").alias("dataset"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts.join(F.broadcast(listed), "dataset").select("dataset", (F.col("bytes") > 0).alias("has_bytes"), "n_rows")


# the columns table itself is schema-only; the row count of each table is joined to it
@query(
    "a4_columns_table",
    """
WITH counts AS ("""
    + " UNION ALL ".join(f"SELECT '{n}' AS dataset, count(*) AS n_rows FROM {n}" for n in NAMES)
    + """)
SELECT c.table_name AS dataset, CAST(c.ordinal_position - 1 AS BIGINT) AS ordinal, c.column_name AS "column",
  CASE WHEN c.data_type IN ('BIGINT','INTEGER','DOUBLE') THEN 'numeric'
       WHEN c.data_type = 'VARCHAR' THEN 'string'
       WHEN c.data_type LIKE 'TIMESTAMP%' THEN 'temporal' ELSE 'other' END AS kind,
  n.n_rows
FROM (SELECT DISTINCT table_name, ordinal_position, column_name, data_type FROM information_schema.columns) c
JOIN counts n ON n.dataset = c.table_name""",
)
def _(t):
    tables = {n: getattr(t, n) for n in NAMES}
    counts = None
    for n, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("dataset"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    meta = columns_table(t.spark, tables).drop("dtype")
    return plain(counts.join(F.broadcast(meta), "dataset"))


@query(
    "a5_write_result",
    "SELECT o_orderstatus AS status, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1",
)
def _(t):
    result = t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue")
    )
    path = io.write_result(result, new_folder(t.spark, "export"), "csv")
    return t.spark.read.option("header", True).schema(result.schema).csv(path)
