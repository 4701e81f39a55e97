"""Reading tables below one base folder, listing them, exposing them to SQL, writing results."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.sources import schema as S

FORMATS = ("csv", "parquet", "json", "orc")
# fixed values: cell texts that mean a missing value
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# text of a record whose number of cells is not the header's
RECORD = "_record"
UNEVEN = ("raise", "keep")
# types tried on the cells of a CSV column, in this order
TYPES = ("int", "bigint", "double", "boolean", "date", "timestamp")


def resolve(base: str, name: str) -> str:
    """Path of `name` below `base`; names that lead out of the folder are refused.

    The store of the base (`s3a://bucket`, `hdfs://host:port`) stays as it is.
    """
    store, root = re.fullmatch(r"([A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?(.*)", base, re.DOTALL).groups()
    root = posixpath.normpath(root or "/")
    path = posixpath.normpath(posixpath.join(root, name))
    if path == root or not path.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{name!r} is outside the data folder")
    return (store or "") + path


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _csv_path(spark: SparkSession, name: str, base: str) -> str:
    if not name.lower().endswith(".csv"):
        raise ValueError(f"{name!r} is not a .csv file")
    return _existing(spark, name, base)


def _existing(spark: SparkSession, name: str, base: str) -> str:
    path = resolve(base, name)
    target, fs = _hadoop_path(spark, path)
    if not fs.exists(target):
        raise FileNotFoundError(f"{name!r} is not in the data folder")
    return path


def column_names(header: Sequence[str | None]) -> list[str]:
    """Names of a header's cells: empty ones by their place, repeated ones numbered."""
    out: list[str] = []
    for i, cell in enumerate(header):
        name = wanted = cell or f"Unnamed: {i}"
        n = 0
        while name in out:
            n += 1
            name = f"{wanted}.{n}"
        out.append(name)
    return out


def _records(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(cells as texts named c0, c1, ..., with RECORD, the names of the columns).

    Cells may hold separators, line ends and doubled quotes inside quotes. A file in which every
    line closes its quotes is split among tasks; only one with quoted line ends has to be read
    whole by one task per file. Lines without text are skipped.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines_close = spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    options = {"quote": '"', "escape": '"', "multiLine": not lines_close, "mode": "PERMISSIVE", "columnPruning": False}
    header = spark.read.options(**options).csv(path).first()
    if header is None:
        raise ValueError(f"{path!r} has no header")
    cells = [f"c{i}" for i in range(len(header))]
    kinds = T.StructType([T.StructField(c, T.StringType()) for c in [*cells, RECORD]])
    found = spark.read.options(**options, header=True, columnNameOfCorruptRecord=RECORD).schema(kinds).csv(path)
    if not lines_close:  # by lines Spark leaves these out itself
        blank = F.coalesce(F.trim("c0"), F.lit("")) == ""
        alone = F.col("c0").isNotNull() if len(cells) == 1 else F.trim(RECORD) == ""
        found = found.where(~F.coalesce(blank & alone, F.lit(False)))
    return found, column_names(header)


def _cells(record: Column) -> Column:
    """How many cells the text of a record has: the separators outside quotes, and one."""
    bare = F.regexp_replace(record, '"[^"]*+"', "")
    return (F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1).cast("long")


# always true; Spark gives the text of a record only together with a cell
_WITH_CELL = "coalesce(length(c0), 0) >= 0"


def uneven_records(spark: SparkSession, name: str, base: str) -> DataFrame:
    """(record, cells, expected) of every record of a CSV file that has not as many cells as its header."""
    found, names = _records(spark, _csv_path(spark, name, base))
    uneven = found.where(_WITH_CELL).where(F.col(RECORD).isNotNull())
    return uneven.select(F.col(RECORD).alias("record"), _cells(F.col(RECORD)).alias("cells"), F.lit(len(names)).cast("long").alias("expected"))


def record_account(spark: SparkSession, name: str, base: str) -> DataFrame:
    """One row: records, and how many are even, short and long beside the header."""
    found, names = _records(spark, _csv_path(spark, name, base))
    cells = F.when(F.col(RECORD).isNotNull(), _cells(F.col(RECORD))).otherwise(len(names))
    return found.where(_WITH_CELL).select(cells.alias("cells")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("cells") == len(names)).alias("even"),
        F.count_if(F.col("cells") < len(names)).alias("short"), F.count_if(F.col("cells") > len(names)).alias("long"),
    )


def _read_csv(spark: SparkSession, path: str, na_values: Sequence[str], schema: T.StructType | None, uneven: str) -> DataFrame:
    found, names = _records(spark, path)
    too_long = F.coalesce(_cells(F.col(RECORD)) > len(names), F.lit(False))
    cells = [c for c in found.columns if c != RECORD]
    texts = [F.when(~F.col(c).isin(*na_values), F.col(c)).alias(c) if na_values else F.col(c) for c in cells]
    message = f"a record has more cells than the {len(names)} of the header"
    if schema is not None:
        if len(schema) != len(names):
            raise ValueError(f"the schema has {len(schema)} columns, the file {len(names)}")
        if uneven == "raise":  # found out while the rows are read, in the same pass
            found = found.where(F.when(too_long, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))
        return found.select(*[t.try_cast(f.dataType).alias(f.name) for t, f in zip(texts, schema)])
    kinds, n_long = _kinds(found.select(*texts, RECORD), cells, F.count_if(too_long))
    if n_long and uneven == "raise":
        raise ValueError(f"{message}: {n_long} records; see uneven_records")
    return found.select(*texts).select(*[F.col(c).cast(k).alias(n) for c, k, n in zip(cells, kinds, names)])


def read_table(
    spark: SparkSession,
    name: str,
    base: str,
    fmt: str = "csv",
    na_values: Sequence[str] | None = None,
    schema=None,
    uneven: str = "raise",
) -> DataFrame:
    """Load one table. CSV has a header; give a schema for large files to skip inference.

    `na_values` are cell texts read as null, MISSING_TEXTS for CSV if not given. They become
    null before the types of a CSV file are inferred, in one pass over its cells.

    CSV cells may be quoted: line ends, separators and doubled quotes inside belong to the cell.
    Records with too few cells are filled with nulls. One with too many raises; `uneven="keep"`
    drops its further cells instead. `record_account` counts both, `uneven_records` gives them.
    Empty names become `Unnamed: 1`, repeated ones `a.1`. A schema names the columns by place.
    Where lines end in carriage return and line feed, line ends inside quotes read as line feeds.
    """
    if na_values is None:
        na_values = MISSING_TEXTS if fmt == "csv" else ()
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if uneven not in UNEVEN:
        raise ValueError(f"uneven must be one of {UNEVEN}")
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if fmt == "csv":
        return _read_csv(spark, _csv_path(spark, name, base), na_values, schema, uneven)
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.format(fmt).load(_existing(spark, name, base))
    if not na_values:
        return df
    texts = set(S.text_columns(df))
    return df.select(*[
        F.when(~F.col(f"`{c}`").isin(*na_values), F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`") for c in df.columns
    ])


def _kinds(df: DataFrame, columns: Sequence[str], extra: Column) -> tuple[list[str], object]:
    """(the first of TYPES that takes all values of each column, `extra` over all rows) in one aggregate.

    Columns without values stay text.
    """

    def refuses(c: str, kind: str):
        if kind == "boolean":  # the words only, though a cast takes y and n as well
            return ~F.lower(F.col(f"`{c}`")).isin("true", "false")
        return F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(kind).isNull()

    refused = [F.count_if(refuses(c, kind)).alias(f"{i}:{kind}") for i, c in enumerate(columns) for kind in TYPES]
    # timestamps and dates are told apart by their text
    timed = [F.count_if(F.col(f"`{c}`").rlike(":")).alias(f"{i}:timed") for i, c in enumerate(columns)]
    known = [F.count(F.col(f"`{c}`")).alias(f"{i}:known") for i, c in enumerate(columns)]
    found = df.agg(*refused, *timed, *known, extra.alias("extra")).first()

    def kind(i: int) -> str:
        for k in TYPES if found[f"{i}:known"] else ():
            if not found[f"{i}:{k}"] and not (k == "date" and found[f"{i}:timed"]):
                return k
        return "string"

    return [kind(i) for i in range(len(columns))], found["extra"]


def register_view(df: DataFrame, name: str = "data") -> DataFrame:
    """Expose the table to SQL under `name`."""
    df.createOrReplaceTempView(name)
    return df


def list_datasets(spark: SparkSession, base: str, pattern: str = "*") -> DataFrame:
    """Files of the data folder with their size."""
    target, fs = _hadoop_path(spark, posixpath.join(base, pattern))
    found = fs.globStatus(target) or []
    rows = sorted((s.getPath().getName(), s.getLen()) for s in found)
    return spark.createDataFrame(rows, "dataset string, bytes long")


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> str:
    """Write a result; CSV gets a header and doubled quotes. Every task writes its own file."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":  # texts as they are: no trimming, no backslashes
        writer = writer.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    writer.save(path)
    return path
