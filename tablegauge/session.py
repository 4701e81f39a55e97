"""Session helpers: settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import tablegauge

# folders of local sessions whose configuration names none, by application
_LOCAL_FOLDERS: dict[str, str] = {}
# whether an application's Python workers can import the package
_IMPORTABLE: dict[str, bool] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the few session options results depend on. Safe to call repeatedly."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    app = spark.sparkContext.applicationId
    if app not in _IMPORTABLE:
        # functions that run in Python workers travel whole where these can't import the package
        cloudpickle.register_pickle_by_value(tablegauge)
        _IMPORTABLE[app] = _workers_import(spark)
        if _IMPORTABLE[app]:
            cloudpickle.unregister_pickle_by_value(tablegauge)
    return spark


def _workers_import(spark: SparkSession) -> bool:
    """Whether Python workers find the package by its name; asks one."""

    def look(batches):
        from importlib.util import find_spec

        import pyarrow

        for _ in batches:
            yield pyarrow.RecordBatch.from_pydict({"found": [find_spec("tablegauge") is not None]})

    return spark.range(0, 1, 1, 1).mapInArrow(look, "found boolean").first()["found"]


def shared_folder(spark: SparkSession) -> str:
    """Folder for written tables, as the cluster names it in spark.checkpoint.dir.

    Only a local session without the setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="tablegauge-")
    return _LOCAL_FOLDERS[app]


def keep(df: DataFrame) -> DataFrame:
    """Write a small intermediate to the shared checkpoint folder and go on from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench."""
    return prepare(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tablegauge")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", memory))
        .getOrCreate()
    )
