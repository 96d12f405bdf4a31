"""Session settings the engine relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture costs about two milliseconds per expression built.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(app: str = "pairsieve", cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    local = {
        "spark.sql.shuffle.partitions": str(cores if cores != "*" else 8),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**SETTINGS, **local, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The reliable folder for materialised intermediates.

    The cluster names it in ``spark.checkpoint.dir``; only a session without that setting
    running on ``local[*]`` falls back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialise(df):
    """Write a DataFrame to the checkpoint folder and read it back with its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_table(spark: SparkSession, rows: list[tuple], schema: str):
    """A table of settings-sized data held in the plan itself.

    Built through Arrow so that the optimizer sees a local relation with its true size.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = T._parse_datatype_string(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in parsed.fields]
    arrow = to_arrow_schema(parsed)
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), parsed)
