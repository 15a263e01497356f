"""Session set-up and the shared folder used for cut lineage and scratch tables."""

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def get_spark(app="leadloom", master=None, **conf):
    """A session with adaptive execution on; ``conf`` overrides any setting."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark):
    """Sends this package to the executors, once per application, so that functions that run
    there can be imported wherever the program was started."""
    sc = spark.sparkContext
    if getattr(sc, "_leadloom_sent", None) != sc.applicationId:
        package = os.path.dirname(os.path.abspath(__file__))
        own = tempfile.mkdtemp(prefix="leadloom-")
        # Executors fetch the file from the driver as long as it runs.
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = os.path.join(own, "leadloom.zip")
        with zipfile.ZipFile(path, "w") as file:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        file.write(full, os.path.relpath(full, os.path.dirname(package)))
        sc.addPyFile(path)
        sc._leadloom_sent = sc.applicationId
    return spark


def shared_dir(spark):
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own; on a cluster an unset
    value is an error, because executors could not read each other's files.
    """
    sc = ship(spark).sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        path = tempfile.mkdtemp(prefix="leadloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def deal_out(df):
    """The same rows, dealt out evenly over several tasks a core.

    A row group of a parquet file is read by a single task, whatever the splits, so a table of a
    million narrow rows may lie in one. For rows that are short next to the work they cause.
    The condition holds for every row; as it is not deterministic, no filter on costly columns
    is moved through it to the few tasks that read the file.
    """
    spark = df.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(3 * spark.sparkContext.defaultParallelism, wide)).where(F.spark_partition_id() >= 0)


def worked_out(df):
    """The same rows, with every column worked out before any filter above looks at it: a filter that is moved
    below repeats the expressions it looks at. None is moved through a column that is not deterministic, and a
    condition on that column, which holds for every row, keeps the column."""
    task = "_task"
    while task in {c.lower() for c in df.columns}:
        task = f"_{task}"
    return df.withColumn(task, F.spark_partition_id()).where(F.col(task) >= 0).drop(task)


def scratch_path(spark, name):
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
