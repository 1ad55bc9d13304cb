"""Tables written once to the cluster's shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shuffles_dropped


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own (tests); on a
    cluster an unset folder is an error, since a machine-local one is lost with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = "file://" + tempfile.mkdtemp(prefix="rolemesh-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of at most ``BATCH_ROWS`` rows: whole texts make heavy rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back.

    Cuts the lineage with files that outlive any executor; every call writes a folder of its own.
    The shuffles of the write end with it: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, or a longer name that none of the taken ones equals; case does not count."""
    used = {t.lower() for t in taken}
    while wanted.lower() in used:
        wanted = "_" + wanted
    return wanted
