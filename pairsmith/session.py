"""Session defaults and the shared scratch folder."""

import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name that the driver and all executors see.

    It lies under ``spark.checkpoint.dir``. Where that is unset and all runs on
    one machine, as in tests, it lies in the session's warehouse; on a cluster
    the setting must name a shared folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master").startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{base.rstrip('/')}/pairsmith-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new scratch folder, so that it is worked out once, however often it is read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package() -> None:
    """Let Python workers run this package's functions without having it installed."""
    import pairsmith

    cloudpickle.register_pickle_by_value(pairsmith)
