import os

import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import __spark_entry__  # noqa: F401  ships the package to the workers

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}"
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Compares a query with its SQL over the smallest tables, without regard to order."""

    def plain(rows, names):
        at = sorted(range(len(names)), key=lambda i: names[i])
        value = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
        return sorted((tuple(value(r[i]) for i in at) for r in rows), key=repr)

    def check(query, sql):
        df = query(spark, SF)
        relation = duck.sql(sql)
        assert sorted(df.columns) == sorted(relation.columns)
        assert plain(df.collect(), df.columns) == plain(relation.fetchall(), relation.columns)

    return check
