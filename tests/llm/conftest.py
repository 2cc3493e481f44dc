import os

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def rows_of(spark):
    def read(name, n):
        if not os.path.exists(f"{SMALL}/{name}.parquet"):
            pytest.skip("no test data")
        df = spark.read.parquet(f"{SMALL}/{name}.parquet")
        return [tuple(r)[:2] for r in df.orderBy(df.columns[0]).limit(n).collect()]

    return read
