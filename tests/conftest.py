import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from boutworks.runtime import locate, session
    from boutworks.streaming.ratings import STATE_STORE

    conf = {"spark_sql_shuffle_partitions": "4", "spark_ui_enabled": "false", "spark_driver_memory": "4g", "spark_sql_streaming_stateStore_providerClass": STATE_STORE}
    spark = session("tests", "local[4]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    locate(spark)
    yield spark
    spark.stop()
