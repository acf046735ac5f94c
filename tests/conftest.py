import os

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from bindery.session import session

    shared = tmp_path_factory.mktemp("shared")
    spark = session("tests", "local[4]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g", spark__checkpoint__dir=f"file://{shared}", spark__sql__warehouse__dir=str(shared / "warehouse"))
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
