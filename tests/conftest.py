import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from threadloom.session import local_session, ship_package  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", memory="4g")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle_con():
    from oracle import connect

    return connect(SMALL)


@pytest.fixture()
def frame(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)
