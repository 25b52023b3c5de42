import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from skerry.session import local_session, ship_package

    s = local_session("8", "tests")
    s.conf.set("spark.sql.shuffle.partitions", "8")
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
