import os
from datetime import date

import pytest

from lendframe.sources.seed import seed
from lendframe.sources.workspace import local_session

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("8", "tests", str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lib(spark):
    """The baseline library."""
    return seed(spark)


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_SMALL):
        pytest.skip("test data is not there")
    return SF_SMALL


@pytest.fixture(scope="session")
def today():
    return date(2024, 4, 10)
