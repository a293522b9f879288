import pytest

from millrace.session import build_session
from tests.oracle_check import connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    return connect(SF)


@pytest.fixture
def tiny_groups(spark):
    """Every group of more than two rows takes the range-split path."""
    spark.conf.set("spark.millrace.hotGroupRows", "2")
    yield
    spark.conf.unset("spark.millrace.hotGroupRows")
