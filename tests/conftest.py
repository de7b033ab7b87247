import pytest

from stubble.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("stubble-tests", 4, "4g")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
